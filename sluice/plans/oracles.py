"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

from sluice.functions.text import CLIENT_LINE_PREFIXES
from sluice.plans import load_queries

_COLUMNS = {
    "orders": [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "n"),
               ("o_orderdate", "t"), ("o_orderpriority", "s")],
    "customer": [("c_custkey", "n"), ("c_name", "s"), ("c_nationkey", "n"), ("c_acctbal", "n"), ("c_mktsegment", "s")],
    "supplier": [("s_suppkey", "n"), ("s_name", "s"), ("s_nationkey", "n"), ("s_acctbal", "n")],
    "part": [("p_partkey", "n"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "n"), ("p_retailprice", "n")],
    "lineitem": [("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"), ("l_quantity", "n"),
                 ("l_extendedprice", "n"), ("l_discount", "n"), ("l_tax", "n"), ("l_returnflag", "s"),
                 ("l_linestatus", "s"), ("l_shipdate", "t")],
    "events": [("event_id", "n"), ("ts", "t"), ("user_id", "n"), ("event_type", "s"), ("value", "n"), ("props", "s")],
    "documents": [("doc_id", "n"), ("text", "s")],
}


def _text(name: str, kind: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S')" if kind == "t" else f"CAST({name} AS VARCHAR)"


def _literal(name: str, kind: str) -> str:
    if kind == "s":
        return f"'''' || replace({name}, '''', '''''') || ''''"
    if kind == "t":
        return f"'TO_DATE(''' || {_text(name, kind)} || ''', ''YYYY-MM-DD HH24:MI:SS'')'"
    return _text(name, kind)


def _insert(table: str, into: str | None = None) -> str:
    """SQL expression for the INSERT text of a row, without end mark."""
    cols = _COLUMNS[table]
    target = into or f"'{table}'"
    names = ", ".join(c for c, _ in cols)
    return f"'INSERT INTO ' || {target} || ' ({names}) VALUES (' || " + " || ', ' || ".join(
        _literal(c, k) for c, k in cols) + " || ')'"


_LINES = "unnest(string_split(text, chr(10)))"
_CLIENT = "|".join(p.replace("*", r"\*") for p in CLIENT_LINE_PREFIXES)
ORACLES = {f"roundtrip_{t}": f"SELECT * FROM {t}" for t in (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
    "conversations")}
ORACLES["roundtrip_broken_literals"] = "SELECT doc_id, replace(text, '. ', ''';' || chr(10)) AS text FROM documents"
for _q in ("load_table", "load_append"):
    ORACLES[_q] = "SELECT * FROM orders"
ORACLES["stream_ingest"] = "SELECT * FROM customer"
ORACLES["stream_ingest_tables"] = """
SELECT 'customer' AS table_name, c_custkey::BIGINT AS key, c_name AS name, c_acctbal::DOUBLE AS amount FROM customer
UNION ALL SELECT 'supplier', s_suppkey::BIGINT, s_name, s_acctbal::DOUBLE FROM supplier
UNION ALL SELECT 'orders', o_orderkey::BIGINT, o_orderstatus, o_totalprice::DOUBLE FROM orders"""

ORACLES["stmt_scan"] = f"SELECT {_insert('orders')} || ';' AS stmt FROM orders"
ORACLES["dump_export"] = f"SELECT o_orderkey, {_insert('orders')} || ';' AS stmt FROM orders"
ORACLES["insert_extract"] = f"""
SELECT * FROM (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n,
  {_insert('customer')} || ';' AS stmt FROM customer) WHERE n <= 10"""
ORACLES["line_count"] = """
SELECT 'orders' AS source, count(*) AS n_lines, count(*) AS n_records FROM orders
UNION ALL SELECT 'documents', sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT, count(*) FROM documents
UNION ALL SELECT 'conversations', sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT, count(*) FROM conversations"""
ORACLES["line_filter"] = f"""
WITH l AS (SELECT doc_id, CASE lang WHEN 'fr' THEN 'PROMPT ' WHEN 'de' THEN '  -- ' WHEN 'es' THEN 'set ' ELSE '' END
  || {_LINES} AS line FROM documents),
k AS (SELECT doc_id, upper(trim(line, ' ' || chr(9) || chr(13) || chr(10))) AS u FROM l)
SELECT doc_id, count(*) FILTER (WHERE u <> '' AND NOT regexp_matches(u, '^({_CLIENT})')) AS kept,
  count(*) FILTER (WHERE NOT (u <> '' AND NOT regexp_matches(u, '^({_CLIENT})'))) AS dropped FROM k GROUP BY doc_id"""
ORACLES["stmt_clean"] = f"""
SELECT o_orderkey, {_insert('orders')} || ' ;' AS stmt FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"""
ORACLES["format_check"] = r"""
SELECT conv_id, turn, CAST((role = 'user' OR regexp_matches('INSERT INTO t VALUE ' || text, '(?i)VALUES\s*\(')) AS INTEGER) AS ok
FROM conversations"""
ORACLES["values_parse"] = " UNION ALL ".join(
    f"SELECT o_orderkey, {i} AS pos, {_literal(c, k)} AS raw FROM orders"
    for i, (c, k) in enumerate(_COLUMNS["orders"], 1))
ORACLES["column_list"] = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS column_name, count(*) AS n FROM customer" for i, (c, _) in enumerate(_COLUMNS["customer"], 1))
ORACLES["table_name"] = """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '' WHEN o_orderstatus = 'F' THEN 'orders_f'
  WHEN o_orderstatus = 'P' THEN 'orders_p' ELSE 'orders_o' END AS table_name FROM orders"""
ORACLES["file_table_name"] = r"""
SELECT page_id, regexp_replace(regexp_replace(string_split(url, '/')[-1], '([^.])\.[^.]*$', '\1'), '[^\w]', '_', 'g') AS table_name
FROM pages"""
ORACLES["qualifier_strip"] = f"SELECT c_custkey, {_insert('customer')} AS stmt FROM customer"
ORACLES["line_normalise"] = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS line_no, trim(regexp_replace(ls[i], '\\s+', ' ', 'g')) AS line
FROM d, unnest(range(1, len(ls) + 1)) AS r(i)""".replace("\\\\", "\\")
ORACLES["date_literals"] = """
SELECT o_orderkey, 'INSERT INTO orders VALUES (' || o_orderkey || ', ''' || strftime(o_orderdate, '%Y-%m-%d') || '''::date, '''
  || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '''::timestamp, NULL, ''null at ' || strftime(o_orderdate, '%Y-%m-%d') || ''')' AS stmt
FROM orders"""

_CLEAN_DDL = """'CREATE TABLE part_' || p_partkey || ' ( id NUMBER(10) PRIMARY KEY, size_no INT, name VARCHAR2(' || p_size
  || ' CHAR), price NUMBER(10, 2), made DATETIME, note CLOB, weight DOUBLE, ) ENGINE=InnoDB DEFAULT CHARSET=utf8;'"""
ORACLES["ddl_clean"] = f"SELECT p_partkey, {_CLEAN_DDL} AS ddl FROM part"
ORACLES["ddl_convert"] = """
SELECT p_partkey, 'CREATE TABLE part_' || p_partkey || ' ( id NUMERIC(10) PRIMARY KEY, size_no INTEGER, name VARCHAR(' || p_size
  || '), price NUMERIC(10,2), made TIMESTAMP, note TEXT, weight DOUBLE PRECISION) ;' AS ddl FROM part"""
ORACLES["ddl_valid"] = """
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END AS ok,
  CASE p_type WHEN 'ECONOMY' THEN 'APP_OWNER' WHEN 'STANDARD' THEN 't_x' ELSE 'part_' || p_partkey END AS name FROM part"""
ORACLES["ddl_extract"] = """
SELECT conv_id, turn, CASE turn WHEN 0 THEN c WHEN 1 THEN c || ';' WHEN 2 THEN c || ';' ELSE '' END AS ddl
FROM (SELECT conv_id, turn, 'CREATE TABLE t_' || conv_id || ' (id INT, turn_' || turn || ' INT)' AS c FROM conversations)"""

_CUSTOMER_LINES = f"""SELECT c_mktsegment, c_custkey, {_insert('customer')} || ';' AS line,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS line_no FROM customer"""
ORACLES["head_sample"] = f"SELECT c_mktsegment, c_custkey, line_no, line FROM ({_CUSTOMER_LINES}) WHERE line_no <= 100"
ORACLES["spread_sample"] = """
SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey,
  row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS line_no FROM orders) WHERE line_no <= 75"""
ORACLES["stmt_preview"] = f"""
WITH s AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, {_insert('documents')} AS stmt FROM documents)
SELECT source, n, CASE WHEN length(stmt) > 500 THEN left(stmt, 500) || '...' ELSE stmt END AS preview FROM s WHERE n <= 5"""
ORACLES["row_estimate"] = f"""
WITH l AS ({_CUSTOMER_LINES}),
z AS (SELECT c_mktsegment, sum(strlen(line) + 1) AS file_size FROM l GROUP BY 1),
m AS (SELECT c_mktsegment, avg(strlen(line)) AS a, avg(strlen(line) + 1) FILTER (WHERE line_no <= 50) AS h FROM l WHERE line_no <= 100 GROUP BY 1)
SELECT c_mktsegment, file_size::BIGINT AS file_size, floor(file_size / a)::BIGINT AS estimated_rows,
  floor(file_size / h)::BIGINT AS estimated_rows_fast FROM z JOIN m USING (c_mktsegment)"""
ORACLES["density_estimate"] = """
WITH d AS (SELECT source, strlen(text) AS b, length(text) - length(replace(text, chr(10), '')) AS l,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n,
    sum(strlen(text)) OVER (PARTITION BY source) AS file_size FROM documents),
e AS (SELECT *, greatest(n // 10, 1) AS step FROM d)
SELECT source, max(file_size)::BIGINT AS file_size, floor(max(file_size) * sum(l)::DOUBLE / sum(b))::BIGINT AS estimated_rows
FROM e WHERE p % step = 0 AND p // step < 10 GROUP BY source"""
ORACLES["chunk_bytes"] = f"""
WITH l AS (SELECT c_mktsegment, c_custkey, strlen(line) + 1 AS size FROM ({_CUSTOMER_LINES})),
o AS (SELECT *, sum(size) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - size AS start FROM l)
SELECT c_mktsegment, (start // 16384)::BIGINT AS chunk_no, count(*) AS n_statements, sum(size)::BIGINT AS n_bytes,
  min(c_custkey) AS first_key FROM o GROUP BY 1, 2"""
ORACLES["batch_rows"] = """
WITH o AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS pos FROM orders)
SELECT o_orderpriority, ((pos - 1) // 1000)::BIGINT AS batch_no, count(*) AS n_statements, min(o_orderkey) AS first_key,
  max(pos) AS last_pos FROM o GROUP BY 1, 2"""
ORACLES["quality_gate"] = f"""
WITH l AS (SELECT source, CASE lang WHEN 'en' THEN ' insert ' WHEN 'de' THEN '中文 ' ELSE '' END || {_LINES} AS line FROM documents),
g AS (SELECT source, count(*) AS n_lines, count(*) FILTER (WHERE starts_with(upper(trim(line)), 'INSERT')) AS n_insert,
  count(*) FILTER (WHERE regexp_matches(line, '[\\x{{4e00}}-\\x{{9fff}}]')) AS n_cjk FROM l GROUP BY source)
SELECT *, CAST(n_insert / n_lines > 0.1 AS INTEGER) AS passes FROM g"""

ORACLES["encoding_detect"] = r"""
SELECT doc_id, CASE WHEN lang = 'fr' AND regexp_matches(text, '[^\x00-\x7F]') THEN 'gbk' WHEN lang = 'de' THEN 'utf-16' ELSE 'utf-8' END AS encoding
FROM documents"""
ORACLES["encoding_fallback"] = r"""
WITH d AS (SELECT *, length(text) - length(replace(text, chr(10), '')) + 1 < 10 AS few FROM documents)
SELECT doc_id, CASE WHEN NOT few THEN 'utf-8' WHEN lang = 'fr' AND regexp_matches(text, '[^\x00-\x7F]') THEN 'gbk'
  WHEN lang = 'de' THEN 'utf-16' ELSE 'utf-8' END AS used_encoding, CAST(NOT few AS INTEGER) AS ignore_errors FROM d"""
ORACLES["decode_text"] = "SELECT doc_id, text FROM documents"


def _sql_type(c: str, k: str, t: str) -> str:
    """Expected type of a column, worked out from its values."""
    if k == "s":
        return f"(SELECT 'VARCHAR(' || max(length({c})) || ')' FROM {t})"
    if k == "t":
        return "'TIMESTAMP'"
    v = f"replace(CAST({c} AS VARCHAR), '-', '')"
    i, s = f"max(length(split_part({v}, '.', 1)))", f"max(length(split_part({v}, '.', 2)))"
    return (f"(SELECT CASE WHEN {s} = 0 THEN 'INT' ELSE 'DECIMAL(' || ({i} + {s}) || ',' || {s} || ')' END FROM {t})")


ORACLES["infer_types"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {i} AS pos, '{c}' AS column_name, {_sql_type(c, k, t)} AS sql_type, CAST(1.0 AS DOUBLE) AS confidence"
    for t in ("orders", "part", "lineitem", "events", "customer") for i, (c, k) in enumerate(_COLUMNS[t], 1))
ORACLES["column_profile"] = " UNION ALL ".join(
    f"""SELECT 'orders' AS table_name, '{c}' AS column_name, {i} AS pos, count(*) AS n, 0::BIGINT AS n_null,
    max(length({_text(c, k)}))::INTEGER AS max_len, min({_text(c, k)}) AS min_text, max({_text(c, k)}) AS max_text,
    (SELECT string_agg(r, ' | ' ORDER BY r) FROM (SELECT {_literal(c, k)} AS r FROM orders ORDER BY r LIMIT 5)) AS samples FROM orders"""
    for i, (c, k) in enumerate(_COLUMNS["orders"], 1))


def _ddl(t: str, dialect: str) -> str:
    key = _COLUMNS[t][0][0]
    parts = []
    for c, k in _COLUMNS[t]:
        typed = _sql_type(c, k, t)
        if dialect == "doris":
            typed = f"replace({typed}, 'TIMESTAMP', 'DATETIME')"
        else:
            typed = f"(CASE WHEN {typed} = 'INT' THEN 'INTEGER' ELSE {typed} END)"
        parts.append(f"'{c} ' || {typed}")
    tail = {"doris": f') DUPLICATE KEY({key}) DISTRIBUTED BY HASH({key}) BUCKETS 10 PROPERTIES ("replication_num" = "1");',
            "postgresql": ");"}[dialect]
    return f"SELECT '{dialect}' AS dialect, '{t}' AS table_name, 'CREATE TABLE {t} (' || " + " || ', ' || ".join(parts) + f" || '{tail}' AS ddl"


ORACLES["ddl_render"] = " UNION ALL ".join(_ddl(t, d) for t in ("orders", "customer") for d in ("doris", "postgresql"))
ORACLES["override_schema"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""
ORACLES["manifest"] = " UNION ALL ".join(
    f"SELECT '{t}' AS source, '.txt' AS extension, sum(strlen({_insert(t)}) + 2)::BIGINT AS total_bytes FROM {t}"
    for t in ("orders", "customer", "supplier"))
ORACLES["admit_files"] = r"""
WITH p AS (SELECT page_id, url, length(html) AS mb, regexp_replace(url, '^https?://|[^A-Za-z0-9/.]', '', 'g')
    || CASE WHEN contains(url, 'page') THEN '.sql' ELSE '.txt' END AS name FROM pages),
q AS (SELECT *, CASE WHEN contains(url, '?q=') THEN '' WHEN contains(url, '/en') THEN '/data/dumps/../secret/' || name
    WHEN contains(url, '/de') THEN '/data/dumps/' || repeat(name, 12) ELSE '/data/./dumps//a/../' || name END AS path FROM p),
n AS (SELECT *, CASE WHEN path = '' THEN '/' WHEN contains(url, '/en') THEN '/data/secret/' || name
    WHEN contains(url, '/de') THEN path ELSE '/data/dumps/' || name END AS raw_path FROM q),
r AS (SELECT *, CASE WHEN raw_path = '/' THEN '/' ELSE rtrim(regexp_replace(raw_path, '/+', '/', 'g'), '/') END AS normalized_path FROM n)
SELECT page_id, CASE WHEN length(path) = 0 OR length(path) > 255 THEN 'PATH_001' WHEN NOT starts_with(normalized_path, '/data/dumps/') THEN 'PATH_002'
  WHEN contains(url, 'ref') THEN 'PATH_003' WHEN NOT regexp_matches(normalized_path, '\.sql$') THEN 'PATH_001'
  WHEN mb > 2048 THEN 'PATH_005' ELSE 'OK' END AS error_code, normalized_path FROM r"""
ORACLES["load_ledger"] = """
SELECT 'orders' AS table_name, 0::BIGINT AS failed_tasks, count(*) AS total_rows_imported, 1 AS success FROM orders"""
ORACLES["migrate_tables"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS total_rows_imported, 0::BIGINT AS rejected_rows, 1 AS success FROM {t}"
    for t in ("orders", "customer", "nation"))
_SPARK = {"n": "double", "s": "string", "t": "timestamp_ntz"}
_LINEITEM = [(c, "bigint" if c in ("l_orderkey", "l_partkey", "l_suppkey") else "int" if c == "l_linenumber" else _SPARK[k])
             for c, k in _COLUMNS["lineitem"]]
ORACLES["table_info"] = " UNION ALL ".join(
    f"SELECT 'lineitem' AS table_name, count(*) AS row_count, {i} AS pos, '{c}' AS column_name, '{t}' AS data_type, 1 AS nullable FROM lineitem"
    for i, (c, t) in enumerate(_LINEITEM, 1))
ORACLES["reconcile"] = """
SELECT 'orders' AS table_name, count(*) AS source_rows, count(*) AS target_rows, 1 AS matches FROM orders
UNION ALL SELECT 'customer', count(*), count(*), 1 FROM customer
UNION ALL SELECT 'lineitem', 0, count(*), 0 FROM lineitem"""
ORACLES["reconcile_content"] = """
SELECT 'source_only' AS side, o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'target_only', o_orderkey, 1.5 FROM orders WHERE o_orderpriority = '1-URGENT'"""
ORACLES["resume_chunks"] = """
SELECT o_orderkey, o_custkey AS chunk_id FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_custkey = o.o_custkey AND d.o_orderstatus = 'P')"""
_VALUES = " || ', ' || ".join(_literal(c, k) for c, k in _COLUMNS["orders"][:-1])
_REST = " || ', ' || ".join(_literal(c, k) for c, k in _COLUMNS["orders"][1:])
ORACLES["rejects"] = f"""
SELECT 'arity_mismatch' AS reason, count(*) AS n, max('(' || {_VALUES} || ')') AS max_raw FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'bad_value:o_orderkey', count(*), max('(''x' || o_orderkey || ''', ' || {_REST} || ')') FROM orders WHERE o_orderpriority = '2-HIGH'
UNION ALL SELECT 'not_insert', count(*), 'DELETE FROM orders;' FROM orders WHERE o_orderpriority = '5-LOW'"""

ORACLES["migrate_mixed"] = """
WITH k AS (SELECT o_orderkey % 6 AS kind, count(*) AS n FROM orders GROUP BY 1)
SELECT 'mixed' AS table_name, sum(CASE kind WHEN 0 THEN 2 * n WHEN 1 THEN n ELSE 0 END)::BIGINT AS total_rows_imported,
  sum(CASE kind WHEN 4 THEN n ELSE 0 END)::BIGINT AS rejected_rows, 1 AS success FROM k
UNION ALL SELECT 'Odd $ name', n, 0, 1 FROM k WHERE kind = 2
UNION ALL SELECT 'unread', 0, n, 1 FROM k WHERE kind = 5
UNION ALL SELECT '_unassigned', 0, n, 1 FROM k WHERE kind = 3"""
ORACLES["literal_expressions"] = """
SELECT o_orderkey::BIGINT AS id, o_orderpriority AS word, NULL::VARCHAR AS reason FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT -o_orderkey::BIGINT, o_orderpriority, NULL FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT o_orderkey::BIGINT, 'a' || chr(10) || o_orderpriority, NULL FROM orders WHERE o_orderkey % 6 = 1
UNION ALL SELECT o_orderkey::BIGINT, NULL, 'unsupported_expression:word' FROM orders WHERE o_orderkey % 6 = 4"""
ORACLES["fallback_schema"] = " UNION ALL ".join([
    *[f"SELECT 'orders' AS table_name, {i} AS pos, '{c}' AS column_name, 'TEXT' AS sql_type, CAST(0.3 AS DOUBLE) AS confidence, 'text' AS kind"
      for i, (c, _) in enumerate(_COLUMNS["orders"], 1)],
    *[f"SELECT 'orders', {i}, '{c}', '{t}', CAST(0.3 AS DOUBLE), 'generic'"
      for i, (c, t) in enumerate((("id", "BIGINT"), ("data", "TEXT"), ("created_time", "TIMESTAMP")), 1)]])

_LOG = """SELECT event_id AS task_id, 't_' || user_id AS table_name, ts, event_type <> 'error' AS ok, length(props) AS affected_rows,
  CAST(value AS DECIMAL(18,6)) AS seconds, props FROM events"""
ORACLES["import_summary"] = f"""
WITH g AS (SELECT table_name, count(*) AS total_tasks, count(*) FILTER (WHERE ok) AS completed_tasks,
    count(*) FILTER (WHERE NOT ok) AS failed_tasks, coalesce(sum(affected_rows) FILTER (WHERE ok), 0)::BIGINT AS total_rows_imported,
    CAST(sum(seconds) AS DOUBLE) AS total_execution_time FROM ({_LOG}) GROUP BY table_name)
SELECT table_name, total_tasks, completed_tasks, failed_tasks, total_rows_imported,
  total_execution_time, CAST(failed_tasks = 0 AS INTEGER) AS success,
  total_rows_imported / greatest(total_execution_time, 0.001) AS rows_per_second FROM g"""
ORACLES["import_errors"] = f"SELECT table_name, task_id, props AS error_message FROM ({_LOG}) WHERE NOT ok"
ORACLES["progress_running"] = f"""
WITH w AS (SELECT task_id, table_name, sum(ok::INTEGER) OVER o AS completed_tasks, sum((NOT ok)::INTEGER) OVER o AS failed_tasks,
  count(*) OVER (PARTITION BY table_name) AS total_tasks FROM ({_LOG})
  WINDOW o AS (PARTITION BY table_name ORDER BY ts, task_id ROWS UNBOUNDED PRECEDING))
SELECT *, (completed_tasks + failed_tasks) / total_tasks * 100 AS progress_percent FROM w"""
_FILES = f"SELECT table_name || '/' || strftime(ts, '%Y-%m-%d') AS file_path, bool_and(ok) AS success FROM ({_LOG}) GROUP BY 1"
ORACLES["multi_file"] = f"SELECT count(*) FILTER (WHERE success) AS success_count, count(*) AS total_count FROM ({_FILES})"
ORACLES["file_outcomes"] = f"SELECT file_path, success::INTEGER AS success FROM ({_FILES})"
ORACLES["metrics_rollup"] = """
WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS config, event_type AS variant, CAST(value AS DECIMAL(18,6)) AS s, length(props) > 8 AS ok FROM events),
r AS (SELECT config, variant, CAST(sum(s) FILTER (WHERE ok) AS DOUBLE) / count(*) FILTER (WHERE ok) AS a,
    CAST(min(s) FILTER (WHERE ok) AS DOUBLE) AS min_time, CAST(max(s) FILTER (WHERE ok) AS DOUBLE) AS max_time,
    count(*) FILTER (WHERE ok) / count(*) AS rate FROM m GROUP BY 1, 2),
x AS (SELECT *, max(a) FILTER (WHERE variant = 'view') OVER (PARTITION BY config) AS base FROM r)
SELECT config, variant, min_time, max_time, row_number() OVER (PARTITION BY config ORDER BY a NULLS LAST, variant) AS rank,
  a AS avg_time, rate AS success_rate, min(a) OVER (PARTITION BY config) / a AS speedup,
  (base - a) / base * 100 AS improvement_percent FROM x"""

_TASKS = """SELECT user_id AS task_id, ts, event_id, CASE WHEN value > 450 THEN 'cancelled' WHEN event_type = 'signup' THEN 'pending'
  WHEN event_type = 'view' THEN 'waiting_confirmation' WHEN event_type = 'click' THEN 'importing'
  WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' END AS status FROM events"""
_LATEST = f"""SELECT task_id, status, ts AS last_update, n_events FROM (SELECT *, count(*) OVER (PARTITION BY task_id) AS n_events,
  row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS rn FROM ({_TASKS})) WHERE rn = 1"""
ORACLES["task_latest"] = _LATEST
ORACLES["stream_status"] = _LATEST
ORACLES["status_events"] = f"""
SELECT task_id, status, CASE status WHEN 'waiting_confirmation' THEN 'schema_inferred' WHEN 'importing' THEN 'import_progress'
  WHEN 'completed' THEN 'import_completed' WHEN 'failed' THEN 'task_failed' END AS event FROM ({_LATEST})
WHERE status IN ('waiting_confirmation', 'importing', 'completed', 'failed')"""
ORACLES["status_overview"] = f"SELECT status, count(*) AS n_tasks FROM ({_LATEST}) GROUP BY status"
ORACLES["task_duration"] = f"""
WITH t AS ({_TASKS}) SELECT task_id,
  date_diff('microsecond', min(ts), min(CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN ts END)) / 1e6 AS seconds
FROM t GROUP BY 1"""
ORACLES["drop_cancelled"] = f"""
WITH t AS ({_TASKS}) SELECT task_id, event_id, status FROM t
WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.task_id = t.task_id AND c.status = 'cancelled')"""
ORACLES["flagship"] = """
SELECT o_orderstatus, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price
FROM orders GROUP BY o_orderstatus"""

ORACLES.update(load_queries.ORACLES)
