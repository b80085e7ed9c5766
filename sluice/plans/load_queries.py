"""Registered queries on dumps that are hard to load: resumption, dialects, statement boundaries, damaged bytes.

Each writes a whole driver table as a dump, loads it, and has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import ddl
from sluice.functions.charset import encode_text
from sluice.operators.export import insert_text, write_dump
from sluice.operators.values import typed_rows
from sluice.plans import load, migrate
from sluice.plans.catalog import publish
from sluice.session import discard, scratch, spread
from sluice.sources import dumps
from sluice.sources.ranges import list_files

_BUCKETS = 4
#: keys of one block, whose rows of a bucket are a file; a few MB
_BLOCK = 1 << 18
_PAIR = "id bigint, word string"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _write_files(spark: SparkSession, lines: DataFrame, folder: str) -> str:
    """Rows (bucket, place, value) as one dump file a bucket, under names that stay when it is written again. Rows that
    have a ``block`` too get a file for each bucket and block, so that no task sorts a share of all rows."""
    at, keys = scratch(spark, "buckets"), [c for c in ("bucket", "block") if c in lines.columns]
    dealt = lines.repartition(*keys).sortWithinPartitions(*keys, "place").select(*keys, "value")
    dealt.write.partitionBy(*keys).option("lineSep", ";\n").text(at)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    for found in files.globStatus(path(f"{at}{'/*=*' * len(keys)}/part-*")):
        name = found.getPath().toString().split("/")[-1 - len(keys) : -1]
        target = path(f"{folder}/{','.join(name).removesuffix(',block=0')}.sql")
        files.delete(target, False)
        files.rename(found.getPath(), target)
    discard(spark, at)
    return folder


def _bucketed(o: DataFrame, price: Column | None = None) -> DataFrame:
    """Orders as lines; even keys come first in each file, so that odd keys make it grow."""
    priced = o if price is None else o.withColumn("o_totalprice", price)
    return priced.select(
        (F.col("o_orderkey") % _BUCKETS).alias("bucket"), F.floor(F.col("o_orderkey") / F.lit(_BLOCK)).alias("block"), F.struct(F.col("o_orderkey") % 8 >= 4, "o_orderkey").alias("place"),
        F.col("o_orderkey").alias("key"), insert_text(priced, "orders").alias("value"))


def _loaded(spark: SparkSession, root: str, o: DataFrame) -> DataFrame:
    return load.read_table(spark, load.LoadTarget(root, "orders"), o.schema)


def migrate_rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files loaded three times in chunks of other sizes: every row once."""
    o, root = _orders(spark, sf_dir), scratch(spark, "load")
    path = _write_files(spark, _bucketed(o), scratch(spark, "dump-orders"))
    for size in (1 << 20, 300_000, 8 << 20):
        migrate.migrate(spark, path, root, "orders", o.schema, chunk_bytes=size)
    return _loaded(spark, root, o)


def migrate_grown_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the orders, then the same files with the other half behind it, in other chunks: every row once."""
    o, root, path = _orders(spark, sf_dir), scratch(spark, "load"), scratch(spark, "dump-orders")
    lines = _bucketed(o)
    for part, size in ((lines.filter("key % 8 < 4"), 1 << 20), (lines, 700_000)):
        _write_files(spark, part, path)
        migrate.migrate(spark, path, root, "orders", o.schema, chunk_bytes=size)
    return _loaded(spark, root, o)


def migrate_replaced_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose rows all changed takes the place of its old rows; the other files are left as they are."""
    o, root, path = _orders(spark, sf_dir), scratch(spark, "load"), scratch(spark, "dump-orders")
    changed = F.when(F.col("o_orderkey") % _BUCKETS == 1, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    for lines in (_bucketed(o), _bucketed(o, changed)):
        _write_files(spark, lines, path)
        migrate.migrate(spark, path, root, "orders", o.schema, on_replaced="replace")
    return _loaded(spark, root, o)


def _kinds(o: DataFrame, kinds: list[Column]) -> DataFrame:
    line = F.get(F.array(*kinds), (F.col("o_orderkey") % len(kinds)).cast("int")).alias("value")
    return spread(o.select("o_orderkey", "o_orderpriority"), "o_orderkey").select(line)


def _told(spark: SparkSession, path: str, dialect: str, chunk_bytes: int = 200_000) -> DataFrame:
    """Rows and rejects of a dump of (id, word): id, word, reason."""
    stmts = dumps.read_statements(spark, path, chunk_bytes=chunk_bytes, dialect=dialect)
    typed = typed_rows(stmts, migrate.as_struct(_PAIR))
    return typed.select("id", F.when(F.col("_reason").isNull(), F.col("word")).alias("word"), F.col("_reason").alias("reason"))


def _insert(head: str, tail: str, end: str = ")") -> Column:
    """``head`` id ``, `` literal around the priority."""
    begin, close = tail.split("@")
    return F.concat(F.lit(head), F.col("o_orderkey").cast("string"), F.lit(", " + begin), F.col("o_orderpriority"), F.lit(close + end))


def literals_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with marks of their own, which hold apostrophes, separators, comment signs and brackets."""
    head = "INSERT INTO t VALUES ("
    kinds = [
        _insert(head, "q'{it's @;\nx}'"), _insert(head, "Q'!it's @ -- no comment!'"), _insert(head, "nq'(it's /* @)'"),
        _insert(head, "SYSDATE /* @ */"), _insert(head, "q'<@'s>' || CHR(10) || 'x'"), _insert(head, "'plain ''@'''"),
        _insert(head, "q'XX;\n@\"s ]' X'"), _insert(head, "user_of_@"), _insert(head, "q'[@]'"),
    ]
    return _told(spark, write_dump(_kinds(_orders(spark, sf_dir), kinds), scratch(spark, "dump-q")), "oracle")


def literals_mysql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backslash escapes, text in double quotes, introducers and comments from a hash."""
    head = "INSERT INTO `t` VALUES ("
    kinds = [
        _insert(head, r"'it\'s @;\nx'"), _insert(head, r'''"dq \"@\" 'x'"'''), _insert(head, r"'tab\\t\t@\\'"),
        _insert(head, "NOW() -- @\n"), _insert(head, "_utf8mb4'@'"), _insert(head, "'a;\nb\\' @'"),
        _insert("# it's a comment\nINSERT INTO t VALUES (", r"'don''t 5\% @'"), _insert(head, "'@\\\\;\n'"),
    ]
    return _told(spark, write_dump(_kinds(_orders(spark, sf_dir), kinds), scratch(spark, "dump-mysql")), "mysql")


def scan_directive_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives and comments with odd apostrophes and separators in them: every statement is read, and none is longer
    than it was written."""
    head = "INSERT INTO t VALUES ("
    kinds = [
        _insert("PROMPT it's\n" + head, "'@'"), _insert("REM don't;\n" + head, "'@'"), _insert("-- it's;\n" + head, "'@;\n'"),
        _insert("/* it's;\n'' */\n" + head, "'@'"), _insert("INSERT INTO t -- it's;\n VALUES (", "'@'"), _insert(head, "'@'"),
        _insert(head, "'@' /* that's;\n*/"), _insert("SET x it's;\n" + head, "'@'"),
    ]
    path = write_dump(_kinds(_orders(spark, sf_dir), kinds), scratch(spark, "dump-directives"))
    stmts = dumps.read_statements(spark, path, chunk_bytes=200_000)
    typed = typed_rows(stmts.filter(F.length("stmt") < 120), migrate.as_struct(_PAIR))
    return typed.select("id", "word", F.col("_reason").alias("reason"))


def migrate_bad_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GBK dump in which some statements hold bytes that are none: those are rejects, none loads without its bytes."""
    text = F.concat(F.lit("INSERT INTO t VALUES ("), F.col("o_orderkey").cast("string"), F.lit(", '中文"), F.col("o_orderpriority"))
    bad = F.when(F.col("o_orderkey") % 5 == 0, F.unhex(F.lit("FFFF"))).otherwise(F.unhex(F.lit("")))
    line = F.concat(encode_text(text, F.lit("gbk")), bad, F.lit("')").cast("binary")).cast("string")
    path, root = write_dump(_orders(spark, sf_dir).select(line.alias("value")), scratch(spark, "dump-gbk")), scratch(spark, "load")
    migrate.migrate(spark, path, root, "t", _PAIR, separator=";\n", encoding="gbk", chunk_bytes=200_000)
    target = load.LoadTarget(root, "t")
    rows = load.read_table(spark, target, migrate.as_struct(_PAIR)).groupBy("word").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    refused = load.read_rejects(spark, target).groupBy("reason").agg(F.count("*").alias("n"))
    return rows.select("word", F.lit(None).cast("string").alias("reason"), "n", "ids").unionByName(
        refused.select(F.lit(None).cast("string").alias("word"), "reason", "n", F.lit(None).cast("long").alias("ids")))


def migrate_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-16 dumps of both byte orders with a byte order mark, read in splits: words, and whether there were eight splits."""
    o, folder, root = _orders(spark, sf_dir), scratch(spark, "dump-utf16"), scratch(spark, "load")
    text = F.concat(F.lit("INSERT INTO t VALUES ("), F.col("o_orderkey").cast("string"), F.lit(", '中文;\n"), F.col("o_orderpriority"), F.lit("')"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    for k, (charset, mark) in enumerate((("utf-16-le", "FFFE"), ("utf-16-be", "FEFF"))):
        part = o.filter(F.col("o_orderkey") % 2 == k).repartition(2).select(F.concat(
            F.when(first, F.unhex(F.lit(mark))).otherwise(F.unhex(F.lit(""))), encode_text(text, F.lit(charset))).cast("string").alias("value"))
        write_dump(part, f"{folder}/{k}", ";\n".encode(charset).decode("latin1"))
    total = sum(r.file_size for r in list_files(spark, folder).select("file_size").collect())
    migrate.migrate(spark, folder, root, "t", _PAIR, chunk_bytes=max(1000, total // 9))
    target = load.LoadTarget(root, "t")
    splits = load.read_ledger(spark, target).select("file_path", "chunk_id").distinct().count()
    return load.read_table(spark, target, migrate.as_struct(_PAIR)).withColumn("split", F.lit(int(splits >= 8)))


def migrate_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive later hold longer numbers, fractions, times of day, words and a further column: types widen and
    all rows stay readable in them."""
    o, root = _orders(spark, sf_dir), scratch(spark, "load")
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    narrow = F.concat(F.lit("INSERT INTO t (a, b, c, d) VALUES ("), key, F.lit(", "), F.col("o_custkey"), F.lit(", '"), day, F.lit("', "), key, F.lit(")"))
    wide = F.concat(F.lit("INSERT INTO t (a, b, c, d, e) VALUES (9000000000"), F.lpad(key, 8, "0"), F.lit(", "), F.col("o_custkey"), F.lit(".25, '"), day,
                    F.lit(" 10:30:00', 'w"), key, F.lit("', '"), F.col("o_orderpriority"), F.lit("')"))
    for k, line in enumerate((narrow, wide)):
        path = write_dump(o.filter(F.col("o_orderkey") % 2 == k).select(line.alias("value")), scratch(spark, "dump-drift"))
        migrate.migrate(spark, path, root, "t")
    target = load.LoadTarget(root, "t")
    types = ",".join(f.dataType.simpleString() for f in load.table_schema(spark, target))
    return load.read_table(spark, target).withColumn("b", F.col("b").cast("double")).withColumn("types", F.lit(types))


def plan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan of dumps whose first INSERT alone is over 2 MB, one file a region: name, statements shown, DDL, admission."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    long = F.repeat(F.col("n_name"), 200_000)
    row = F.concat(F.lit("("), F.col("n_nationkey").cast("string"), F.lit(", '"), long, F.lit("')"))
    lines = n.select(F.col("n_regionkey").alias("bucket"), F.col("n_nationkey").alias("place"),
                     F.concat(F.lit("-- it's long\nINSERT INTO nation_"), F.col("n_regionkey").cast("string"), F.lit(" (id, name) VALUES "), row, F.lit(", "), row).alias("value"))
    plan = migrate.plan_migration(spark, _write_files(spark, lines, scratch(spark, "dump-plan")), dialect="spark")
    return plan.select(F.substring_index("file_path", "/", -1).alias("file"), "table_name", F.size("preview").alias("n_preview"), "ddl", "error_code")


def ddl_convert_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns whose names, defaults and comments are words of the type map: only types are mapped."""
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), "p_partkey")
    script = F.concat(
        F.lit("CREATE TABLE number (\n number NUMBER(10, 2) DEFAULT 5,\n `double` DOUBLE COMMENT 'INT of DOUBLE, ENGINE=x',\n text VARCHAR2("),
        F.col("p_size"), F.lit(" CHAR) DEFAULT 'CLOB  ("), F.col("p_partkey"),
        F.lit("' NOT NULL,\n \"int\" INT AUTO_INCREMENT,\n rate DOUBLE PRECISION, clob CLOB,\n"
              " CONSTRAINT blob CHECK (number > 1 AND text <> 'DATETIME,'),\n PRIMARY KEY (number, `double`)\n)"
              " ENGINE=InnoDB COMMENT='INT CHARSET=x' DEFAULT CHARSET=utf8;"))
    return p.select("p_partkey", ddl.convert_ddl(script).alias("ddl"))


def publish_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders loaded in two runs of other types, then one file replaced: read by the name that the last load published."""
    o, root, path = _orders(spark, sf_dir), scratch(spark, "load"), scratch(spark, "dump-orders")
    changed = F.when(F.col("o_orderkey") % _BUCKETS == 1, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    whole = F.col("o_totalprice").cast("long")
    narrow = o.withColumn("o_totalprice", whole).filter(F.col("o_orderkey") % _BUCKETS < 2)
    for lines in (_bucketed(narrow), _bucketed(o, changed).filter("bucket <> 0")):
        _write_files(spark, lines, path)
        migrate.migrate(spark, path, root, "orders", on_replaced="replace")
    publish(spark, load.LoadTarget(root, "orders"), "sluice_published_orders")
    return spark.sql("SELECT o_orderkey, o_orderpriority, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM sluice_published_orders")


def migrate_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in and outside of the allowed folder, of allowed and other names: what became of each, and rows loaded."""
    o, root, top = _orders(spark, sf_dir), scratch(spark, "load"), scratch(spark, "dump-admit")
    lines = _bucketed(o).drop("block")  # the SQL beside it names one file a bucket
    _write_files(spark, lines, f"{top}/in")
    _write_files(spark, lines, f"{top}/out")
    write_dump(o.select(insert_text(o, "orders").alias("value")), f"{top}/in/other")
    told = migrate.migrate_files(spark, [top, f"{top}/in/none.sql"], root, admission={"allowed_dirs": [f"{top}/in"]})
    n = _loaded(spark, root, o).agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys"))
    named = told.filter(~F.col("file_path").contains("/part-") & ~F.col("file_path").contains("/_SUCCESS")).select(
        F.substring_index(F.substring_index("file_path", "/", -2), "/", 1).alias("folder"), F.substring_index("file_path", "/", -1).alias("file"), "success")
    return named.join(n, F.col("success"), "left")


QUERIES = {f.__name__: f for f in (
    publish_table, migrate_admitted,
    migrate_utf16, migrate_drift, plan_files, ddl_convert_names,
    migrate_rechunked, migrate_grown_file, migrate_replaced_file, literals_oracle, literals_mysql, scan_directive_quotes, migrate_bad_bytes)}


def _cases(kinds: list[str], rejected: dict[int, str]) -> str:
    """One branch a kind; ``w`` stands for the priority."""
    word = " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds) if i not in rejected)
    why = " ".join(f"WHEN {i} THEN '{r}'" for i, r in rejected.items()) or "WHEN -1 THEN ''"
    return (f"SELECT o_orderkey::BIGINT AS id, CASE k {word} END AS word, CASE k {why} END AS reason "
            f"FROM (SELECT o_orderkey, o_orderpriority AS w, o_orderkey % {len(kinds)} AS k FROM orders)")


_NL = "chr(10)"
ORACLES = {
    "publish_table": """SELECT o_orderkey, o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN trunc(o_totalprice::DECIMAL(18,2))::DOUBLE
        WHEN 1 THEN -o_totalprice::DOUBLE ELSE o_totalprice::DOUBLE END AS o_totalprice FROM orders""",
    "migrate_admitted": """WITH files AS (SELECT DISTINCT 'bucket=' || (o_orderkey % 4) || '.sql' AS file FROM orders),
        n AS (SELECT count(*)::BIGINT AS n_rows, sum(o_orderkey)::BIGINT AS keys FROM orders)
        SELECT 'in' AS folder, file, true AS success, n_rows, keys FROM files, n
        UNION ALL SELECT 'out', file, false, NULL, NULL FROM files UNION ALL SELECT 'in', 'none.sql', false, NULL, NULL""",
    "migrate_rechunked": "SELECT * FROM orders",
    "migrate_grown_file": "SELECT * FROM orders",
    "migrate_replaced_file": """SELECT o_orderkey, o_custkey, o_orderstatus,
        CASE WHEN o_orderkey % 4 = 1 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders""",
    "literals_oracle": _cases([
        f"'it''s ' || w || ';' || {_NL} || 'x'", "'it''s ' || w || ' -- no comment'", "'it''s /* ' || w", "", f"w || '''s' || {_NL} || 'x'",
        "'plain ''' || w || ''''", f"'X;' || {_NL} || w || '\"s ]'' '", "", "w"],
        {3: "unsupported_expression:word", 7: "unsupported_expression:word"}),
    "literals_mysql": _cases([
        f"'it''s ' || w || ';' || {_NL} || 'x'", "'dq \"' || w || '\" ''x'''", "'tab\\t' || chr(9) || w || '\\'", "", "w",
        f"'a;' || {_NL} || 'b'' ' || w", "'don''t 5\\% ' || w", f"w || '\\;' || {_NL}"], {3: "unsupported_expression:word"}),
    "scan_directive_quotes": _cases(["w", "w", f"w || ';' || {_NL}", "w", "w", "w", "w", "w"], {}),
    "migrate_utf16": "SELECT o_orderkey::BIGINT AS id, '中文;' || chr(10) || o_orderpriority AS word, 1 AS split FROM orders",
    "migrate_drift": """SELECT CASE k WHEN 0 THEN o_orderkey ELSE ('9000000000' || lpad(o_orderkey::VARCHAR, 8, '0'))::BIGINT END AS a,
        CASE k WHEN 0 THEN o_custkey::DOUBLE ELSE o_custkey + 0.25::DOUBLE END AS b,
        CASE k WHEN 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP ELSE date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 630 MINUTE END AS c,
        CASE k WHEN 0 THEN o_orderkey::VARCHAR ELSE 'w' || o_orderkey END AS d, CASE k WHEN 1 THEN o_orderpriority END AS e,
        'bigint,decimal(' || (SELECT max(length(o_custkey::VARCHAR)) + 2 FROM orders) || ',2),timestamp_ntz,string,string' AS types
        FROM (SELECT *, o_orderkey % 2 AS k FROM orders)""",
    "plan_files": """SELECT DISTINCT 'bucket=' || n_regionkey || '.sql' AS file, 'nation_' || n_regionkey AS table_name, 1 AS n_preview,
        'CREATE TABLE nation_' || n_regionkey || ' (id INT, name STRING) USING parquet' AS ddl, NULL::VARCHAR AS error_code FROM nation""",
    "ddl_convert_names": """SELECT p_partkey, 'CREATE TABLE number ( number NUMERIC(10,2) DEFAULT 5, `double` DOUBLE PRECISION COMMENT '
        || '''INT of DOUBLE, ENGINE=x'', text VARCHAR(' || p_size || ') DEFAULT ''CLOB  (' || p_partkey
        || ''' NOT NULL, "int" INTEGER , rate DOUBLE PRECISION, clob TEXT, CONSTRAINT blob CHECK (number > 1 AND text <> ''DATETIME,''),'
        || ' PRIMARY KEY (number, `double`) ) COMMENT=''INT CHARSET=x'' ;' AS ddl FROM part""",
    "migrate_bad_bytes": """SELECT '中文' || o_orderpriority AS word, NULL::VARCHAR AS reason, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS ids
        FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1
        UNION ALL SELECT NULL, 'bad_bytes', count(*)::BIGINT, NULL FROM orders WHERE o_orderkey % 5 = 0 HAVING count(*) > 0""",
}
