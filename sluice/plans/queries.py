"""Registered queries: each reads whole driver tables (or dumps Spark writes from them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import ddl, text
from sluice.functions.charset import decode_bytes, encode_text
from sluice.operators import chunks, profile, reconcile, runlog, sampling, values
from sluice.operators.export import export_dump, insert_text, render_inserts, write_dump
from sluice.plans import load, load_queries, migrate
from sluice.plans.catalog import publish
from sluice.session import hold_batches, scratch, spread
from sluice.sources import dumps, encoding, manifest
from sluice.streaming import ingest, status

NL = "\n"


#: schema owner in the rendered dumps
OWNERS = ("APP_OWNER",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dump(spark: SparkSession, sf_dir: str, name: str) -> str:
    return export_dump(table(spark, sf_dir, name), name, scratch(spark, f"dump-{name}"))


def _noisy_orders(spark: SparkSession, sf_dir: str) -> str:
    """Orders dump with comments (odd apostrophes too), directives, blank lines, and inner line breaks."""
    o = table(spark, sf_dir, "orders")
    noise = (
        F.when(F.col("o_orderstatus") == "F", "-- it's a comment\nPROMPT loading\n\nSET DEFINE OFF\n")
        .when(F.col("o_orderstatus") == "P", "/* block; comment */\nREM more\n").otherwise("")
    )
    broken = F.when(F.col("o_orderpriority") == "1-URGENT", F.regexp_replace(insert_text(o, "orders"), " VALUES ", "\n VALUES\n "))
    return write_dump(
        o.select(F.concat(noise, broken.otherwise(insert_text(o, "orders"))).alias("value")), scratch(spark, "dump-noisy"))


def _stmts(spark: SparkSession, sf_dir: str, name: str, *keep: str) -> DataFrame:
    return render_inserts(table(spark, sf_dir, name), name, keep)


# ---- round trips -----------------------------------------------------------------------------------------

def _roundtrip(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = table(spark, sf_dir, name).schema
        stmts = dumps.read_statements(spark, _dump(spark, sf_dir, name))
        return values.good_rows(values.typed_rows(stmts, schema))

    return run


def roundtrip_broken_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals that hold the statement end: every sentence end of a document becomes ``';`` + newline."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit(". "), F.lit("';\n")).alias("text"))
    path = export_dump(d, "documents", scratch(spark, "dump-broken"))
    stmts = dumps.read_statements(spark, path, chunk_bytes=1 << 20)
    return values.good_rows(values.typed_rows(stmts, d.schema))


# ---- statements ------------------------------------------------------------------------------------------

def stmt_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stmts = dumps.read_statements(spark, _noisy_orders(spark, sf_dir))
    return stmts.select(text.collapse_blanks(F.col("stmt")).alias("stmt"))


def insert_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stmts(spark, sf_dir, "customer", "c_mktsegment", "c_custkey")
    first = sampling.first_inserts(c, 10, file="c_mktsegment", order="c_custkey")
    return first.select("c_mktsegment", "n", "stmt")


def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("orders", "documents", "conversations"):
        records = dumps.read_records(spark, _dump(spark, sf_dir, name)).withColumn("source", F.lit(name))
        one = sampling.count_lines(records, "source")
        out = one if out is None else out.unionByName(one)
    return out


def line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("lang") == "fr", "PROMPT ").when(F.col("lang") == "de", "  -- ").when(F.col("lang") == "es", "set ")
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.split("text", NL)).alias("l"), head.alias("h")
    ).select("doc_id", F.concat(F.coalesce("h", F.lit("")), "l").alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count_if(text.is_sql_line(F.col("line"))).alias("kept"), F.count_if(~text.is_sql_line(F.col("line"))).alias("dropped"))


def stmt_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    owner = F.when(F.col("o_orderstatus") == "F", "APP_OWNER.orders").when(
        F.col("o_orderstatus") == "P", "[APP_OWNER].orders").otherwise("mydb.orders")
    command = F.when(F.col("o_orderpriority") == "1-URGENT", "DEFINE x = 1").when(
        F.col("o_orderpriority") == "2-HIGH", "SELECT 1 FROM dual").otherwise(insert_text(o, owner))
    raw = o.select("o_orderkey", F.concat(F.lit("  "), command, F.lit(" ;")).alias("stmt"))
    return raw.select("o_orderkey", text.clean_statement(F.col("stmt"), OWNERS).alias("stmt")).filter("stmt IS NOT NULL")


def format_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    head = F.when(F.col("role") == "user", "insert  into t values (").otherwise("INSERT INTO t VALUE ")
    return c.select("conv_id", "turn", text.has_insert_format(F.concat(head, "text")).cast("int").alias("ok"))


def values_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.explode_values(_stmts(spark, sf_dir, "orders", "o_orderkey"), ["o_orderkey"]).select(
        "o_orderkey", "pos", "raw")


def column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = values.column_lists(_stmts(spark, sf_dir, "customer"))
    return named.groupBy("pos", "column_name").agg(F.count("*").alias("n"))


def table_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    form = F.when(F.col("o_orderstatus") == "F", '"orders_f"').when(
        F.col("o_orderstatus") == "P", "`orders_p`").otherwise("shop.orders_o")
    stmt = F.when(F.col("o_orderpriority") == "1-URGENT", "UPDATE orders SET x = 1").otherwise(insert_text(o, form))
    return o.select("o_orderkey", F.coalesce(text.insert_table_name(stmt), F.lit("")).alias("table_name"))


def file_table_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.file_table_name(F.col("url")).alias("table_name"))


def qualifier_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    stmt = insert_text(c, F.concat(F.lit("db_"), F.lower("c_mktsegment"), F.lit(".customer")))
    return c.select("c_custkey", text.strip_insert_qualifier(stmt).alias("stmt"))


def line_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.translate("text", ".,:;()", "。，：；（）")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(wide, NL)).alias("line_no", "l"))
    return lines.select("doc_id", "line_no", text.normalise_line(F.concat(F.lit("﻿ \x07 "), "l")).alias("line"))


def date_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    stmt = F.concat(
        F.lit("INSERT INTO orders VALUES ("), F.col("o_orderkey"), F.lit(", '"), F.col("o_orderdate").cast("date"),
        F.lit("', '"), F.col("o_orderdate").cast("string"), F.lit("', null, 'null at "), F.col("o_orderdate").cast("date"),
        F.lit("')"))
    return o.select("o_orderkey", text.type_date_literals(stmt).alias("stmt"))


# ---- DDL scripts -----------------------------------------------------------------------------------------

def _part_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dirty CREATE TABLE script per part."""
    script = F.concat(
        F.lit("USE shop;\nCREATE TABLE APP_OWNER.part_"), F.col("p_partkey"),
        F.lit(" (\n  id NUMBER(10) PRIMARY KEY,\n  size_no INT,\n  name VARCHAR2("), F.col("p_size"),
        F.lit(" CHAR),\n  price NUMBER(10, 2),\n  made DATETIME,\n  note CLOB,\n  weight DOUBLE,\n) ENGINE=InnoDB DEFAULT CHARSET=utf8;"))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", script.alias("script"))


def ddl_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_ddl(spark, sf_dir).select("p_partkey", ddl.clean_ddl(F.col("script"), OWNERS).alias("ddl"))


def ddl_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _part_ddl(spark, sf_dir).select("p_partkey", ddl.clean_ddl(F.col("script"), OWNERS).alias("c"))
    return cleaned.select("p_partkey", ddl.convert_ddl(F.col("c")).alias("ddl"))


def ddl_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _part_ddl(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey")
    script = F.when(F.col("p_type") == "ECONOMY", F.col("script")).when(
        F.col("p_type") == "STANDARD", "CREATE TABLE IF NOT EXISTS `t_x` (a INT)").otherwise(ddl.clean_ddl(F.col("script"), OWNERS))
    return c.select("p_partkey", ddl.is_valid_ddl(script).cast("int").alias("ok"), ddl.ddl_table_name(script).alias("name"))


def ddl_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    create = F.concat(F.lit("CREATE TABLE t_"), "conv_id", F.lit(" (id INT, turn_"), "turn", F.lit(" INT)"))
    answer = (
        F.when(F.col("turn") == 0, F.concat(F.col("text"), F.lit("\n```sql\n"), create, F.lit("\n```\n"), F.col("text")))
        .when(F.col("turn") == 1, F.concat(F.col("text"), F.lit("\n```\n"), create, F.lit(";\n```\n"), F.col("text")))
        .when(F.col("turn") == 2, F.concat(F.col("text"), F.lit(" so: "), create, F.lit("; done")))
        .otherwise(F.col("text")))
    return c.select("conv_id", "turn", ddl.extract_ddl(answer).alias("ddl"))


# ---- samples and estimates -------------------------------------------------------------------------------

def _customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stmts(spark, sf_dir, "customer", "c_mktsegment", "c_custkey").withColumnRenamed("stmt", "line")


def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = sampling.head_sample(_customer_lines(spark, sf_dir), file="c_mktsegment", order="c_custkey")
    return sample.select("c_mktsegment", "c_custkey", "line_no", "line")


def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _stmts(spark, sf_dir, "orders", "o_orderpriority", "o_orderstatus", "o_orderkey").withColumnRenamed("stmt", "line")
    sample = sampling.spread_sample(lines, 4, file="o_orderpriority", region="o_orderstatus", order="o_orderkey")
    return sample.select("o_orderpriority", "o_orderstatus", "o_orderkey", "line_no")


def stmt_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    stmts = d.select("source", "doc_id", insert_text(d.select("doc_id", "text"), "documents").alias("stmt"))
    return sampling.preview_statements(stmts, "source", "doc_id").select("source", "n", "preview")


def row_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _customer_lines(spark, sf_dir)
    sizes = lines.groupBy("c_mktsegment").agg(F.sum(F.octet_length("line") + 1).alias("file_size"))
    sample = sampling.head_sample(lines, file="c_mktsegment", order="c_custkey")
    return sampling.estimate_rows(sample, sizes, "c_mktsegment")


def density_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as files, documents as blocks of them: up to ten evenly spaced documents are probed."""
    d = table(spark, sf_dir, "documents").select(
        "source", "doc_id", F.octet_length("text").alias("b"),
        (F.length("text") - F.length(F.replace("text", F.lit(NL), F.lit("")))).alias("lines"))
    sizes = d.groupBy("source").agg(F.sum("b").alias("file_size"), F.count("*").alias("n_blocks"))
    placed = chunks.running_totals(d, ["source"], ["doc_id"], {"pos": F.lit(1)}).join(sizes, "source")
    step = F.greatest(F.floor(F.col("n_blocks") / sampling.PROBES), F.lit(1))
    probes = placed.filter((F.pmod(F.col("pos") - 1, step) == 0) & ((F.col("pos") - 1) / step < sampling.PROBES))
    return sampling.density_estimate(
        probes.select("source", "file_size", F.col("b").alias("probe_bytes"), F.col("lines").alias("probe_lines")), "source")


def chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _customer_lines(spark, sf_dir).withColumn("size", F.octet_length("line") + 1)
    cut = chunks.chunk_by_bytes(lines, F.col("size"), 16 * 1024, ["c_mktsegment"], ["c_custkey"])
    return cut.groupBy("c_mktsegment", "chunk_no").agg(
        F.count("*").alias("n_statements"), F.sum("size").alias("n_bytes"), F.min("c_custkey").alias("first_key"))


def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _stmts(spark, sf_dir, "orders", "o_orderpriority", "o_orderkey")
    cut = chunks.batch_by_count(o, file=["o_orderpriority"], order=["o_orderkey"])
    return cut.groupBy("o_orderpriority", "batch_no").agg(
        F.count("*").alias("n_statements"), F.min("o_orderkey").alias("first_key"), F.max("pos").alias("last_pos"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("lang") == "en", " insert ").when(F.col("lang") == "de", "中文 ").otherwise("")
    lines = table(spark, sf_dir, "documents").select(
        "source", F.explode(F.split("text", NL)).alias("l"), head.alias("h")
    ).select("source", F.concat("h", "l").alias("line"))
    gate = sampling.quality_gate(lines, "source")
    return gate.withColumn("passes", F.col("passes").cast("int"))


# ---- encodings -------------------------------------------------------------------------------------------

def _encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the bytes of a small dump: French ones in GBK (accents become a CJK character),
    German ones in UTF-16, others in UTF-8."""
    hold_batches(spark)
    d = table(spark, sf_dir, "documents")
    body = F.when(F.col("lang") == "fr", F.regexp_replace("text", r"[^\x00-\x7F]", "测")).otherwise(F.col("text"))
    dump = F.concat(F.lit("INSERT INTO documents VALUES ("), "doc_id", F.lit(", '"), body, F.lit("');\n"))
    charset = F.when(F.col("lang") == "fr", "gbk").when(F.col("lang") == "de", "utf-16").otherwise("utf-8")
    return d.select("doc_id", encode_text(dump, charset).alias("head"))


def encoding_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.detect_charset(_encoded_documents(spark, sf_dir)).select("doc_id", "encoding")


def encoding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.fallback_charset(_encoded_documents(spark, sf_dir)).select(
        "doc_id", "used_encoding", F.col("ignore_errors").cast("int").alias("ignore_errors"))


def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    hold_batches(spark)
    d = table(spark, sf_dir, "documents")
    charset = F.when(F.col("lang") == "en", "utf-8").when(F.col("lang") == "de", "utf-16").when(
        F.col("lang") == "fr", "latin1").otherwise("gb18030")
    coded = d.select("doc_id", charset.alias("charset"), encode_text("text", charset).alias("data"))
    return coded.select("doc_id", decode_bytes(F.col("data"), F.col("charset")).alias("text"))


# ---- profile and inference -------------------------------------------------------------------------------

INFERRED = ("orders", "part", "lineitem", "events", "customer")


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = profile.named_values(_stmts(spark, sf_dir, "orders"))
    stats = profile.profile_values(named)
    return stats.join(profile.sample_values(named), ["table_name", "column_name"]).select(
        "table_name", "column_name", "pos", "n", "n_null", "max_len", "min_text", "max_text", "samples")


def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    stmts = None
    for name in INFERRED:
        one = _stmts(spark, sf_dir, name)
        stmts = one if stmts is None else stmts.unionByName(one)
    return profile.infer_schema(stmts)


def ddl_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = profile.infer_schema(_stmts(spark, sf_dir, "orders").unionByName(_stmts(spark, sf_dir, "customer")))
    out = None
    for dialect in ("doris", "postgresql"):
        one = profile.render_ddl(schema, dialect).withColumn("dialect", F.lit(dialect))
        out = one if out is None else out.unionByName(one)
    return out.select("dialect", "table_name", "ddl")


def override_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = migrate.as_struct(
        "o_orderkey string, o_custkey int, o_orderstatus string, o_totalprice decimal(12,2), o_orderdate date, "
        "o_orderpriority string")
    rows = values.good_rows(values.typed_rows(dumps.read_statements(spark, _dump(spark, sf_dir, "orders")), schema))
    return rows.withColumn("o_totalprice", F.col("o_totalprice").cast("double")).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("string"))


# ---- files -----------------------------------------------------------------------------------------------

def manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three dumps, summed up by source (part files differ from run to run, their total does not)."""
    out = None
    for name in ("orders", "customer", "supplier"):
        one = manifest.manifest(spark, _dump(spark, sf_dir, name)).withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("source", "extension").agg(F.sum("file_size").alias("total_bytes"))


def admit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    name = F.concat(F.regexp_replace("url", r"^https?://|[^A-Za-z0-9/.]", ""), F.when(F.col("url").contains("page"), ".sql").otherwise(".txt"))
    path = (
        F.when(F.col("url").contains("?q="), "")
        .when(F.col("url").contains("/en"), F.concat(F.lit("/data/dumps/../secret/"), name))
        .when(F.col("url").contains("/de"), F.concat(F.lit("/data/dumps/"), F.repeat(name, F.lit(12))))
        .otherwise(F.concat(F.lit("/data/./dumps//a/../"), name)))
    files = p.select(
        "page_id", path.alias("path"), (~F.col("url").contains("ref")).alias("is_file"), F.lit(True).alias("readable"),
        (F.length("html").cast("long") * 1024 * 1024).alias("file_size"))
    out = manifest.admit(files, allowed_dirs=["/data/dumps"])
    return out.select("page_id", F.coalesce("error_code", F.lit("OK")).alias("error_code"), "normalized_path")


# ---- loads -----------------------------------------------------------------------------------------------

def load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create and load twice: dropped and recreated, then skipped because it exists."""
    schema = table(spark, sf_dir, "orders").schema
    rows = values.good_rows(values.typed_rows(dumps.read_statements(spark, _dump(spark, sf_dir, "orders")), schema))
    at = scratch(spark, "table")
    name = "sluice_" + at.rsplit("-", 1)[-1]
    load.create_and_load(rows, name, "overwrite", at)
    load.create_and_load(rows.limit(0), name, "ignore", at)
    out = spark.table(name)
    return out


def _load_orders(spark: SparkSession, sf_dir: str, times: int) -> tuple[load.LoadTarget, T.StructType]:
    schema = table(spark, sf_dir, "orders").schema
    path, root = _dump(spark, sf_dir, "orders"), scratch(spark, "load")
    for _ in range(times):
        migrate.migrate(spark, path, root, "orders", schema, chunk_bytes=1 << 20)
    return load.LoadTarget(root, "orders"), schema


def load_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same dump loaded twice through the ledger: the second run finds nothing to do."""
    target, schema = _load_orders(spark, sf_dir, 2)
    return load.read_table(spark, target, schema)


def load_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, _ = _load_orders(spark, sf_dir, 1)
    log = load.batch_log(load.read_ledger(spark, target))
    return runlog.import_summary(log).select("table_name", "failed_tasks", "total_rows_imported",
                                             F.col("success").cast("int").alias("success"))


def migrate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dump folder with three tables in the same files, schema inferred, all loaded."""
    lines = None
    for name in ("orders", "customer", "nation"):
        df = table(spark, sf_dir, name)
        one = df.select(insert_text(df, name).alias("value"))
        lines = one if lines is None else lines.unionByName(one)
    path = write_dump(lines.repartition(3), scratch(spark, "dump-mixed"))
    return migrate.migrate(spark, path, scratch(spark, "load")).select(
        "table_name", "total_rows_imported", "rejected_rows", F.col("success").cast("int").alias("success"))


def table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = reconcile.table_info(table(spark, sf_dir, "lineitem"), "lineitem")
    return info.withColumn("nullable", F.col("nullable").cast("int"))


def reconcile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements read per table against rows of the tables; lineitem has no dump."""
    stmts = _stmts(spark, sf_dir, "orders").unionByName(_stmts(spark, sf_dir, "customer"))
    source = values.with_table_names(stmts).groupBy("table_name").agg(F.count("*").alias("n"))
    target = None
    for name in ("orders", "customer", "lineitem"):
        one = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        target = one if target is None else target.unionByName(one)
    out = reconcile.reconcile_counts(source, target)
    return out.withColumn("matches", F.col("matches").cast("int"))


def reconcile_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ between orders and its reloaded copy whose urgent orders lost a cent."""
    o = table(spark, sf_dir, "orders")
    changed = o.withColumn("o_totalprice", F.when(
        F.col("o_orderpriority") == "1-URGENT", F.lit(1.5)).otherwise(F.col("o_totalprice")))
    loaded = values.good_rows(values.typed_rows(render_inserts(changed, "orders"), o.schema))
    return reconcile.content_difference(o, loaded).select("side", "o_orderkey", "o_totalprice")


def resume_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as chunks of orders; those with a pending order are logged as completed."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "chunk_id")
    ledger = o.filter("o_orderstatus = 'P'").select("chunk_id", F.lit("completed").alias("status"))
    return chunks.pending_chunks(o, ledger, ["chunk_id"]).select("o_orderkey", "chunk_id")


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    good = insert_text(o, "orders")
    bad = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.regexp_replace(good, r", '1-URGENT'\)$", ")"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.regexp_replace(good, r"VALUES \((\d+), ", "VALUES ('x$1', "))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("DELETE FROM orders")).otherwise(good))
    typed = values.typed_rows(o.select(F.concat(bad, F.lit(";")).alias("stmt")), o.schema)
    return values.rejected_rows(typed).groupBy("reason").agg(F.count("*").alias("n"), F.max("raw").alias("max_raw"))


def _tricky_orders(spark: SparkSession, sf_dir: str) -> str:
    """Orders of two columns, written in ways that a load must not lose: two on a line behind a directive, expressions,
    quoted and odd names, another table's DELETE, a call that is no literal, and an INSERT without values."""
    o = table(spark, sf_dir, "orders")
    key, word = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    kinds = [
        F.concat(F.lit("SET x; INSERT INTO mixed VALUES ("), key, F.lit(", '"), word, F.lit("'); INSERT INTO mixed VALUES (-"), key, F.lit(", '"), word, F.lit("')")),
        F.concat(F.lit("INSERT INTO mixed VALUES ("), key, F.lit(", 'a' || CHR(10) || N'"), word, F.lit("')")),
        F.concat(F.lit("INSERT INTO \"Odd $ name\" VALUES ("), key, F.lit(")")),
        F.concat(F.lit("DELETE FROM mixed WHERE id = "), key),
        F.concat(F.lit("INSERT INTO mixed VALUES ("), key, F.lit(", UPPER('"), word, F.lit("'))")),
        F.concat(F.lit("INSERT INTO unread SELECT "), key, F.lit(" FROM dual")),
    ]
    line = F.get(F.array(*kinds), (F.col("o_orderkey") % len(kinds)).cast("int"))
    return write_dump(o.select(line.alias("value")).repartition(3), scratch(spark, "dump-tricky"))


def migrate_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement is loaded or rejected: one row per table, ``_unassigned`` included."""
    return migrate.migrate(spark, _tricky_orders(spark, sf_dir), scratch(spark, "load")).select(
        "table_name", "total_rows_imported", "rejected_rows", F.col("success").cast("int").alias("success"))


def literal_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and rejects of one table whose texts are expressions."""
    schema = migrate.as_struct("id bigint, word string")
    stmts = dumps.read_statements(spark, _tricky_orders(spark, sf_dir))
    own = stmts.filter(text.insert_table_name(F.col("stmt")) == "mixed")
    typed = values.typed_rows(own, schema)
    return typed.select("id", F.when(F.col("_reason").isNull(), F.col("word")).alias("word"), F.col("_reason").alias("reason"))


def fallback_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lossless and the generic schema of a table whose types are not to be guessed."""
    profiled = profile.profile_values(profile.named_values(_stmts(spark, sf_dir, "orders")), text_stats=False)
    kinds = [profile.fallback_schema(profiled, k).withColumn("kind", F.lit(k)) for k in ("text", "generic")]
    return kinds[0].unionByName(kinds[1])


def dump_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stmts(spark, sf_dir, "orders", "o_orderkey")


# ---- run log ---------------------------------------------------------------------------------------------

def _batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as batches: user = table, errors = failed batches, value = seconds."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("task_id"), F.concat(F.lit("t_"), F.col("user_id")).alias("table_name"), "ts",
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.length("props").cast("long").alias("affected_rows"), F.col("value").alias("seconds"),
        F.col("props").alias("error_message"))


_STATES = [("signup", "pending"), ("view", "waiting_confirmation"), ("click", "importing"), ("purchase", "completed"),
           ("error", "failed")]


def _task_log(events: DataFrame) -> DataFrame:
    state = F.when(F.col("value") > 450, "cancelled")
    for event, name in _STATES:
        state = state.when(F.col("event_type") == event, name)
    return events.select(F.col("user_id").alias("task_id"), "ts", "event_id", state.alias("status"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _task_log(table(spark, sf_dir, "events"))


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = runlog.import_summary(_batch_log(spark, sf_dir))
    return s.withColumn("success", F.col("success").cast("int"))


def import_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.import_errors(_batch_log(spark, sf_dir))


def progress_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = runlog.progress(_batch_log(spark, sf_dir))
    return p.select("task_id", "table_name", "completed_tasks", "failed_tasks", "total_tasks", "progress_percent")


def multi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _batch_log(spark, sf_dir).withColumn("file_path", F.concat("table_name", F.lit("/"), F.col("ts").cast("date")))
    outcomes = runlog.file_outcomes(log)
    return runlog.outcome_totals(outcomes)


def file_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _batch_log(spark, sf_dir).withColumn("file_path", F.concat("table_name", F.lit("/"), F.col("ts").cast("date")))
    return runlog.file_outcomes(log).withColumn("success", F.col("success").cast("int"))


def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").cast("string").alias("config"), F.col("event_type").alias("variant"),
        F.col("value").alias("seconds"), (F.length("props") > 8).alias("ok"))
    return runlog.metrics_rollup(m, baseline="view")


def task_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.latest_status(_tasks(spark, sf_dir))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.status_events(runlog.latest_status(_tasks(spark, sf_dir))).select("task_id", "status", "event")


def status_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.status_overview(runlog.latest_status(_tasks(spark, sf_dir)))


def task_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.task_duration(_tasks(spark, sf_dir)).select("task_id", "seconds")


def drop_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.drop_cancelled(_tasks(spark, sf_dir)).select("task_id", "event_id", "status")


# ---- streams ---------------------------------------------------------------------------------------------

def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "customer").schema
    target = scratch(spark, "stream")
    ingest.ingest_stream(
        spark, _dump(spark, sf_dir, "customer"), schema, target, scratch(spark, "stream-state")).awaitTermination()
    return ingest.read_ingested(spark, target, schema)


#: tables of a mixed dump: key, text and amount
MIXED = {"customer": ("c_custkey", "c_name", "c_acctbal"), "supplier": ("s_suppkey", "s_name", "s_acctbal"),
         "orders": ("o_orderkey", "o_orderstatus", "o_totalprice")}


def stream_ingest_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold statements of three tables arrive in a stream, two a batch; each table is read by its name."""
    root, folder = scratch(spark, "stream"), scratch(spark, "dump-mixed")
    stmts = [_stmts(spark, sf_dir, t).select("stmt") for t in MIXED]
    lines = stmts[0].unionByName(stmts[1]).unionByName(stmts[2])
    write_dump(lines.select(F.regexp_replace("stmt", r";\z", "").alias("value")).repartition(5), folder)
    ingest.ingest_tables(spark, folder, root, scratch(spark, "stream-state"), max_files=2, pattern="part-*").awaitTermination()
    parts = [load.read_table(spark, load.LoadTarget(root, t)).select(
        F.lit(t).alias("table_name"), F.col(k).cast("long").alias("key"), F.col(name).alias("name"), F.col(amount).cast("double").alias("amount"))
        for t, (k, name, amount) in MIXED.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    target = scratch(spark, "status")
    status.status_stream(_task_log(events), target, scratch(spark, "status-state")).awaitTermination()
    return status.read_status(spark, target).select("task_id", "status", "last_update", "n_events")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dump -> statements -> inferred schema -> loaded table -> SQL over it."""
    path, root = _dump(spark, sf_dir, "orders"), scratch(spark, "load")
    stmts = dumps.read_statements(spark, path)
    schema = migrate.schemas_of(profile.infer_schema(stmts))["orders"]
    migrate.migrate(spark, path, root, "orders", schema)
    publish(spark, load.LoadTarget(root, "orders"), "sluice_orders", schema)
    return spark.sql("SELECT o_orderstatus, count(*) AS n_orders, CAST(sum(o_totalprice) AS DOUBLE) AS total_price "
                     "FROM sluice_orders GROUP BY o_orderstatus")


ROUNDTRIPS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
              "conversations")

QUERIES = {f"roundtrip_{name}": _roundtrip(name) for name in ROUNDTRIPS}
QUERIES.update({
    f.__name__.removesuffix("_query"): f for f in (
        roundtrip_broken_literals, stmt_scan, insert_extract, line_count, line_filter, stmt_clean, format_check,
        values_parse, column_list, table_name, file_table_name, qualifier_strip, line_normalise, date_literals,
        ddl_clean, ddl_convert, ddl_valid, ddl_extract, head_sample, spread_sample, stmt_preview, row_estimate,
        density_estimate, chunk_bytes, batch_rows, quality_gate, encoding_detect, encoding_fallback, decode_text,
        column_profile, infer_types, ddl_render, override_schema, manifest_query, admit_files, load_table, load_append,
        load_ledger, migrate_tables, migrate_mixed, literal_expressions, fallback_schema, table_info, reconcile_query, reconcile_content, resume_chunks, rejects, dump_export,
        import_summary, import_errors, progress_running, multi_file, file_outcomes, metrics_rollup, task_latest,
        status_events, status_overview, task_duration, drop_cancelled, stream_ingest, stream_ingest_tables,
        stream_status,
    )
})
QUERIES.update(load_queries.QUERIES)
QUERIES["flagship"] = flagship
