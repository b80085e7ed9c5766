"""Loads: ledger, resume, rejects, catalog tables, JDBC, files and admission, run log, streams."""

import time

import pytest
from pyspark.sql import functions as F

from sluice.operators.chunks import chunk_by_bytes
from sluice.operators.runlog import import_summary
from sluice.plans import load
from sluice.plans.migrate import as_struct, migrate, migrate_files, plan_migration
from sluice.sources import manifest
from sluice.sources.ranges import list_files
from tests.conftest import write

USERS = "".join(
    f"INSERT INTO users (id, name, created, score) VALUES ({i}, 'user {i}', TO_DATE('2023-01-15 10:30:00', 'YYYY-MM-DD HH24:MI:SS'), {i}.50);\n"
    for i in range(1, 401))
SCHEMA = "id int, name string, created timestamp_ntz, score decimal(6,2)"


def test_resume_loads_only_what_is_missing(spark, folder, monkeypatch):
    dumps, root = write(folder, "users.sql", USERS), folder + "/out"
    target = load.LoadTarget(root, "users")
    real = load._write_run

    def fail_after_data(df, path):
        real(df.filter(F.col("id") <= 100), path)
        raise RuntimeError("lost")

    monkeypatch.setattr(load, "_write_run", fail_after_data)
    with pytest.raises(RuntimeError):
        migrate(spark, dumps, root, "users", SCHEMA, chunk_bytes=8192)
    assert {r.status for r in load.read_ledger(spark, target).collect()} == {"failed"}
    monkeypatch.setattr(load, "_write_run", real)
    migrate(spark, dumps, root, "users", SCHEMA, chunk_bytes=8192)
    write(folder, "users2.sql", USERS.replace("VALUES (", "VALUES (1"))
    summary = migrate(spark, [dumps, folder + "/users2.sql"], root, "users", SCHEMA, chunk_bytes=8192).first()
    rows = load.read_table(spark, target, as_struct(SCHEMA))
    assert (rows.count(), rows.distinct().count()) == (800, 800)
    done = load.read_ledger(spark, target).filter("status = 'completed'")
    assert done.agg(F.sum("affected_rows")).first()[0] == 800
    assert done.select("file_path", "chunk_id").distinct().count() == done.count() > 4
    assert summary.total_rows_imported == 800 and summary.failed_tasks == 0 and summary.success


def test_rejects_are_kept_aside(spark, folder):
    path = write(folder, "users.sql", USERS + "INSERT INTO users VALUES (1, 'x');\nINSERT INTO users VALUES ('a', 'x', NULL, 1);\n")
    summary = migrate(spark, path, folder + "/out", "users", SCHEMA).first()
    assert (summary.total_rows_imported, summary.rejected_rows) == (400, 2)
    refused = load.read_rejects(spark, load.LoadTarget(folder + "/out", "users")).collect()
    assert sorted(r.reason for r in refused) == ["arity_mismatch", "bad_value:id"]


def test_migrate_infers_several_tables_and_files(spark, folder):
    write(folder, "one.sql", USERS)
    write(folder, "two.sql", "INSERT INTO db.items VALUES (1, '2024-01-01');\nINSERT INTO users (id, name) VALUES (999, 'it''s;\nme');\n")
    summary = {r.table_name: r for r in migrate(spark, folder, folder + "/../out-" + folder.rsplit("/", 1)[-1]).collect()}
    assert {t: r.total_rows_imported for t, r in summary.items()} == {"users": 401, "items": 1}
    files = migrate_files(spark, folder, folder + "/../out2-" + folder.rsplit("/", 1)[-1]).collect()
    assert sorted((f.file_path.rsplit("/", 1)[-1], f.success) for f in files) == [("one.sql", True), ("two.sql", True)]


def test_catalog_tables(spark, folder):
    load.create_database(spark, "sluice_t", folder + "/db")
    schema = as_struct("a int, b string")
    assert load.create_table(spark, "sluice_t.x", schema, location=folder + "/x") is True
    assert load.create_table(spark, "sluice_t.x", schema) is False
    rows = spark.createDataFrame([(1, "a")], schema)
    assert load.create_and_load(rows, "sluice_t.x", "append") and load.create_and_load(rows, "sluice_t.x", "append")
    assert spark.table("sluice_t.x").count() == 2
    assert load.create_and_load(rows, "sluice_t.x", "ignore") is False
    load.drop_table(spark, "sluice_t.x")
    assert not spark.catalog.tableExists("sluice_t.x")


def test_plan_reads_heads_only(spark, folder):
    write(folder, "users.sql", USERS)
    write(folder, "note.txt", "nothing")
    plan = {r.file_path.rsplit("/", 1)[-1]: r for r in plan_migration(spark, folder, allowed_dirs=[folder]).collect()}
    assert plan["note.txt"].error_code == "PATH_001" and plan["users.sql"].error_code is None
    users = plan["users.sql"]
    assert users.table_name == "users" and len(users.preview) == 5 and "name VARCHAR(" in users.ddl
    assert abs(users.estimated_rows - 400) < 20


def test_plan_of_statements_over_several_lines(spark, folder):
    write(folder, "x.sql", "-- c\nINSERT INTO test_table (id, name, description) VALUES\n(1, '张三', '一;\n二'),\n(2, '李四', 'b'),\n(3, '王五', 'c');\n")
    row = plan_migration(spark, folder, dialect="spark").first()
    assert (row.table_name, row.ddl) == (
        "test_table", "CREATE TABLE test_table (id INT, name STRING, description STRING) USING parquet")
    assert len(row.preview) == 1


def test_estimates_on_files(spark, folder):
    write(folder, "users.sql", USERS)
    files = list_files(spark, folder)
    for rows in (manifest.quick_line_estimate(files), manifest.estimate_by_density(files), manifest.estimate_by_sample(files)):
        assert 340 < rows.first().estimated_rows < 480
    spread = manifest.spread_lines(files, 4)
    assert spread.groupBy("region").count().count() == 4
    assert spread.filter(~F.col("line").startswith("INSERT")).count() == 0


def test_admission(spark):
    cases = [("/d/a.sql", True, True, 10, None), ("/d/a.sql", False, True, 10, "PATH_003"), ("/d/a.txt", True, True, 10, "PATH_001"),
             ("/e/a.sql", True, True, 10, "PATH_002"), ("/d/../e/a.sql", True, True, 10, "PATH_002"), ("", True, True, 10, "PATH_001"),
             (None, True, True, 10, "PATH_001"), ("/d/" + "x" * 300, True, True, 10, "PATH_001"), ("/d/a.sql", True, False, 10, "PATH_004"),
             ("/d/a.SQL", True, True, 3 << 30, "PATH_005"), ("/dd/a.sql", True, True, 1, "PATH_002")]
    df = spark.createDataFrame([c[:4] for c in cases], "path string, is_file boolean, readable boolean, file_size long")
    assert [r.error_code for r in manifest.admit(df, allowed_dirs=["/d"]).collect()] == [c[4] for c in cases]
    assert {r.error_code for r in manifest.admit(df, enabled=False).collect()} == {"FEATURE_DISABLED"}


def test_hot_key_prefix_sums(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("file_path"),
        F.col("id").alias("ord"), F.lit(0).alias("block_start"), F.lit(0).alias("sub"), F.lit(10).alias("size"))
    cut = chunk_by_bytes(df, F.col("size"), 1000)
    hot = cut.filter("file_path = 'hot'").groupBy("chunk_no").count().collect()
    assert len(hot) == 67 and max(r["count"] for r in hot) == 100


def test_summary_of_a_table_without_success(spark):
    log = spark.createDataFrame([("t", "1", "failed", 5, 0.0, "x")], "table_name string, task_id string, status string, affected_rows long, seconds double, error_message string")
    row = import_summary(log).first()
    assert (row.total_rows_imported, row.success, row.rows_per_second) == (0, False, 0.0)


def test_every_statement_is_loaded_or_rejected(spark, folder):
    """Odd names, other tables, no INSERT, unreadable tables, a stray longer tuple, two statements on a line."""
    write(folder, "mixed.sql", (
        "INSERT INTO \"my tab\" VALUES (1, 'a');\nINSERT INTO SYS$X.T#1 VALUES (2);\nINSERT INTO t2 SELECT * FROM x;\nDELETE FROM users;\n"
        "INSERT INTO users VALUES (1,'a'); INSERT INTO users VALUES (2,'b');\nSET x; INSERT INTO users VALUES (3,'c');\n"
        "INSERT INTO users VALUES (4,'d',9);\nINSERT INTO 007 VALUES (7);\nINSERT INTO users VALUES (5, 'a'||chr(10)||N'b');\n"
        "INSERT INTO users VALUES (6, TO_CLOB('x')||EMPTY_CLOB());\nINSERT INTO users VALUES (8, UPPER('x'));\n"
        "INSERT INTO users VALUES (12345678901, 'z');\n"
    ))
    root = folder + "/../mixed-" + folder.rsplit("/", 1)[-1]
    summary = {r.table_name: (r.total_rows_imported, r.rejected_rows, r.success) for r in migrate(spark, folder, root).collect()}
    assert summary == {"my tab": (1, 0, True), "T#1": (1, 0, True), "t2": (0, 1, True), "007": (1, 0, True), "users": (6, 2, True), "_unassigned": (0, 1, True)}
    schema = as_struct("c1 bigint, c2 string")
    rows = load.read_table(spark, load.LoadTarget(root, "users"), schema).collect()
    assert sorted((r.c1, r.c2) for r in rows) == [(1, "a"), (2, "b"), (3, "c"), (5, "a\nb"), (6, "x"), (12345678901, "z")]
    reasons = sorted(r.reason for r in load.read_rejects(spark, load.LoadTarget(root, "users")).collect())
    assert reasons == ["arity_mismatch", "unsupported_expression:c2"]
    one = migrate(spark, folder, root + "-one", "users", "c1 bigint, c2 string").first()
    assert (one.total_rows_imported, one.rejected_rows) == (6, 7)


def test_crlf_and_gbk_without_being_told(spark, folder):
    body = "".join(f"INSERT INTO t VALUES ({i}, '中文测试数据{i}');\r\n" for i in range(300))
    write(folder, "a.sql", body.encode("gbk"))
    root = folder + "/../gbk-" + folder.rsplit("/", 1)[-1]
    summary = migrate(spark, folder, root, chunk_bytes=4096).first()
    assert (summary.total_rows_imported, summary.rejected_rows, summary.total_tasks > 1) == (300, 0, True)
    rows = load.read_table(spark, load.LoadTarget(root, "t"), as_struct("c1 int, c2 string")).collect()
    assert {r.c2 for r in rows} == {f"中文测试数据{i}" for i in range(300)}


def test_times_of_a_run_add_up_to_its_time(spark, folder):
    path = write(folder, "users.sql", USERS)
    begun = time.time()
    summary = migrate(spark, path, folder + "/out", "users", SCHEMA, chunk_bytes=1024).first()
    assert summary.total_tasks > 3 and summary.total_execution_time <= time.time() - begun


def test_heads_are_widened(spark, folder):
    """Lines and statements longer than the range read at first are read whole; a cut INSERT counts with its whole tuples."""
    long = "x" * 3000
    write(folder, "lines.sql", "".join(f"INSERT INTO t VALUES ({i}, '{long}');\n" for i in range(12)) + "tail without end")
    write(folder, "rows.sql", "-- it's\nINSERT INTO r VALUES " + ",\n".join(f"({i}, '{long if i == 0 else 'y'}')" for i in range(400)) + ";\n")
    files = list_files(spark, folder)
    one = files.filter(F.col("file_path").endswith("lines.sql"))
    lines = manifest.head_lines(one, 20, n_bytes=1000).orderBy("line_no").collect()
    assert [len(r.line) for r in lines] == [len(f"INSERT INTO t VALUES ({i}, '{long}');") for i in range(12)] + [16]
    assert manifest.head_lines(one, 3, n_bytes=1000).count() == 3
    stmts = manifest.head_statements(files, n_bytes=1000).collect()
    assert {r.stmt[:13] for r in stmts} == {"INSERT INTO t", "INSERT INTO r"}
    assert all(r.stmt.endswith(");") for r in stmts)
    spread = manifest.spread_lines(one, 3, 9, n_bytes=500).collect()
    whole = {f"INSERT INTO t VALUES ({i}, '{long}');" for i in range(12)} | {"tail without end"}
    assert {r.line for r in spread} <= whole and len(spread) == len({r.line for r in spread}) >= 10
    assert {r.region for r in spread} == {0, 1, 2}
    plan = {r.table_name: r for r in plan_migration(spark, folder).collect()}
    assert plan["t"].ddl.startswith("CREATE TABLE t (c1 INT") and len(plan["r"].preview) == 1
