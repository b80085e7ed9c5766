"""Tuples, typed values, rejects, inference, DDL."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice.functions import ddl, text
from sluice.operators import profile
from sluice.operators.values import good_rows, parse_tuples, rejected_rows, typed_rows
from sluice.plans.migrate import as_struct, schemas_of


def frame(spark, *stmts):
    return spark.createDataFrame([(s,) for s in stmts], "stmt string")


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first().o


def test_tuples(spark):
    df = frame(
        spark,
        "INSERT INTO users (id, a) VALUES (1, TO_DATE('2023-01-15 10:30:00', 'YYYY-MM-DD HH24:MI:SS')), (2, 'Levi''s, (x) ;');",
        "insert into t\nvalues\n(1,\n'二',\nNULL)\n,\n(f(g(1,2),3), -1.5e3, \"q,q\")",
        "INSERT INTO t VALUES (1,,2);", "INSERT INTO t VALUES (1, 2", "UPDATE t SET a = 1;", "INSERT INTO t VALUES ('a,,b', 1);")
    got = [(r.vals, r.reason) for r in parse_tuples(df).collect()]
    assert got[0][0] == ["1", "TO_DATE('2023-01-15 10:30:00', 'YYYY-MM-DD HH24:MI:SS')"]
    assert got[1][0] == ["2", "'Levi''s, (x) ;'"]
    assert got[2][0] == ["1", "'二'", "NULL"]
    assert got[3][0] == ["f(g(1,2),3)", "-1.5e3", '"q,q"']
    assert [g[1] for g in got[4:]] == ["unparsed_values", "unparsed_values", "not_insert", None]


def test_long_literal(spark):
    df = frame(spark, "INSERT INTO t VALUES (1, '" + "x''y(" * 300_000 + "');")
    assert len(good_rows(typed_rows(df, as_struct("a int, b string"))).first().b) == 1_200_000


def test_typed_values(spark):
    schema = as_struct("a int, b double, c decimal(10,2), d date, e timestamp_ntz, f string, g binary, h tinyint")
    df = frame(
        spark,
        "INSERT INTO t VALUES (1, 1e3, 2.50, TO_DATE('2023-09-15', 'YYYY-MM-DD'), TO_TIMESTAMP('15-JAN-24 01:02:03 PM', 'DD-MON-RR HH12:MI:SS AM'), 'NULL', HEXTORAW('4142'), 1);",
        "INSERT INTO t VALUES (null, -0.0, NULL, '2024-01-01', TIMESTAMP '2024-01-01 10:00:00.123456', '', NULL, '0');",
        "INSERT INTO t (f, a) VALUES ('it''s', 7);")
    rows = good_rows(typed_rows(df, schema)).collect()
    assert (rows[0].a, rows[0].b, str(rows[0].c), rows[0].d) == (1, 1000.0, "2.50", dt.date(2023, 9, 15))
    assert rows[0].e == dt.datetime(2024, 1, 15, 13, 2, 3) and rows[0].f == "NULL" and bytes(rows[0].g) == b"AB"
    assert rows[1].a is None and rows[1].d == dt.date(2024, 1, 1) and rows[1].f == "" and rows[1].h == 0
    assert rows[1].e == dt.datetime(2024, 1, 1, 10, 0, 0, 123456)
    assert (rows[2].a, rows[2].f, rows[2].b) == (7, "it's", None)


def test_rejects(spark):
    df = frame(spark, "INSERT INTO t VALUES (1);", "INSERT INTO t VALUES ('x', 'y');", "INSERT INTO t (a, z) VALUES (1, 2);",
               "DROP TABLE t;", "INSERT INTO t VALUES (2147483648, 'big');", "INSERT INTO t VALUES (3, 'ok');")
    typed = typed_rows(df, as_struct("a int, b string"))
    assert [r.a for r in good_rows(typed).collect()] == [3]
    assert sorted(r.reason for r in rejected_rows(typed).collect()) == [
        "arity_mismatch", "bad_value:a", "bad_value:a", "not_insert", "unknown_column"]


@pytest.mark.parametrize("values,expected", [
    (["1", "-5", "NULL"], "INT"), (["1", "2147483648"], "BIGINT"), (["1", "99999999999999999999"], "DECIMAL(20,0)"),
    (["1500.50", "0.00"], "DECIMAL(6,2)"), (["0.187", "15.2"], "DECIMAL(5,3)"), (["1", "1e3"], "DOUBLE"),
    (["007"], "VARCHAR(3)"), (["'12'"], "VARCHAR(2)"), (["'2024-01-01'", "null"], "DATE"),
    (["'2024-01-01'", "TO_DATE('2024-01-01 10:00:00','YYYY-MM-DD HH24:MI:SS')"], "TIMESTAMP"),
    (["'2024-13-01'"], "VARCHAR(10)"), (["'中文'", "'a''b'"], "VARCHAR(3)"), (["NULL"], "VARCHAR(1)"), (["1", "'x'"], "VARCHAR(1)"),
])
def test_infer_types(spark, values, expected):
    df = frame(spark, *[f"INSERT INTO t (a) VALUES ({v});" for v in values])
    row = profile.infer_schema(df).first()
    assert (row.table_name, row.column_name, row.sql_type, row.confidence) == ("t", "a", expected, 1.0)


def test_infer_with_tolerance_and_lists(spark):
    df = frame(spark, "INSERT INTO t (a, b) VALUES (1, 'x');", "INSERT INTO t (b, a) VALUES ('y', 2);", "INSERT INTO t (a) VALUES ('n/a');")
    strict = {r.column_name: r.sql_type for r in profile.infer_schema(df).collect()}
    assert strict == {"a": "VARCHAR(3)", "b": "VARCHAR(1)"}
    loose = {r.column_name: (r.sql_type, round(r.confidence, 2)) for r in profile.infer_schema(df, 0.4).collect()}
    assert loose["a"] == ("INT", 0.67)
    assert schemas_of(profile.infer_schema(df))["t"].simpleString() == "struct<a:string,b:string>"
    assert profile.fallback_schema(profile.infer_schema(df), "generic").count() == 3


def test_render_ddl(spark):
    schema = profile.infer_schema(frame(spark, "INSERT INTO t (id, d, s) VALUES (1, TO_DATE('2024-01-01 01:00:00', 'YYYY-MM-DD HH24:MI:SS'), 'abc');"))
    assert profile.render_ddl(schema, "doris").first().ddl == (
        "CREATE TABLE t (id INT, d DATETIME, s VARCHAR(3)) DUPLICATE KEY(id) DISTRIBUTED BY HASH(id) BUCKETS 10 "
        'PROPERTIES ("replication_num" = "1");')
    assert profile.render_ddl(schema, "spark").first().ddl == "CREATE TABLE t (id INT, d TIMESTAMP_NTZ, s STRING) USING parquet"


def test_normalise_goldens(spark):
    for dirty, clean in [("INSERT INTO table ('中文'，'测试'）", "INSERT INTO table ('中文','测试')"),
                         ("VALUES ('李四'：'测试用户'；)", "VALUES ('李四':'测试用户';)"),
                         ("SELECT * FROM '表名'。", "SELECT * FROM '表名'."), ("﻿ a\x00 \t b　c “q”", "a b c \"q\"")]:
        assert one(spark, text.normalise_line, dirty) == clean


def test_statement_text(spark):
    assert one(spark, text.strip_insert_qualifier, "insert into APP_OWNER . t VALUES ('APP_OWNER.x')") == "INSERT INTO t VALUES ('APP_OWNER.x')"
    assert one(spark, text.clean_statement, "INSERT INTO [APP_OWNER].t\n VALUES ('a  b',  1)") == "INSERT INTO t VALUES ('a  b', 1)"
    assert one(spark, text.clean_statement, "DEFINE x = 1") is None
    assert one(spark, text.insert_table_name, 'INSERT INTO db."客户" (a) VALUES (1)') == "客户"
    assert one(spark, text.file_table_name, "/data/a-b c.2024.sql") == "a_b_c_2024"
    assert one(spark, text.type_date_literals, "INSERT INTO t VALUES ('2024-01-01', 'it''s null 2024-01-01', Null)") == (
        "INSERT INTO t VALUES ('2024-01-01'::date, 'it''s null 2024-01-01', NULL)")
    assert one(spark, text.has_insert_format, "Insert  into t values(1)") is True
    assert [one(spark, text.is_sql_line, x) for x in ("-- a", "  prompt x", "SETTLE", "", "INSERT", "set x", "commit;")] == [
        False, False, True, False, True, False, False]


def test_ddl_text(spark):
    script = ("USE db; CREATE TABLE APP_OWNER.test_table (id NUMBER(10) PRIMARY KEY, name VARCHAR2(100) NOT NULL, created_date DATE,\n"
              " amount NUMBER(10,2), description CLOB) ENGINE=InnoDB;")
    clean = one(spark, ddl.clean_ddl, script)
    assert clean.startswith("CREATE TABLE test_table (id NUMBER(10)")
    assert one(spark, ddl.convert_ddl, clean) == (
        "CREATE TABLE test_table (id NUMERIC(10) PRIMARY KEY, name VARCHAR(100) NOT NULL, created_date DATE, "
        "amount NUMERIC(10,2), description TEXT) ;")
    assert one(spark, ddl.ddl_table_name, "create table if not exists `t1` (a int)") == "t1"
    assert one(spark, ddl.is_valid_ddl, "DROP TABLE x") is False
    assert one(spark, ddl.extract_ddl, "Here:\n  CREATE TABLE t (\n  a INT\n)\nDone") == "CREATE TABLE t (\na INT\n)\nDone"
    assert one(spark, ddl.extract_ddl, "nothing") == ""
