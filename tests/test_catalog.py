"""Tables by name, admission before a load, dumps of several tables in a stream."""

import pytest

from pyspark.sql import functions as F

from sluice.plans import load, migrate as plans
from sluice.plans.catalog import publish, view_name
from sluice.plans.migrate import migrate, migrate_files
from sluice.sources.manifest import admit_paths
from sluice.streaming.ingest import ingest_tables
from tests.conftest import write


def _rows(table: str, begin: int, end: int, value: str = "") -> str:
    return "".join(f"INSERT INTO {table} (id, v) VALUES ({i}, {value or i});\n" for i in range(begin, end))


def test_views_follow_the_ledger(spark, folder):
    """A name sees what is committed when it is published: wider types, added columns, replaced files; no half a load."""
    path, root = write(folder, "a.sql", _rows('my."t-1"', 0, 20)), folder + "/out"
    migrate(spark, path, root, "t-1", database="sluice_v")
    name = f"sluice_v.{view_name('t-1')}"
    assert name == "sluice_v.t_2d_1"
    first = spark.sql(f"SELECT count(*) AS n, sum(v) AS s FROM {name}").first()
    assert tuple(first) == (20, 190)
    other = write(folder, "b.sql", "INSERT INTO `t-1` (id, v) VALUES (9000000000, 'x');\n")
    target = load.LoadTarget(root, "t-1")
    migrate(spark, other, root, "t-1")
    assert spark.table(name).count() == 20  # not published yet
    assert publish(spark, target, name).count() == 21
    assert [f.dataType.simpleString() for f in spark.table(name).schema][:2] == [f.dataType.simpleString() for f in load.table_schema(spark, target)][:2]
    write(folder, "a.sql", _rows("`t-1`", 100, 103))
    migrate(spark, path, root, "t-1", on_replaced="replace", database="sluice_v")
    ids = {r.id for r in spark.table(name).select("id").collect()}
    assert ids >= {100, 101, 102} and not ids & set(range(20))
    stored = load.read_table(spark, target)
    assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, stored.collect()))


def test_publish_an_empty_table(spark, folder):
    path = write(folder, "a.sql", "INSERT INTO t VALUES (1);\n")
    migrate(spark, path, folder + "/out", "t", "a int, b string")  # its only row is a reject
    rows = publish(spark, load.LoadTarget(folder + "/out", "t"), "sluice_empty_t")
    assert rows.columns == ["a", "b"] and rows.count() == 0


def test_files_are_admitted_before_they_are_read(spark, folder):
    good, note = write(folder, "a.sql", _rows("t", 0, 5)), write(folder, "note.txt", _rows("t", 50, 60))
    gone = folder + "/gone.sql"
    codes = {r.file_path.rsplit("/", 1)[-1]: r.error_code for r in admit_paths(spark, [folder, gone, "", folder + "/x*.sql"], ["file://" + folder]).collect()}
    assert codes == {"a.sql": None, "note.txt": "PATH_001", "gone.sql": "PATH_003", "": "PATH_001", "x*.sql": "PATH_003"}
    root = folder + "/../admit-" + folder.rsplit("/", 1)[-1]
    with pytest.raises(ValueError, match="note.txt .PATH_001."):
        migrate(spark, folder, root, admission={})
    told = {r.file_path.rsplit("/", 1)[-1]: r.success for r in migrate_files(spark, [good, note, gone], root, admission={}).collect()}
    assert told == {"a.sql": True, "note.txt": False, "gone.sql": False}
    assert load.read_table(spark, load.LoadTarget(root, "t")).count() == 5
    assert {r.success for r in migrate_files(spark, note, root, admission={}).collect()} == {False}


def test_stream_of_tables_survives_a_failed_batch(spark, folder, monkeypatch):
    """Statements go to the tables they name; a batch that fails after its first table is run again and doubles nothing."""
    root, state = folder + "/../tables-" + folder.rsplit("/", 1)[-1], folder + "/../state-" + folder.rsplit("/", 1)[-1]
    write(folder, "one.sql", _rows("a", 0, 30) + _rows("b", 0, 10))
    real, calls = plans.load_chunks, []

    def lost(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(plans, "load_chunks", lost)
    with pytest.raises(Exception, match="lost"):
        ingest_tables(spark, folder, root, state).awaitTermination()
    monkeypatch.setattr(plans, "load_chunks", real)
    write(folder, "two.sql", "-- nothing but a comment\n")
    write(folder, "three.sql", _rows("b", 10, 15, "'word'"))
    ingest_tables(spark, folder, root, state, max_files=1).awaitTermination()
    sizes = {t: load.read_table(spark, load.LoadTarget(root, t)).agg(F.count("*"), F.countDistinct("id")).first() for t in "ab"}
    assert {t: tuple(n) for t, n in sizes.items()} == {"a": (30, 30), "b": (15, 15)}
    assert load.table_schema(spark, load.LoadTarget(root, "b"))["v"].dataType.simpleString() == "string"
