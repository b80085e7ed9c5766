"""Schemas that are kept with their tables, and merged."""

import pytest

from sluice.operators import profile
from sluice.plans import load
from sluice.plans.migrate import as_struct, migrate
from tests.conftest import write


def frame(spark, *stmts):
    return spark.createDataFrame([(s,) for s in stmts], "stmt string")


def test_merging_profiles_is_inferring_from_all_values(spark):
    parts = [frame(spark, "INSERT INTO t VALUES (1, 2.5, '2024-01-01', NULL)", "INSERT INTO t VALUES (3000000000, 2, '2024-01-01', 'x')"),
             frame(spark, "INSERT INTO t VALUES (4, 100.25, '2024-01-01 10:00:00', 'yy')"),
             frame(spark, "INSERT INTO t VALUES (5, 7, NULL, 'zzz')")]
    types = lambda p: {(r.column_name, r.sql_type) for r in profile.infer_types(p).collect()}
    each = [profile.profile_values(profile.named_values(p), text_stats=False) for p in parts]
    whole = profile.profile_values(profile.named_values(parts[0].unionByName(parts[1]).unionByName(parts[2])), text_stats=False)
    forth = profile.merge_profiles(profile.merge_profiles(each[0].unionByName(each[1])).unionByName(each[2]))
    back = profile.merge_profiles(each[0].unionByName(profile.merge_profiles(each[2].unionByName(each[1]))))
    assert types(whole) == types(forth) == types(back) == {
        ("c1", "BIGINT"), ("c2", "DECIMAL(5,2)"), ("c3", "TIMESTAMP"), ("c4", "VARCHAR(3)")}


@pytest.mark.parametrize("how", ["widen", "reject"])
def test_later_files(spark, folder, how):
    target = load.LoadTarget(folder + "/out", "t")
    one = write(folder, "one.sql", "INSERT INTO t (a, b) VALUES (1, 10);\nINSERT INTO t (a, b) VALUES (2, 20);\n")
    two = write(folder, "two.sql", "INSERT INTO t (a, b, c) VALUES (3, 'many', '2024-01-01');\nINSERT INTO t (a, b) VALUES (4, 40);\n")
    migrate(spark, one, folder + "/out", "t", on_drift=how)
    migrate(spark, [one, two], folder + "/out", "t", on_drift=how)
    rows = sorted(tuple(r) for r in load.read_table(spark, target).collect())
    kinds = [f.dataType.simpleString() for f in load.table_schema(spark, target)]
    reasons = [r.reason for r in load.read_rejects(spark, target).collect()]
    if how == "widen":
        assert (kinds, reasons) == (["int", "string", "date"], [])
        assert [(a, b, str(c) if c else c) for a, b, c in rows] == [(1, "10", None), (2, "20", None), (3, "many", "2024-01-01"), (4, "40", None)]
    else:
        assert (kinds, rows, reasons) == (["int", "int"], [(1, 10), (2, 20), (4, 40)], ["unknown_column"])
    assert load.read_table(spark, target, as_struct("b string")).count() == len(rows)
    with pytest.raises(ValueError):
        load.table_schema(spark, load.LoadTarget(folder, "none"))
