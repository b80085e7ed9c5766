"""Shapes of physical plans that must hold at scale."""

from pyspark.sql import functions as F

from sluice.operators.sampling import head_sample
from sluice.operators.values import good_rows, typed_rows
from sluice.plans.migrate import as_struct
from sluice.sources.dumps import read_statements
from tests.conftest import write


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parsing_is_one_jvm_stage_without_shuffle(spark, folder):
    path = write(folder, "a.sql", "INSERT INTO t VALUES (1, 'a');\n" * 100)
    plan = plan_of(good_rows(typed_rows(read_statements(spark, path), as_struct("id int, s string"))))
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
    assert plan.count("FileScan text") == 1


def test_head_sample_is_cut_before_the_shuffle(spark):
    lines = spark.range(1000).select(F.col("id").cast("string").alias("file_path"), F.col("id").alias("ord"), F.lit("x").alias("line"))
    plan = plan_of(head_sample(lines, 10))
    assert plan.count("WindowGroupLimit") == 2


def test_splits_do_not_depend_on_cores(spark, folder):
    path = write(folder, "a.sql", "INSERT INTO t VALUES (1, 'a');\n" * 5000)
    starts = {r.block_start for r in read_statements(spark, path, chunk_bytes=40_000).select("block_start").distinct().collect()}
    assert starts == {0, 40_000, 80_000, 120_000}
