"""Compare what was loaded with what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows per table on both sides (columns table_name, n); a table missing on one side counts 0 there."""
    s = source.select("table_name", F.col("n").alias("source_rows"))
    t = target.select("table_name", F.col("n").alias("target_rows"))
    both = s.join(t, "table_name", "full_outer").na.fill(0, ["source_rows", "target_rows"])
    return both.withColumn("matches", F.col("source_rows") == F.col("target_rows"))


def content_fingerprint(df: DataFrame, table_name: str) -> DataFrame:
    """Count and order-free digest of all rows: one pass, no shuffle of rows."""
    digest = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n"), F.sum(digest.cast("decimal(38,0)")).cast("string").alias("digest")).select(
        F.lit(table_name).alias("table_name"), "n", "digest"
    )


def content_difference(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of either side the other lacks, duplicates counted. One aggregation: source rows count 1, target rows -1."""
    both = source.withColumn("__n", F.lit(1)).unionByName(target.withColumn("__n", F.lit(-1)))
    left = both.groupBy(*source.columns).agg(F.sum("__n").alias("__n")).filter(F.col("__n") != 0)
    side = F.when(F.col("__n") > 0, "source_only").otherwise("target_only")
    return left.select(*source.columns, side.alias("side"), F.explode(F.array_repeat(F.lit(1), F.abs("__n").cast("int"))).alias("__n")).drop("__n")


def table_info(df: DataFrame, table_name: str) -> DataFrame:
    """Ordered columns with type and nullability, and the row count."""
    columns = F.array(*[
        F.struct(F.lit(i + 1).alias("pos"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"))
        for i, f in enumerate(df.schema)
    ])
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(table_name).alias("table_name"), "row_count", F.inline(columns))
