"""Helpers that keep plans safe when a table, a key or a source grows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import scratch, shared_dir

#: rows of a key table that may be broadcast. A row is a path (held to 255 characters on admission) and a few
#: numbers, so the bound stands for 300 MB at most; chunk tables stay below it up to 250 TB in 256 MB chunks.
BROADCAST_ROWS = 1_000_000


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a small derived table to the shared folder and read it back: lineage is cut, size is known."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(stored: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialised key table only when its row count is within the bound.

    Beyond it the join is left to Catalyst, which shuffles both sides (AQE splits skewed keys).
    """
    return F.broadcast(stored) if stored.limit(max_rows + 1).count() <= max_rows else stored


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right["__" + k])
    return cond


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column]
) -> DataFrame:
    """Add running sums per key, inclusive of the row, without ever windowing a whole key in one task.

    Rows are range-partitioned by (key, order), so a hot key is cut into many ranges; sums run inside each
    range and the totals of earlier ranges of the key are added. ``order`` must be unique within a key.
    The ranged rows are checkpointed because range bounds are sampled: both uses must see the same ranges.
    """
    spark = df.sparkSession
    shared_dir(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = df.select("*", *[c.cast("long").alias("__t_" + n) for n, c in totals.items()])
    ranged = (
        staged.repartitionByRange(ranges, *keys, *order)
        .withColumn("__range", F.spark_partition_id())
        .checkpoint()
    )
    group = [*keys, "__range"]
    per_range = ranged.groupBy(*group).agg(*[F.sum("__t_" + n).alias("__s_" + n) for n in totals])
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = per_range.select(
        *[F.col(k).alias("__" + k) for k in group],
        *[F.coalesce(F.sum("__s_" + n).over(earlier), F.lit(0)).alias("__b_" + n) for n in totals],
    )
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(base, _null_safe(ranged, base, group))
    return joined.select(
        *[ranged[c] for c in df.columns],
        *[(F.sum("__t_" + n).over(inside) + F.col("__b_" + n)).alias(n) for n in totals],
    )
