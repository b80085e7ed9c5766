"""Sets of intervals [begin_byte, end_byte) per key: unions, and what pieces they cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of the intervals of each key, as few intervals that do not touch. Empty ones vanish.

    A key's intervals are windowed together: keys are files, whose intervals are as many as the chunks ever loaded of them.
    """
    order = Window.partitionBy(*keys).orderBy("begin_byte", "end_byte")
    reach = F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col("begin_byte") > reach)).cast("int")
    marked = intervals.filter("begin_byte < end_byte").select(*keys, "begin_byte", "end_byte", opens.alias("opens"))
    island = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*keys, "island").agg(
        F.min("begin_byte").alias("begin_byte"), F.max("end_byte").alias("end_byte")).drop("island")


def with_cover(pieces: DataFrame, covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces with ``covers``, the intervals of ``merged`` that meet them, and ``state``: all, none or part of it is covered.

    A piece without bytes is covered wherever its place is.
    """
    begin, end = F.col("p.begin_byte"), F.col("p.end_byte")
    met = F.lit(True)
    for k in keys:
        met = met & (F.col(f"p.{k}") == F.col(f"c.{k}"))
    met = met & (F.col("c.begin_byte") < F.greatest(end, begin + 1)) & (F.col("c.end_byte") > begin)
    found = pieces.alias("p").join(covered.alias("c"), met, "left").groupBy(*[F.col(f"p.{c}") for c in pieces.columns]).agg(
        F.sort_array(F.collect_list(F.when(F.col("c.begin_byte").isNotNull(), F.struct(F.col("c.begin_byte").alias("begin"), F.col("c.end_byte").alias("end"))))).alias("covers"))
    whole = F.exists("covers", lambda c: (c["begin"] <= F.col("begin_byte")) & (c["end"] >= F.col("end_byte")))
    return found.withColumn("state", F.when(whole, "all").when(F.size("covers") == 0, "none").otherwise("part"))


def is_covered(place: Column, covers: Column) -> Column:
    return F.exists(covers, lambda c: (c["begin"] <= place) & (place < c["end"]))
