"""Connected components of an edge table by alternating large and small stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import discard, scratch


def _stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Self-loops, repeated and reversed edges are harmless; rows with a null end are ignored; no edges give no rows.
    Nodes are never gathered anywhere: a round is two aggregations with map-side minima and two joins, and a hub's
    rows in a join are split by adaptive execution. Each round is a table in the shared folder; the one before goes.
    """
    spark = edges.sparkSession
    current, path = _stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components"
    )
    mark = None
    while True:
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour.
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        small = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        tied = large.join(small, large["a"] == small["k"])
        stars = tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select(F.col("k").alias("a"), F.col("m").alias("b"))
        ).distinct()
        following, new_path = _stored(stars, "components")
        told = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        discard(spark, path)
        current, path = following, new_path
        if told == mark:
            break
        mark = told
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
