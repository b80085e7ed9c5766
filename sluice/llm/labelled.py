"""Labelled rows to fit a model on, all or a bounded, reproducible sample, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text (a null id: of the empty text) modulo ``modulus``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def usable_labels(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, label) of all documents of label 0 or 1.

    Null labels and ids, held-out ids and ids with contradicting labels are left out.
    """
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (id_remainder(F.col("doc_id"), modulus) != held_out))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    )


def class_counts(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """(label, count) over all usable labels."""
    return usable_labels(labels, column, modulus, held_out).groupBy("label").count()


def sample_labels(labels: DataFrame, column: str, modulus: int, held_out: int, most_per_class: int) -> DataFrame:
    """``usable_labels`` of at most ``most_per_class`` documents of each label, first by a hash of their id.

    Its size is bounded by the parameter, so it may be broadcast.
    """
    rows = usable_labels(labels, column, modulus, held_out)
    order = F.xxhash64("doc_id")
    one, zero = (rows.filter(F.col("label") == v).orderBy(order, "doc_id").limit(most_per_class) for v in (1, 0))
    return one.unionByName(zero)


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``usable_labels`` has, with their label; one row for each id."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("label").alias("__label"))
    return docs.join(known, F.col("doc_id") == F.col("__id")).drop("__id").dropDuplicates(["doc_id"])


def sample_documents(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The sampled rows of ``docs`` with their label; one row for each sampled id."""
    chosen = F.broadcast(sample.select(F.col("doc_id").alias("__id"), F.col("label").alias("__label")))
    return docs.join(chosen, F.col(doc_id) == F.col("__id")).drop("__id").dropDuplicates([doc_id])
