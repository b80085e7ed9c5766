"""Byte ranges of files, so that looking at the head of a dump never reads the dump."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import hold_batches


def _ranges(path: pd.Series, offset: pd.Series, length: pd.Series) -> Iterator[bytes]:
    """The ranges one by one, through whichever filesystem a URI names."""
    from pyarrow import fs

    open_as = {}
    for uri, start, size in zip(path, offset, length):
        scheme = uri.split(":", 1)[0]
        filesystem, name = fs.FileSystem.from_uri(uri)
        filesystem = open_as.setdefault(scheme, filesystem)
        with filesystem.open_input_file(name) as f:
            yield f.read_at(int(size), int(start))


@F.pandas_udf(T.BinaryType())
def read_range(path: pd.Series, offset: pd.Series, length: pd.Series) -> pd.Series:
    """Bytes ``[offset, offset + length)`` of each file."""
    return pd.Series(list(_ranges(path, offset, length)), dtype=object)


@F.pandas_udf(T.StringType())
def digest_range(path: pd.Series, offset: pd.Series, length: pd.Series) -> pd.Series:
    """SHA-256 of bytes ``[offset, offset + length)`` of each file, as ``sha2`` writes it. One range is held at a time."""
    return pd.Series([hashlib.sha256(data).hexdigest() for data in _ranges(path, offset, length)], dtype=object)


def file_uri(path: Column) -> Column:
    """``file:/x`` as Spark lists it -> ``file:///x``."""
    return F.regexp_replace(path, r"^([a-z0-9]+):/(?!/)", "$1:///")


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, length, modificationTime`` of files below a path or glob; contents are pruned, not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(file_uri(F.col("path")).alias("file_path"), F.col("length").alias("file_size"), "modificationTime")
    )


def heads(files: DataFrame, n_bytes: int) -> DataFrame:
    """Add ``head``, the first bytes of each file. Files are spread over the cluster first."""
    hold_batches(files.sparkSession)
    spread = files.repartition("file_path")
    return spread.withColumn(
        "head", read_range(F.col("file_path"), F.lit(0), F.least(F.lit(n_bytes), F.col("file_size"))))
