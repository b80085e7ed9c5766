"""What a file held when it was loaded, and what has become of it since.

A version is a file's size, its modification time and the digests of its first and last bytes. A file is the ``same`` if
size and ends agree, ``grown`` if it is longer and still begins with the bytes of the old version (both ends of the old
version are where they were), and ``replaced`` otherwise. Only ends are read, however large the files are; a file that was
changed in the middle without a change of its size counts as the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.ranges import digest_range, file_uri, list_files, read_range

#: bytes digested at each end
END_BYTES = 64 * 1024
VERSION = ["file_size", "modified", "head_hash", "tail_hash"]
_BOM = "EFBBBF"


def _ends(size: Column) -> tuple[Column, Column]:
    """Digest of the first and of the last bytes of the first ``size`` bytes of a file."""
    length = F.least(F.lit(END_BYTES), size)
    path = file_uri(F.col("file_path"))
    return digest_range(path, F.lit(0), length), digest_range(path, size - length, length)


def file_versions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_path``, the columns of a version, and ``bom``, the bytes of a byte order mark the file begins with."""
    files = list_files(spark, path).withColumnRenamed("modificationTime", "modified").repartition("file_path")
    head, tail = _ends(F.col("file_size"))
    mark = F.hex(read_range(F.col("file_path"), F.lit(0), F.least(F.lit(3), F.col("file_size"))))
    return files.select("file_path", *VERSION[:2], head.alias("head_hash"), tail.alias("tail_hash"), F.when(mark == _BOM, 3).otherwise(0).alias("bom"))


def compare_versions(known: DataFrame, current: DataFrame) -> DataFrame:
    """``file_path, state`` of the files in both: same, grown or replaced.

    ``known`` has the last version of each file and ``open_end``, which says that a grown file cannot be gone on with.
    """
    old = known.select("file_path", F.col("file_size").alias("old_size"), F.col("head_hash").alias("old_head"),
                       F.col("tail_hash").alias("old_tail"), "open_end")
    met = current.select("file_path", *VERSION).join(old, "file_path").repartition("file_path")
    longer = F.col("file_size") > F.col("old_size")
    # the ends of the old version are looked up in the new file only where it is longer
    head, tail = _ends(F.when(longer, F.col("old_size")).otherwise(F.lit(0)))
    looked = met.withColumn("head", head).withColumn("tail", tail)
    same = (F.col("file_size") == F.col("old_size")) & (F.col("head_hash") == F.col("old_head")) & (F.col("tail_hash") == F.col("old_tail"))
    grown = longer & (F.col("head") == F.col("old_head")) & (F.col("tail") == F.col("old_tail")) & ~F.col("open_end")
    return looked.select("file_path", F.when(same, "same").when(grown, "grown").otherwise("replaced").alias("state"))
