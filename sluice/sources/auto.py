"""Dumps of mixed charsets and line ends in one read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.dialects import ORACLE, Dialect
from sluice.sources.dumps import CHUNK_BYTES, DumpScan, assemble, misaligned, read_records, scan, to_statements
from sluice.sources.encoding import DETECT_BYTES, byte_order, choose_charset, read_unsplittable, separator_of
from sluice.sources.ranges import heads, list_files


def describe_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_path, encoding, confidence, separator`` per file, from one look at its head; wide charsets with byte order."""
    looked = choose_charset(heads(list_files(spark, path), DETECT_BYTES))
    ordered = looked.withColumn("encoding", byte_order(F.col("head"), F.col("encoding")))
    return ordered.withColumn("separator", separator_of(F.col("head"))).drop("head")


def dump_kinds(spark: SparkSession, path: str | list[str]) -> list:
    """The charsets and separators that occur: a handful of rows (encoding, separator), whatever the number of files."""
    kinds = describe_files(spark, path).select("encoding", "separator").distinct().collect()
    if not kinds:
        raise ValueError(f"no files in {path}")
    return kinds


def scan_any(spark: SparkSession, path: str | list[str], chunk_bytes: int = CHUNK_BYTES, dialect: str | Dialect = ORACLE) -> list[DumpScan]:
    """One scan for each kind of file: its charset and its line ends.

    Files fall into a handful of kinds; each kind is one splittable read. File names (which the reader lists on the
    driver anyway) are gathered only when there is more than one kind.
    """
    files = describe_files(spark, path).select("file_path", "encoding", "separator").persist()
    kinds = [(r.encoding, r.separator) for r in files.select("encoding", "separator").distinct().collect()]
    out = []
    for encoding, separator in kinds:
        of_kind = files.filter((F.col("encoding") == encoding) & (F.col("separator") == separator))
        paths = path if len(kinds) == 1 else [r.file_path for r in of_kind.select("file_path").collect()]
        found = scan(read_records(spark, paths, separator, chunk_bytes, encoding), separator, dialect, encoding)
        out.append(scan(read_unsplittable(spark, paths, encoding), dialect=dialect) if misaligned(found) else found)
    files.unpersist()
    if not out:
        raise ValueError(f"no files in {path}")
    return out


def read_any(spark: SparkSession, path: str | list[str], chunk_bytes: int = CHUNK_BYTES, dialect: str | Dialect = ORACLE) -> DataFrame:
    """Statements of all files, each read in its own charset and with its own line ends."""
    parts = [to_statements(assemble(found), dialect) for found in scan_any(spark, path, chunk_bytes, dialect)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
