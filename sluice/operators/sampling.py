"""Samples of dumps and row estimates. ``lines`` frames hold file_path, ord and line unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.literals import BLANKS
from sluice.functions.text import has_cjk, is_insert

# Sample size, extra lines per region, previewed statements and their length, lines used by
# the fast estimate, probes of the density estimate, share of INSERT lines a good sample exceeds.
SAMPLE_LINES = 100
REGION_EXTRA = 50
PREVIEW_STATEMENTS, PREVIEW_LENGTH = 5, 500
ESTIMATE_LINES = 50
PROBES = 10
MIN_INSERT_SHARE = 0.1


def head_sample(lines: DataFrame, n: int = SAMPLE_LINES, skip_blank: bool = True, file: str = "file_path",
                order: str = "ord") -> DataFrame:
    """First n lines per file. Spark cuts each partition to n per file before the shuffle, so a file that
    holds most rows costs no more than any other."""
    kept = lines.filter(F.btrim("line", F.lit(BLANKS)) != "") if skip_blank else lines
    return kept.withColumn("line_no", F.row_number().over(Window.partitionBy(file).orderBy(order))).filter(
        F.col("line_no") <= n
    )


def spread_sample(lines: DataFrame, regions: int, n: int = SAMPLE_LINES, file: str = "file_path",
                  region: str = "region", order: str = "ord") -> DataFrame:
    """First ``n / regions + 50`` lines of each region of a file."""
    per_region = n // regions + REGION_EXTRA
    kept = lines.filter(F.btrim("line", F.lit(BLANKS)) != "")
    return kept.withColumn("line_no", F.row_number().over(Window.partitionBy(file, region).orderBy(order))).filter(
        F.col("line_no") <= per_region
    )


def first_inserts(stmts: DataFrame, limit: int = 10, file: str = "file_path", order: str = "ord") -> DataFrame:
    """First INSERT statements of each file."""
    inserts = stmts.filter(is_insert(F.col("stmt")))
    return inserts.withColumn("n", F.row_number().over(Window.partitionBy(file).orderBy(order))).filter(
        F.col("n") <= limit
    )


def preview_statements(stmts: DataFrame, file: str = "file_path", order: str = "ord") -> DataFrame:
    """First five INSERTs per file, long ones cut to 500 characters and an ellipsis."""
    text = F.btrim("stmt", F.lit(BLANKS))
    short = F.when(F.length(text) > PREVIEW_LENGTH, F.concat(F.substring(text, 1, PREVIEW_LENGTH), F.lit("..."))).otherwise(text)
    return first_inserts(stmts, PREVIEW_STATEMENTS, file, order).withColumn("preview", short)


def estimate_rows(sample: DataFrame, sizes: DataFrame, file: str = "file_path") -> DataFrame:
    """Rows per file from mean line bytes: over the sample, and over its first 50 lines with their newline.

    ``sample`` has file, line_no, line; ``sizes`` has file, file_size.
    """
    bytes_ = F.octet_length("line")
    head = F.when(F.col("line_no") <= ESTIMATE_LINES, bytes_ + 1)
    means = sample.filter(F.btrim("line", F.lit(BLANKS)) != "").groupBy(file).agg(
        F.avg(bytes_).alias("mean"), F.avg(head).alias("head_mean"))
    return sizes.join(means, file, "left").select(
        file, "file_size",
        F.coalesce(F.floor(F.col("file_size") / F.col("mean")), F.lit(0)).cast("long").alias("estimated_rows"),
        F.coalesce(F.floor(F.col("file_size") / F.col("head_mean")), F.lit(0)).cast("long").alias("estimated_rows_fast"),
    )


def density_estimate(probes: DataFrame, file: str = "file_path") -> DataFrame:
    """Rows per file from newline density of probes: columns file, file_size, probe_bytes, probe_lines."""
    return probes.groupBy(file).agg(
        F.first("file_size").alias("file_size"), F.sum("probe_lines").alias("lines"), F.sum("probe_bytes").alias("bytes")
    ).select(
        file, "file_size",
        F.when(F.col("bytes") > 0, F.floor(F.col("file_size") * F.col("lines") / F.col("bytes"))).otherwise(0)
        .cast("long").alias("estimated_rows"),
    )


def count_lines(records: DataFrame, file: str = "file_path") -> DataFrame:
    """Exact lines and records per file, from statement records (each ends with one separator line)."""
    inner = F.length("value") - F.length(F.replace(F.col("value"), F.lit("\n"), F.lit("")))
    return records.groupBy(file).agg(F.sum(inner + 1).alias("n_lines"), F.count("*").alias("n_records"))


def quality_gate(lines: DataFrame, file: str = "file_path") -> DataFrame:
    """Per file: lines, INSERT lines, lines with CJK characters, and whether more than a tenth are INSERTs."""
    opens = F.upper(F.btrim("line", F.lit(BLANKS))).startswith("INSERT")
    return lines.groupBy(file).agg(
        F.count("*").alias("n_lines"), F.count_if(opens).alias("n_insert"), F.count_if(has_cjk(F.col("line"))).alias("n_cjk")
    ).withColumn("passes", (F.col("n_insert") / F.col("n_lines")) > MIN_INSERT_SHARE)
