"""Chunks by bytes and batches by count, over global positions that no single task computes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.scale import running_totals

# Fixed value: statements per batch.
BATCH_ROWS = 1000


def chunk_by_bytes(stmts: DataFrame, size: Column, chunk_bytes: int, file: Sequence[str] = ("file_path",),
                   order: Sequence[str] = ("block_start", "ord", "sub")) -> DataFrame:
    """Add ``end_offset`` and ``chunk_no``: the chunk the statement starts in. Statements stay whole, so a
    chunk may exceed the limit by its last one."""
    sized = stmts.withColumn("__size", size)
    ends = running_totals(sized, file, order, {"end_offset": F.col("__size")})
    start = F.col("end_offset") - F.col("__size")
    return ends.withColumn("chunk_no", F.floor(start / F.lit(chunk_bytes)).cast("long")).drop("__size")


def batch_by_count(stmts: DataFrame, batch_rows: int = BATCH_ROWS, file: Sequence[str] = ("file_path",),
                   order: Sequence[str] = ("block_start", "ord", "sub")) -> DataFrame:
    """Add ``pos`` (from 1 in the file) and ``batch_no``."""
    placed = running_totals(stmts, file, order, {"pos": F.lit(1)})
    return placed.withColumn("batch_no", F.floor((F.col("pos") - 1) / F.lit(batch_rows)).cast("long"))


def pending_chunks(chunks: DataFrame, ledger: DataFrame, keys: Sequence[str] = ("file_path", "chunk_id")) -> DataFrame:
    """Chunks the ledger does not show as completed."""
    done = ledger.filter("status = 'completed'").select(*keys).distinct()
    return chunks.join(done, list(keys), "left_anti")
