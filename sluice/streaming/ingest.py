"""Dumps that keep arriving: parsed and loaded micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.values import MISPLACED, good_rows, rejected_rows, typed_rows, with_table_names
from sluice.plans.migrate import NothingToLoad, migrate
from sluice.sources.dumps import (
    CHUNK_BYTES, assemble, fixed_split_session, scan, to_statements, valid_utf8,
)


def ingest_stream(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str,
                  separator: str = ";\n", max_files: int = 1000, chunk_bytes: int = CHUNK_BYTES,
                  table: str | None = None) -> StreamingQuery:
    """Load every file that arrives in ``folder`` into ``target`` and stop when none is left.

    With ``table``, statements that name another one are rejects; so is what is no INSERT.

    The folder of a batch is overwritten when the batch runs again, so a restart loads nothing twice.
    """
    arriving = (
        fixed_split_session(spark, chunk_bytes).readStream.option("lineSep", separator).option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", "true").text(folder)
        .select(F.col("_metadata.file_path").alias("file_path"),
                F.col("_metadata.file_block_start").alias("block_start"), "value", F.col("_metadata.file_size").alias("file_size"))
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        records = valid_utf8(batch.select(
            "file_path", "block_start", F.lit(batch_id).cast("long").alias("chunk_id"),
            F.monotonically_increasing_id().alias("ord"), "value", F.octet_length("value").alias("n_raw"), "file_size"))
        named = with_table_names(to_statements(assemble(scan(records, separator))))
        stray = F.coalesce(F.col("table_name") != table, F.lit(False)) if table else F.lit(False)
        rows = typed_rows(named.withColumn(MISPLACED, stray), schema, ["chunk_id"]).persist()
        for part, name in ((good_rows(rows), "data"), (rejected_rows(rows, ["chunk_id"]), "rejects")):
            part.withColumnRenamed("chunk_id", "batch_id").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{target}/{name}")
        rows.unpersist()

    return (
        arriving.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_ingested(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    kept = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(kept).parquet(f"{target}/data").select(*schema.names)


def ingest_tables(spark: SparkSession, folder: str, root: str, checkpoint: str, max_files: int = 1000, pattern: str = "*",
                  trigger: dict | None = None, **options) -> StreamingQuery:
    """Load every dump that arrives in ``folder`` into the tables its statements name, below ``root``.

    The stream only tells which files are new (at most ``max_files`` a batch, so their names fit the driver); each batch
    of files goes through ``migrate`` with ``options``: any charset and dialect, statements routed by table, schemas from
    the profiles kept with the tables and widened, rejects aside, the same ledger. The ledger has bytes of file versions by
    table, so a batch that is run again loads what is missing of each table, and files loaded by hand are not loaded twice.
    A file that grows after its batch is for ``migrate`` over the folder: file streams name a file once. ``trigger`` is
    that of the stream; without it, it stops when nothing is left.
    """
    arriving = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(folder).select("path")  # contents are pruned, only the listing is read
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.collect()]
        if not paths:
            return
        try:
            migrate(spark, paths, root, **options)
        except NothingToLoad:  # files without a statement
            pass

    return arriving.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
