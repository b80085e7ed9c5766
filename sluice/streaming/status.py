"""Live state per task from a stream of task events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.runlog import latest_status


def status_stream(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest state of each task in the state store; every batch writes the tasks that changed."""

    def publish(changed: DataFrame, batch_id: int) -> None:
        changed.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target)

    return (
        latest_status(events).writeStream.outputMode("update").foreachBatch(publish)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_status(spark: SparkSession, target: str) -> DataFrame:
    """Newest published row per task."""
    published = spark.read.parquet(target)
    columns = [c for c in published.columns if c not in ("task_id", "batch_id")]
    return published.groupBy("task_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("s")).select("task_id", "s.*")
