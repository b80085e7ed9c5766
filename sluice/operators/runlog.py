"""Analytics over the run log.

Batch log: task_id, table_name, ts, status (completed | failed), affected_rows, seconds, error_message.
Task log: task_id, ts, event_id, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.scale import running_totals

# States of a migration task.
TASK_STATES = [
    "pending", "parsing", "inferring", "waiting_confirmation", "ddl_confirmed", "importing", "completed", "failed",
    "cancelled",
]
# States a task does not leave.
TERMINAL_STATES = ["completed", "failed", "cancelled"]
# State -> event sent to whoever follows the task; other states send none.
STATE_EVENTS = [
    ("waiting_confirmation", "schema_inferred"),
    ("importing", "import_progress"),
    ("completed", "import_completed"),
    ("failed", "task_failed"),
]
# Fixed value: shortest time a rate is computed for, in seconds.
MIN_SECONDS = 0.001


def rows_per_second(rows: Column, seconds: Column) -> Column:
    return rows / F.greatest(seconds, F.lit(MIN_SECONDS))


def _exact_sum(c: Column) -> Column:
    """Sum of seconds in decimal, so the result does not depend on the order of the rows."""
    return F.sum(c.cast("decimal(18,6)")).cast("double")


def import_summary(log: DataFrame) -> DataFrame:
    """Outcome per table; rows count only for batches that succeeded. Error texts are ``import_errors``."""
    ok = F.col("status") == "completed"
    return log.groupBy("table_name").agg(
        F.count("*").alias("total_tasks"),
        F.count_if(ok).alias("completed_tasks"),
        F.count_if(~ok).alias("failed_tasks"),
        F.coalesce(F.sum(F.when(ok, F.col("affected_rows"))), F.lit(0)).alias("total_rows_imported"),
        _exact_sum(F.col("seconds")).alias("total_execution_time"),
    ).withColumn("success", F.col("failed_tasks") == 0).withColumn(
        "rows_per_second", rows_per_second(F.col("total_rows_imported"), F.col("total_execution_time"))
    )


def latest_attempts(log: DataFrame) -> DataFrame:
    """One row per task: its latest attempt, a completed one if there is any. Earlier failures no longer count."""
    newest = F.struct((F.col("status") == "completed").alias("done"), "ts")
    row = F.struct(*[F.col(c) for c in log.columns])
    return log.groupBy("task_id").agg(F.max_by(row, newest).alias("r")).select("r.*")


def import_errors(log: DataFrame) -> DataFrame:
    """Every error as a row: a table with millions of them must not become one list in one task."""
    return log.filter("status <> 'completed'").select("table_name", "task_id", "error_message")


def progress(log: DataFrame) -> DataFrame:
    """Running completed, failed and percent per table, after each batch in time order."""
    ok = F.col("status") == "completed"
    totals = log.groupBy("table_name").agg(F.count("*").alias("total_tasks"))
    running = running_totals(
        log, ["table_name"], ["ts", "task_id"],
        {"completed_tasks": ok.cast("int"), "failed_tasks": (~ok).cast("int")},
    )
    done = F.col("completed_tasks") + F.col("failed_tasks")
    return running.join(totals, "table_name").withColumn("progress_percent", done / F.col("total_tasks") * 100)


def file_outcomes(log: DataFrame, file: str = "file_path") -> DataFrame:
    """Per file: did all its batches succeed."""
    return log.groupBy(file).agg(F.bool_and(F.col("status") == "completed").alias("success"))


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if("success").alias("success_count"), F.count("*").alias("total_count"))


def metrics_rollup(metrics: DataFrame, baseline: str | None = None) -> DataFrame:
    """Per configuration and variant (columns config, variant, seconds, ok): mean, best and worst time of the
    runs that succeeded, success rate, rank, speed-up of the fastest, and improvement over ``baseline``."""
    ok = F.col("ok")
    runs = metrics.groupBy("config", "variant").agg(
        (_exact_sum(F.when(ok, F.col("seconds"))) / F.count_if(ok)).alias("avg_time"),
        F.min(F.when(ok, F.col("seconds"))).alias("min_time"),
        F.max(F.when(ok, F.col("seconds"))).alias("max_time"),
        (F.count_if(ok) / F.count("*")).alias("success_rate"),
    )
    per_config = Window.partitionBy("config")
    ranked = per_config.orderBy(F.col("avg_time").asc_nulls_last(), "variant")
    out = runs.withColumn("rank", F.row_number().over(ranked)).withColumn(
        "speedup", F.min("avg_time").over(per_config) / F.col("avg_time")
    )
    if baseline is not None:
        base = F.max(F.when(F.col("variant") == baseline, F.col("avg_time"))).over(per_config)
        out = out.withColumn("improvement_percent", (base - F.col("avg_time")) / base * 100)
    return out


def latest_status(log: DataFrame) -> DataFrame:
    """State of each task: its latest event. One row per task leaves each partition before the shuffle."""
    newest = F.struct("ts", "event_id")
    return log.groupBy("task_id").agg(
        F.max_by("status", newest).alias("status"), F.max("ts").alias("last_update"), F.count("*").alias("n_events"))


def status_events(latest: DataFrame) -> DataFrame:
    """The event each task's state sends."""
    mapping = F.create_map(*[F.lit(x) for pair in STATE_EVENTS for x in pair])
    return latest.withColumn("event", F.try_element_at(mapping, F.col("status"))).filter("event IS NOT NULL")


def status_overview(latest: DataFrame) -> DataFrame:
    return latest.groupBy("status").agg(F.count("*").alias("n_tasks"))


def task_duration(log: DataFrame) -> DataFrame:
    """Seconds from the first event of a task to its first terminal one; NULL while there is none."""
    ended = F.min(F.when(F.col("status").isin(*TERMINAL_STATES), F.col("ts")))
    return log.groupBy("task_id").agg(F.min("ts").alias("created_at"), ended.alias("ended_at")).withColumn(
        "seconds", F.timestamp_diff("MICROSECOND", "created_at", "ended_at") / F.lit(1e6))


def drop_cancelled(log: DataFrame) -> DataFrame:
    """Events of tasks that were never cancelled. The cancelled side has one row per task, so a task that
    holds most events can be split by AQE."""
    return log.join(log.filter("status = 'cancelled'").select("task_id").distinct(), "task_id", "left_anti")
