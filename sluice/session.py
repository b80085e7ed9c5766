"""Session helpers: a local session for tests and bench, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "sluice", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings every job here assumes (AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SLUICE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    The setting is only read. Where it is unset, a session on one machine (master ``local``) gets a temporary folder
    and any other is refused: a machine-local folder would scatter the parts of a table over executors.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = context.getCheckpointDir() or tempfile.mkdtemp(prefix="sluice-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
        root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    return root.rstrip("/")


#: rows handed to a Python worker at once where they hold whole texts; at 64 KB a text and eight copies of it, 128 MB
TEXT_ROWS = 250


def hold_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Hold the session's Arrow batches to ``rows`` rows; a smaller setting stays. Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal few bytes with much work in each row over the cluster: a small file is one task whatever its rows cost. The
    number is given, as adaptive execution would join such small partitions again."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that ``scratch`` named, through the filesystem that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return f"{shared_dir(spark)}/sluice/{label}-{uuid.uuid4().hex}"
