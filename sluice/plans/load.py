"""Target tables and chunk-tracked loads."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.scale import broadcast_if_small, materialise
from sluice.operators.chunks import pending_chunks
from sluice.operators.intervals import is_covered, merged, with_cover
from sluice.operators.profile import infer_types, struct_of
from sluice.operators.runlog import latest_attempts
from sluice.operators.values import good_rows, rejected_rows, typed_rows
from sluice.sources.versions import VERSION, compare_versions

#: bytes of a file that a chunk stands for, and the version of the file
_RANGE = {"begin_byte": "long", "end_byte": "long", "tail_byte": "long", "open_end": "boolean", "file_size": "long",
          "modified": "timestamp", "head_hash": "string", "tail_hash": "string"}
LEDGER_SCHEMA = (
    "table_name string, run_id string, file_path string, chunk_id long, status string, affected_rows long, rejected_rows long, "
    "seconds double, error_message string, ts timestamp, schema_json string, " + ", ".join(f"{n} {t}" for n, t in _RANGE.items())
)
_CHUNK_KEYS = ["file_path", "chunk_id"]
_VERSION_OF = ["file_path", "open_end", *VERSION]
#: where a loaded row came from, kept beside its own columns
ORIGIN = ["_file_path", "_chunk_id"]


# ---- tables in the catalog -------------------------------------------------------------------------------

def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`" + (f" LOCATION '{location}'" if location else ""))


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def create_table(spark: SparkSession, name: str, schema: T.StructType, drop_if_exists: bool = False,
                 location: str | None = None) -> bool:
    """Create an empty table. An existing one is kept (returns False) unless it is to be dropped first."""
    if drop_if_exists:
        drop_table(spark, name)
    elif spark.catalog.tableExists(name):
        return False
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet" + (f" LOCATION '{location}'" if location else ""))
    return True


def create_and_load(df: DataFrame, name: str, if_exists: str = "overwrite", location: str | None = None) -> bool:
    """Load a DataFrame as a table: ``overwrite`` drops and recreates, ``ignore`` skips an existing table,
    ``append`` adds rows. Returns whether rows were written."""
    spark = df.sparkSession
    exists = spark.catalog.tableExists(name)
    if exists and if_exists == "ignore":
        return False
    writer = df.write.mode("append" if exists and if_exists == "append" else "overwrite")
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(name)
    return True


def append_jdbc(df: DataFrame, url: str, table: str, batch_rows: int = 1000, connections: int = 8,
                properties: dict[str, str] | None = None) -> None:
    """Batch insert into another database: one connection and transaction per partition, rows in batches.

    ``connections`` bounds what the target must bear. The rows are shuffled to as many tasks, so that scan and parse
    before it keep all of theirs.
    """
    df.repartition(connections).write.option("batchsize", batch_rows).jdbc(url, table, "append", properties or {})


# ---- chunk-tracked load ----------------------------------------------------------------------------------

@dataclass
class LoadTarget:
    """Folders of one loaded table: data, rejected rows and the ledger of chunks."""

    root: str
    table: str

    @property
    def folder(self) -> str:
        """The table's name; characters that a path cannot hold are written as _ and their code."""
        return re.sub(r"[^\w$#. -]", lambda m: f"_{ord(m.group()):x}_", self.table)

    @property
    def data(self) -> str:
        return f"{self.root}/{self.folder}/data"

    @property
    def rejects(self) -> str:
        return f"{self.root}/{self.folder}/rejects"

    @property
    def profiles(self) -> str:
        return f"{self.root}/{self.folder}/profiles"

    @property
    def ledger(self) -> str:
        return f"{self.root}/{self.folder}/ledger"


def _read_or_none(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_ledger(spark: SparkSession, target: LoadTarget) -> DataFrame:
    return _read_or_none(spark, target.ledger, LEDGER_SCHEMA)


def void_files(gone: DataFrame) -> DataFrame:
    """Files of runs that superseded ledger rows make void."""
    return gone.select(F.col("run_id").alias("void_run"), F.col("file_path").alias("void_file")).distinct()


def _without(rows: DataFrame, gone: DataFrame, run: str, file: str) -> DataFrame:
    """Rows but those of files in runs that a replaced file made void."""
    void = materialise(void_files(gone), "superseded")
    return rows.join(broadcast_if_small(void), (F.col(run) == F.col("void_run")) & (F.col(file) == F.col("void_file")), "left_anti")


def active_rows(ledger: DataFrame) -> DataFrame:
    """Ledger rows that count: not those of replaced files, nor failures whose bytes another run has loaded since."""
    rows = ledger.filter("status <> 'superseded'")
    gone = ledger.filter("status = 'superseded'")
    rows = rows if gone.isEmpty() else _without(rows, gone, "run_id", "file_path")
    if rows.filter("status = 'failed'").isEmpty():
        return rows
    done = rows.filter("status = 'completed'").select(
        F.col("file_path").alias("f"), F.col("ts").alias("t"), F.col("begin_byte").alias("b"), F.col("end_byte").alias("e"))
    mended = (F.col("status") == "failed") & (F.col("file_path") == F.col("f")) & (F.col("ts") <= F.col("t")) & (
        F.col("begin_byte") < F.col("e")) & (F.col("end_byte") > F.col("b"))
    return rows.join(done, mended, "left_anti")


# ---- the schema that is kept with a table ----------------------------------------------------------------

PROFILE_SCHEMA = ("table_name string, column_name string, pos int, n long, n_null long, n_int long, n_dec long, n_float long, n_date long, "
                  "n_stamp long, max_len int, int_digits int, scale int, magnitude decimal(20,0), version long")


def stored_profile(spark: SparkSession, target: LoadTarget) -> DataFrame | None:
    """The profile of all values a table was ever inferred from; None if its schema was never inferred."""
    every = _read_or_none(spark, target.profiles, PROFILE_SCHEMA)
    latest = every.agg(F.max("version")).first()[0]
    return None if latest is None else every.filter(F.col("version") == latest).drop("version")


def store_profile(profile: DataFrame, target: LoadTarget) -> None:
    """Keep a profile with its table. Earlier versions stay, readers take the last."""
    known = _read_or_none(profile.sparkSession, target.profiles, PROFILE_SCHEMA).agg(F.max("version")).first()[0]
    columns = T.StructType.fromDDL(PROFILE_SCHEMA)
    numbered = profile.withColumn("version", F.lit((known or 0) + 1))
    numbered.select(*[F.col(f.name).cast(f.dataType) for f in columns]).coalesce(1).write.mode("append").parquet(target.profiles)


def table_schema(spark: SparkSession, target: LoadTarget) -> T.StructType:
    """The schema of a table: what its stored profile says, else that of its last run."""
    profile = stored_profile(spark, target)
    if profile is not None:
        rows = infer_types(profile).orderBy("pos", "column_name").collect()
        return struct_of([(r.column_name, r.sql_type) for r in rows])
    last = read_ledger(spark, target).filter("status = 'completed'").agg(F.max_by("schema_json", "ts")).first()[0]
    if last is None:
        raise ValueError(f"nothing was loaded into {target.table}")
    return T.StructType.fromJson(json.loads(last))


def run_schema(written: str | None, schema: T.StructType) -> T.StructType:
    """The types a run was written in, as its ledger rows have them; those of ``schema`` where they do not say."""
    return schema if written is None else T.StructType.fromJson(json.loads(written))


def _in_schema(spark: SparkSession, paths: list[str], written: str | None, schema: T.StructType, origin: list[T.StructField]) -> DataFrame:
    """Run folders read with the types they were written in, as columns of ``schema``; a column they lack is null."""
    own = run_schema(written, schema)
    names = {f.name for f in own}
    stored = spark.read.schema(T.StructType([*own.fields, *[f for f in origin if f.name not in names]])).parquet(*paths)
    return stored.select(*[(F.col(f"`{f.name}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema],
                         *[F.col(f.name) for f in origin], F.col("_metadata.file_path").alias("_run_file"))


def committed_runs(ledger: DataFrame, folder: str, condition: str, typed: bool) -> dict[tuple[bool, str | None], list[str]]:
    """Folders of the runs the ledger holds, by whether some of their files were replaced and by the types they have."""
    touched = {r.run_id for r in ledger.filter("status = 'superseded'").select("run_id").distinct().collect()}
    wanted = ledger.filter("status = 'completed'").filter(condition)
    kinds: dict[tuple[bool, str | None], list[str]] = {}
    for r in wanted.groupBy("run_id").agg(F.first("schema_json").alias("schema_json")).orderBy("run_id").collect():
        kinds.setdefault((r.run_id in touched, r.schema_json if typed else None), []).append(f"{folder}/run={r.run_id}")
    return kinds


def _committed(spark: SparkSession, target: LoadTarget, folder: str, condition: str, schema: T.StructType | str, typed: bool) -> DataFrame:
    """Rows of the runs the ledger holds. A run that failed left files nobody reads, a replaced file's rows are passed over.

    The runs of a table may differ in their types (``typed``); each kind is a read of its own.
    """
    ledger = read_ledger(spark, target)
    gone = ledger.filter("status = 'superseded'")
    kinds = committed_runs(ledger, folder, condition, typed)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    file = T.StructField(ORIGIN[0], T.StringType())
    out = None
    for (mixed, written), paths in kinds.items():
        rows = _in_schema(spark, paths, written, schema, [file] if mixed and file.name not in schema.names else [])
        if mixed:
            run = F.regexp_extract("_run_file", r"/run=([0-9a-f]+)/", 1)
            rows = _without(rows.withColumn("_run", run), gone, "_run", ORIGIN[0])
        rows = rows.select(*[F.col(f"`{f.name}`") for f in schema])
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema) if out is None else out


def read_table(spark: SparkSession, target: LoadTarget, schema: T.StructType | None = None) -> DataFrame:
    """The rows of a table, in the schema that is kept with it unless another is given."""
    return _committed(spark, target, target.data, "affected_rows > 0", schema or table_schema(spark, target), True)


def read_rejects(spark: SparkSession, target: LoadTarget) -> DataFrame:
    schema = "raw string, reason string, _file_path string, _chunk_id long"
    return _committed(spark, target, target.rejects, "rejected_rows > 0", schema, False)


def _write_run(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def _count_chunks(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows per chunk of what was written; only the two origin columns are read back."""
    return spark.read.parquet(path).groupBy(*ORIGIN).agg(F.count("*").alias(name)).select(
        F.col("_file_path").alias("file_path"), F.col("_chunk_id").alias("chunk_id"), name)


@dataclass
class Resumption:
    """What is left to load of a source."""

    chunks: DataFrame  # the chunks that this run works on
    pending: DataFrame  # their statements
    superseded: DataFrame | None = None  # ledger rows that say which runs a replaced file makes void


def _resume_by_ranges(stmts: DataFrame, chunks: DataFrame, ledger: DataFrame,
                      offsets: Callable[[DataFrame], DataFrame] | None, on_replaced: str) -> Resumption:
    """Difference of what the source holds and what the ledger holds, both as sets of bytes of files.

    A chunk of which nothing is loaded is taken whole, one that is loaded is passed over whatever its number was, and of
    one that is partly loaded those statements are taken that begin outside of the loaded bytes.
    """
    done = active_rows(ledger).filter("status = 'completed'")
    newest = done.groupBy("file_path").agg(F.max_by(F.struct(*_VERSION_OF[1:]), F.struct("file_size", "ts")).alias("v"))
    current = chunks.select("file_path", *VERSION).distinct()
    states = materialise(compare_versions(newest.select("file_path", "v.*"), current), "file-states")
    replaced = states.filter("state = 'replaced'").select("file_path")
    named = [r.file_path for r in replaced.limit(4).collect()]
    superseded = None
    if named and on_replaced != "replace":
        raise ValueError(f"files were changed since they were loaded, which doubles or loses rows: {', '.join(named[:3])}"
                         f"{' and others' if len(named) > 3 else ''}; load them with on_replaced='replace'")
    if named:
        superseded = done.join(replaced, "file_path", "left_semi").select(
            "table_name", "run_id", "file_path", F.lit("superseded").alias("status")).distinct()
        done = done.join(replaced, "file_path", "left_anti")
    sizes = current.select("file_path", F.col("file_size").alias("size_now")).distinct()
    # a last statement without an end is loaded again once its file has grown
    cut = F.when((F.col("size_now") > F.col("file_size")) & F.col("tail_byte").isNotNull(), F.least("end_byte", "tail_byte")).otherwise(F.col("end_byte"))
    loaded = merged(done.join(sizes, "file_path").select("file_path", "begin_byte", cut.alias("end_byte")), ["file_path"])
    marked = materialise(with_cover(chunks, loaded, ["file_path"]).filter("state <> 'all'"), "pending")
    whole = marked.filter("state = 'none'").select(*_CHUNK_KEYS)
    pending = stmts.join(broadcast_if_small(materialise(whole, "pending-whole")), _CHUNK_KEYS, "left_semi")
    partly = marked.filter("state = 'part'")
    if offsets is not None and not partly.isEmpty():
        places = offsets(partly).filter(~is_covered(F.col("begin_byte"), F.col("covers"))).select("file_path", "block_start", "ord")
        pending = pending.unionByName(stmts.join(broadcast_if_small(materialise(places, "pending-part")), ["file_path", "block_start", "ord"], "left_semi"))
    return Resumption(marked.drop("covers", "state"), pending, superseded)


def load_chunks(stmts: DataFrame, chunks: DataFrame, schema: T.StructType, target: LoadTarget,
                offsets: Callable[[DataFrame], DataFrame] | None = None, on_replaced: str = "refuse") -> DataFrame:
    """Load what the ledger does not hold yet; returns the ledger rows of this run.

    ``stmts``: INSERT statements of one table with file_path and chunk_id; ``chunks``: all chunks of the source. With the
    columns of ``dumps.chunk_ranges``, what is loaded is told by bytes of file versions: chunks may be cut anew, files may
    grow, and a file that was replaced is refused, or with ``on_replaced='replace'`` takes the place of its old rows.
    ``offsets`` then gives where the records of partly loaded chunks begin. Without these columns chunks are told by
    their number. Every run writes a folder of its own, straight from the scan: no shuffle, no sort. The ledger is
    written last, and only runs it names are ever read, so a run that dies leaves nothing to undo. Rows that
    do not fit are counted on the way and written in a second pass only when there are any.
    """
    spark = stmts.sparkSession
    run = uuid.uuid4().hex
    ledger = read_ledger(spark, target)
    fresh = ledger.filter("status = 'completed'").isEmpty()
    ranged = "begin_byte" in chunks.columns
    todo, pending, superseded = (chunks if ranged else chunks.select(*_CHUNK_KEYS).distinct()), stmts, None
    if not fresh:  # a first load takes every chunk, so nothing has to be joined to the statements
        if ranged:
            left = _resume_by_ranges(stmts, chunks, ledger, offsets, on_replaced)
            todo, pending, superseded = left.chunks, left.pending, left.superseded
        else:
            todo = materialise(pending_chunks(todo, ledger), "pending")
            pending = stmts.join(broadcast_if_small(todo), _CHUNK_KEYS, "left_semi")
        if todo.isEmpty():
            return spark.createDataFrame([], LEDGER_SCHEMA)
    rows = typed_rows(pending, schema, _CHUNK_KEYS).withColumnsRenamed(dict(zip(_CHUNK_KEYS, ORIGIN)))
    seen = Observation()
    watched = rows.observe(seen, F.count_if(F.col("_reason").isNotNull()).alias("bad"))
    data, rejects = f"{target.data}/run={run}", f"{target.rejects}/run={run}"
    begun = time.time()
    try:
        _write_run(good_rows(watched).select(*schema.names, *ORIGIN), data)
        # a retried task may count twice, never too little: 0 means no rejects
        bad = seen.get["bad"]
        if bad:
            _write_run(rejected_rows(rows, ORIGIN), rejects)
    except Exception as e:
        _log(todo, target, run, "failed", time.time() - begun, str(e), [], schema)
        raise
    counts = [_count_chunks(spark, data, "affected_rows")]
    if bad:
        counts.append(_count_chunks(spark, rejects, "rejected_rows"))
    return _log(todo, target, run, "completed", time.time() - begun, None, counts, schema, superseded)


def _log(todo: DataFrame, target: LoadTarget, run: str, status: str, seconds: float, error: str | None,
         counts: list[DataFrame], schema: T.StructType, superseded: DataFrame | None = None) -> DataFrame:
    """Ledger rows are written after the data of their chunks, all in one commit, together with what makes the rows of
    replaced files void. Chunks of a run are loaded side by
    side, so each gets an equal share of its seconds: the rows of a run sum up to its time."""
    out, share = todo, seconds / max(1, todo.count())
    for c in counts:
        out = out.join(c, _CHUNK_KEYS, "left")
    for name in ("affected_rows", "rejected_rows"):
        out = out.withColumn(name, F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))
                             if name in out.columns else F.lit(0).cast("long"))
    rows = out.select(
        F.lit(target.table).alias("table_name"), F.lit(run).alias("run_id"), "file_path", "chunk_id",
        F.lit(status).alias("status"), "affected_rows", "rejected_rows", F.lit(share).alias("seconds"),
        F.lit(error).cast("string").alias("error_message"), F.current_timestamp().alias("ts"), F.lit(schema.json()).alias("schema_json"),
        *[(F.col(n) if n in out.columns else F.lit(None)).cast(t).alias(n) for n, t in _RANGE.items()],
    )
    if superseded is not None:
        rows = rows.unionByName(superseded.withColumn("ts", F.current_timestamp()), allowMissingColumns=True)
    rows.write.mode("append").parquet(target.ledger)
    return read_ledger(todo.sparkSession, target).filter(F.col("run_id") == run)


def batch_log(ledger: DataFrame) -> DataFrame:
    """Ledger rows as the batch log the run analytics read: the latest attempt of every chunk that counts."""
    name = F.concat_ws("-", "table_name", F.hex(F.xxhash64("file_path")), "chunk_id", "begin_byte", "end_byte")
    return latest_attempts(active_rows(ledger).withColumn("task_id", name))
