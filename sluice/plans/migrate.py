"""Entry points: look at dumps, infer their schema, load them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.dialects import ORACLE, Dialect
from sluice.functions.scale import materialise
from sluice.functions.text import file_table_name, insert_table_name, is_insert
from sluice.operators.profile import infer_schema as _infer_schema
from sluice.operators.profile import fallback_schema, infer_types, merge_profiles, named_values, profile_values, render_ddl, struct_of
from sluice.operators.runlog import file_outcomes, import_summary
from sluice.operators.sampling import preview_statements
from sluice.operators.values import MISPLACED, with_table_names
from sluice.plans.catalog import publish, view_name
from sluice.plans.load import LoadTarget, batch_log, create_database, load_chunks, read_ledger, store_profile, stored_profile
from sluice.session import discard, scratch
from sluice.sources.auto import scan_any
from sluice.sources.dumps import (
    CHUNK_BYTES, DumpScan, assemble, chunk_ranges, insert_statements, read_records, record_offsets, scan, to_statements,
)
from sluice.sources.versions import file_versions
from sluice.sources.manifest import ALLOWED_EXTENSIONS, admit_paths, estimate_by_sample, head_statements, quick_line_estimate

Schema = T.StructType | str
#: where statements are set aside that belong to no table of a load
UNASSIGNED = "_unassigned"


def infer_schema(stmts: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """INSERT statements -> one row per table and column with its type and confidence."""
    return _infer_schema(stmts, tolerance)


def as_struct(schema: Schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def schemas_of(inferred: DataFrame) -> dict[str, T.StructType]:
    """Inferred columns as Spark schemas. Only column descriptions come to the driver."""
    tables: dict[str, list[tuple[int, str, str]]] = {}
    for row in inferred.select("table_name", "pos", "column_name", "sql_type").collect():
        tables.setdefault(row.table_name, []).append((row.pos, row.column_name, row.sql_type))
    return {t: struct_of([(n, s) for _, n, s in sorted(cols)]) for t, cols in tables.items()}


def plan_migration(spark: SparkSession, path: str | list[str], allowed_dirs: Sequence[str] = (),
                   allowed_extensions: Sequence[str] = ALLOWED_EXTENSIONS, dialect: str = "doris") -> DataFrame:
    """What a load would meet, from file heads alone: admission, table, row estimate, preview and DDL per file."""
    checked = materialise(admit_paths(spark, path, allowed_dirs, allowed_extensions=allowed_extensions), "admission")
    admitted = checked.filter("error_code IS NULL")
    stmts = insert_statements(head_statements(admitted.select("file_path", "file_size")))
    stmts = materialise(stmts.withColumn("place", F.struct("ord", "sub")), "head-statements")
    name = insert_table_name(F.col("stmt"))
    named = stmts.groupBy("file_path").agg(
        F.min_by(name, F.when(name.isNotNull(), F.col("place"))).alias("named"))
    previews = preview_statements(stmts, order="place").groupBy("file_path").agg(
        F.array_sort(F.collect_list(F.struct("n", "preview"))).alias("p"))
    ddl = render_ddl(infer_schema(stmts), dialect)
    sizes = admitted.select("file_path", "file_size")
    estimates = quick_line_estimate(sizes).select("file_path", "estimated_rows").join(
        estimate_by_sample(sizes).select("file_path", "estimated_rows_fast"), "file_path", "left")
    return (
        checked.join(named, "file_path", "left")
        .withColumn("table_name", F.coalesce("named", file_table_name(F.col("file_path"))))
        .join(estimates, "file_path", "left")
        .join(previews, "file_path", "left")
        .join(ddl, "table_name", "left")
        .select("file_path", "file_size", "error_code", "table_name",
                F.coalesce("estimated_rows_fast", "estimated_rows").alias("estimated_rows"),
                F.coalesce(F.col("p.preview"), F.array()).alias("preview"), "ddl")
    )


def _placed(stmts: DataFrame, table: str | None) -> DataFrame:
    """Add ``table_name`` to every statement, so that each is loaded or set aside.

    An INSERT whose name cannot be read belongs to ``table``, or to the table its file is named after. Statements that
    are no INSERT, or that name another table than ``table``, go to ``UNASSIGNED``.
    """
    own = F.lit(table) if table else file_table_name(F.col("file_path"))
    named = with_table_names(stmts)
    name = F.coalesce("table_name", F.when(is_insert(F.col("stmt")), own), F.lit(UNASSIGNED))
    return named.withColumn("table_name", F.when(name == table, name).otherwise(UNASSIGNED) if table else name)


class NothingToLoad(ValueError):
    """The paths hold no statement, or no file that is admitted."""


@dataclass
class Source:
    """Statements of dump files, the chunks they come in, and where the records of some chunks begin."""

    stmts: DataFrame
    chunks: DataFrame
    scans: list[DumpScan]

    def offsets(self, splits: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [record_offsets(found, splits) for found in self.scans])


def _source(
    spark: SparkSession, path: str | list[str], separator: str | None, chunk_bytes: int, encoding: str | None, dialect: str | Dialect
) -> Source:
    """Without a charset and a separator each file is read with its own."""
    if separator is None and encoding is None:
        scans = scan_any(spark, path, chunk_bytes, dialect)
    else:
        separator = separator or ";\n"
        encoding = encoding or "utf-8"
        scans = [scan(read_records(spark, path, separator, chunk_bytes, encoding), separator, dialect, encoding)]
    versions = materialise(file_versions(spark, path), "versions")
    stmts = [to_statements(assemble(found), dialect) for found in scans]
    chunks = [chunk_ranges(found, versions) for found in scans]
    return Source(reduce(DataFrame.unionByName, stmts), materialise(reduce(DataFrame.unionByName, chunks), "chunks"), scans)


def _generic_schema(spark: SparkSession, table: str) -> T.StructType:
    """Schema of a table of which no tuple could be read: all its statements will be rejects."""
    return schemas_of(fallback_schema(spark.createDataFrame([(table,)], "table_name string"), "generic"))[table]


def migrate(
    spark: SparkSession,
    path: str | list[str],
    root: str,
    table: str | None = None,
    schemas: Schema | Mapping[str, Schema] | None = None,
    separator: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    encoding: str | None = None,
    tolerance: float = 0.0,
    stop_on_error: bool = True,
    dialect: str | Dialect = ORACLE,
    on_replaced: str = "refuse",
    on_drift: str = "widen",
    admission: Mapping[str, object] | None = None,
    database: str | None = None,
) -> DataFrame:
    """Load dump files into tables below ``root``; returns one summary row per table.

    Every statement is loaded or kept as a reject: with its table, or below ``UNASSIGNED`` where it has none. Dumps of
    several tables are first laid out by table, so each table's load reads its own statements only. ``schemas`` (a
    StructType, DDL, or a mapping by table) overrides inference; a table that neither covers gets the generic schema.
    Charset and line end of each file are found from its head unless they are given. A table that fails does not keep
    the others from being loaded; the first error is raised at the end unless ``stop_on_error`` is off, and the ledger
    holds it either way. Running it again loads what the ledger does not hold: the ledger has bytes of file versions, so
    files may have grown and ``chunk_bytes`` may differ. A file that was replaced is refused, or, with
    ``on_replaced='replace'``, its rows take the place of those loaded before. ``dialect`` is how the dump writes its
    literals: oracle, mysql or ansi.

    The profile a schema is inferred from is kept with its table and merged with that of later loads: types widen to what
    holds all values, columns are added, and earlier rows are read in the wider types. With ``on_drift='reject'`` an
    inferred schema stays as it is and rows that do not fit are rejects.

    ``admission`` has the rules of ``admit_paths``: files are held to them before any is read. The first refused ones are
    named in an error, or, with ``stop_on_error`` off, refused files are passed over. With ``database`` each loaded table
    is published in that database of the catalog, under its name as ``view_name`` writes it.
    """
    if admission is not None:
        path = _admitted(spark, path, admission, stop_on_error)
    if database:
        create_database(spark, database)
    source = _source(spark, path, separator, chunk_bytes, encoding, dialect)
    stmts, chunks = source.stmts, source.chunks
    staged_at, profiles = None, None
    if table is not None and schemas is not None:
        # one pass: statements of other tables are told apart while the table is loaded
        own = with_table_names(stmts)
        stray = F.coalesce(F.col("table_name") != table, F.lit(False))
        tables = {table: own.withColumn(MISPLACED, stray)}
    else:
        staged_at = scratch(spark, "by-table")
        stmts = _placed(stmts, table)
        stmts.write.partitionBy("table_name").parquet(staged_at)
        # with a schema given, names such as 007 are read as they are
        columns = T.StructType([*[f for f in stmts.schema if f.name != "table_name"], T.StructField("table_name", T.StringType())])
        staged = spark.read.schema(columns).parquet(staged_at)
        names = [r.table_name for r in staged.select("table_name").distinct().collect()]
        tables = {n: staged.filter(F.col("table_name") == n).withColumn(MISPLACED, F.lit(n == UNASSIGNED)) for n in names}
        if schemas is None:
            profiles = _profiles(spark, staged.filter(F.col("table_name") != UNASSIGNED), root, names, on_drift)
            schemas = schemas_of(infer_types(profiles, tolerance))
    summary, errors = None, []
    profiled = None if profiles is None else {r.table_name for r in profiles.select("table_name").distinct().collect()}
    try:
        for name, own in tables.items():
            if name == UNASSIGNED:
                schema = T.StructType([])
            elif isinstance(schemas, Mapping):
                schema = as_struct(schemas[name]) if name in schemas else _generic_schema(spark, name)
            else:
                schema = as_struct(schemas)
            target = LoadTarget(root, name)
            try:
                loaded = load_chunks(own, _chunks_of(own, chunks, len(tables)), schema, target, source.offsets, on_replaced)
                if profiled and name in profiled and not loaded.isEmpty():
                    store_profile(profiles.filter(F.col("table_name") == name), target)
                if database and name != UNASSIGNED:
                    publish(spark, target, f"`{database}`.`{view_name(name)}`")
            except Exception as e:  # the ledger holds it; the other tables go on
                errors.append(e)
            done = batch_log(read_ledger(spark, target))
            one = import_summary(done).join(
                done.groupBy("table_name").agg(F.sum("rejected_rows").alias("rejected_rows")), "table_name")
            summary = one if summary is None else summary.unionByName(one)
    finally:
        if staged_at is not None:
            discard(spark, staged_at)
    if errors and stop_on_error:
        raise errors[0]
    if summary is None:
        raise NothingToLoad(f"no statement in {path}")
    return summary


def _admitted(spark: SparkSession, path: str | list[str], rules: Mapping[str, object], stop: bool) -> str | list[str]:
    """The paths themselves if all their files are admitted, else the admitted files (which the reader lists on the
    driver anyway)."""
    checked = materialise(admit_paths(spark, path, **rules), "admission")
    refused = checked.filter("error_code IS NOT NULL").select("file_path", "error_code").limit(4).collect()
    if not refused:
        return path
    if stop:
        raise ValueError("not admitted: " + ", ".join(f"{r.file_path} ({r.error_code})" for r in refused[:3])
                         + (" and others" if len(refused) > 3 else ""))
    files = [r.file_path for r in checked.filter("error_code IS NULL").select("file_path").collect()]
    if not files:
        raise NothingToLoad(f"no file of {path} is admitted")
    return files


def _profiles(spark: SparkSession, stmts: DataFrame, root: str, names: list[str], on_drift: str) -> DataFrame:
    """Profiles of the statements merged with those that are kept; on ``reject`` a kept profile stands alone."""
    fresh = profile_values(named_values(stmts), text_stats=False, usual_arity=True)
    kept = [p for p in (stored_profile(spark, LoadTarget(root, n)) for n in names if n != UNASSIGNED) if p is not None]
    if kept:
        known = reduce(DataFrame.unionByName, kept)
        if on_drift == "reject":
            fresh = fresh.join(known.select("table_name").distinct(), "table_name", "left_anti")
        fresh = fresh.unionByName(known)
    return materialise(merge_profiles(fresh), "profiles")


def _chunks_of(own: DataFrame, chunks: DataFrame, n_tables: int) -> DataFrame:
    """Chunks a table has statements in; with one table those are all chunks."""
    return chunks if n_tables == 1 else chunks.join(own.select("file_path", "chunk_id").distinct(), ["file_path", "chunk_id"], "left_semi")


def migrate_files(spark: SparkSession, path: str | list[str], root: str, **options) -> DataFrame:
    """Load many files in one go: ``file_path, success`` per file. Files that are not admitted are no success."""
    rules = options.get("admission")
    refused = None
    if rules is not None:
        checked = materialise(admit_paths(spark, path, **rules), "admission")
        refused = checked.filter("error_code IS NOT NULL").select("file_path", F.lit(False).alias("success"))
    try:
        summary = migrate(spark, path, root, stop_on_error=False, **options)
    except NothingToLoad:
        if refused is None or refused.isEmpty():
            raise
        return refused
    tables = [r.table_name for r in summary.select("table_name").collect()]
    logs = reduce(DataFrame.unionByName, [read_ledger(spark, LoadTarget(root, t)) for t in tables])
    loaded = file_outcomes(batch_log(logs))
    return loaded if refused is None else loaded.unionByName(refused, allowMissingColumns=True)
