"""Statement source: SQL dump files as a DataFrame of statements.

A dump is read by Spark's text source with ``;`` + newline as the record separator, so files of any size
split. A record is a whole statement unless a literal or a comment holds ``;`` + newline. Those files - and only
those - take a second path that glues records together, balanced over the splits of the file.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.charset import decode_ignore, decode_strict
from sluice.functions.dialects import ORACLE, Dialect, dialect_of, standard_literals
from sluice.functions.literals import DOUBLE_QUOTED, QUOTED, trim_end
from sluice.functions.scale import broadcast_if_small, materialise
from sluice.functions.text import is_insert, strip_comments, strip_leading_noise
from sluice.sources.lexer import START, leaves_in, statement_heads, transitions, whole_statement
from sluice.sources.ranges import file_uri
from sluice.sources.versions import VERSION

# Fixed value: default chunk of a load, 30 MB. Use 256 MB or more from a few TB up.
CHUNK_BYTES = 30 * 1024 * 1024

#: one statement of a record that holds several: a ``;`` outside literals and comments ends it
_PIECE = rf"""(?s)(?:{QUOTED}|{DOUBLE_QUOTED}|--[^\n]*+|/\*.*?\*/|[^;'"/-]++|['"/-])++"""
_SPLIT_KEY = ["file_path", "block_start"]


#: what a record is known by, its text, and whether bytes of it did not fit the charset
_RECORD = ["file_path", "block_start", "chunk_id", "ord", "value", "bad_bytes"]


@dataclass
class DumpScan:
    """Records of a set of dump files, and the small table of their splits (one row per split)."""

    records: DataFrame  # file_path, block_start, chunk_id, ord, value, bad_bytes, n_raw, file_size
    splits: DataFrame  # file_path, block_start, chunk_id, n_records, n_bytes, n_open, file_size, last
    separator: str = ";\n"
    dialect: Dialect = ORACLE
    separator_bytes: int = 2
    broken: DataFrame | None = None  # file_path of files that end inside a literal; known once assembled


def fixed_split_session(spark: SparkSession, split_bytes: int) -> SparkSession:
    """A sibling session whose file splits depend on ``split_bytes`` alone.

    Chunk ids must not change when executors come or go, so the number of cores has to stay out of the
    split size (``minPartitionNum`` = 1). The caller's own session keeps its settings.
    """
    sibling = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and sibling.conf.isModifiable(key):
            sibling.conf.set(key, value)
    sibling.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    sibling.conf.set("spark.sql.files.minPartitionNum", "1")
    return sibling


def _rebind(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Hand a DataFrame of the sibling session to the caller's session."""
    name = "sluice_" + uuid.uuid4().hex
    df.createGlobalTempView(name)
    try:
        return spark.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


def keyed(raw: DataFrame, chunk_bytes: int) -> DataFrame:
    """Text rows with ``_metadata`` -> records keyed by file, split and order inside the split."""
    return raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.floor(F.col("_metadata.file_block_start") / F.lit(chunk_bytes)).cast("long").alias("chunk_id"),
        F.monotonically_increasing_id().alias("ord"),
        "value", F.octet_length("value").alias("n_raw"), F.col("_metadata.file_size").alias("file_size"),
    )


def valid_utf8(records: DataFrame) -> DataFrame:
    """Raw records with ``bad_bytes``; bytes that are no UTF-8 are left out of ``value``."""
    clean = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    flagged = records.withColumn("bad_bytes", ~F.is_valid_utf8("value"))
    return flagged.withColumn("value", F.when(F.col("bad_bytes"), clean).otherwise(F.col("value")))


def read_records(
    spark: SparkSession,
    paths: str | Sequence[str],
    separator: str = ";\n",
    chunk_bytes: int = CHUNK_BYTES,
    encoding: str = "utf-8",
) -> DataFrame:
    """Records of the dumps. Files are split at the separator in their own charset and decoded after: it is single ASCII
    bytes in UTF-8, GBK, Big5 and Latin-1, and code units of two or four bytes in UTF-16 and UTF-32, whose byte order the
    name must give (``utf-16-le``). A split may begin inside a code unit; records never do, see ``misaligned``.

    Bytes that do not fit the charset are left out of ``value``, and ``bad_bytes`` says so.
    """
    reader = fixed_split_session(spark, chunk_bytes).read.option("lineSep", separator.encode(encoding).decode("latin1"))
    raw = reader.option("recursiveFileLookup", "true").text(paths if isinstance(paths, str) else list(paths))
    records = _rebind(spark, keyed(raw, chunk_bytes))
    if encoding.lower() in ("utf-8", "utf8", "ascii"):
        return valid_utf8(records)
    data, charset = F.col("value").cast("binary"), F.lit(encoding)
    tried = records.withColumn("strict", decode_strict(data, charset))
    # only records that do not fit are decoded once more
    lossy = decode_ignore(F.when(F.col("strict").isNull(), data), charset)
    out = tried.withColumn("value", F.coalesce("strict", lossy)).withColumn("bad_bytes", F.col("strict").isNull()).drop("strict")
    return out.withColumn("value", F.regexp_replace("value", r"\A\x{feff}", "")) if unit_bytes(encoding) > 1 else out


def unit_bytes(encoding: str) -> int:
    """Bytes of a code unit."""
    return 4 if encoding.lower().startswith("utf-32") else 2 if encoding.lower().startswith("utf-16") else 1


def misaligned(found: DumpScan) -> bool:
    """Whether a separator was seen across code units. Its bytes can stand so only inside rows of rare characters, such as
    U+4100 U+3B00 U+0A41; files that hold one have to be read whole."""
    return not found.splits.filter("n_uneven > 0").isEmpty()


def scan(records: DataFrame, separator: str = ";\n", dialect: str | Dialect = ORACLE, encoding: str = "utf-8") -> DumpScan:
    """One pass over the records for the per-split totals; partial sums meet in one row per split.

    ``n_bytes`` are bytes of the file, ``n_open`` counts records after which, read alone, a statement goes on, and
    ``last`` has the size of the split's last record and whether it is a whole statement.
    """
    dialect = dialect_of(dialect)
    sep_bytes = len(separator.encode(encoding))
    ended = F.rtrim(F.right("value", F.lit(64)), F.lit(" \t\r\n"))
    # only what ends in one of these is looked at: cutting text by characters counts all of them
    may_end = reduce(Column.__or__, [F.endswith("value", F.lit(ch)) for ch in "; \t\r\n"], F.col("value") == "")
    totals = records.groupBy("file_path", "block_start", "chunk_id").agg(
        F.count("*").alias("n_records"),
        F.sum(F.col("n_raw") + F.lit(sep_bytes)).cast("long").alias("n_bytes"),
        F.count_if(F.col("n_raw") % unit_bytes(encoding) != 0).alias("n_uneven"),
        F.count_if(leaves_in(F.col("value"), dialect) != START).alias("n_open"),
        F.max("file_size").alias("file_size"),
        # numbers and flags only: a struct or a text in the buffer would have every record sorted by split
        F.max_by(F.col("n_raw").cast("long"), "ord").alias("last_raw"),
        F.max_by(may_end & (ended.endswith(";") | (ended == "")), "ord").alias("last_whole"),
    )
    splits = totals.withColumn("last", F.struct(F.col("last_raw").alias("n_raw"), F.col("last_whole").alias("whole"))).drop("last_raw", "last_whole")
    return DumpScan(records, materialise(splits, "splits"), separator, dialect, sep_bytes)


def _open_files(found: DumpScan) -> DataFrame | None:
    """Files in which a statement may go on behind a separator; None if there are none, which is the usual case."""
    open_splits = found.splits.filter("n_open > 0")
    return None if open_splits.isEmpty() else materialise(open_splits.select("file_path").distinct(), "open-files")


def _assemble_open_files(found: DumpScan, files: DataFrame) -> DataFrame:
    """Glue the records of statements whose literals or comments hold the separator.

    Each split is scanned on its own for every state it may be entered in, and hands on to the next only the state it
    leaves in and its last statement start. No group is larger than a split or a statement.
    """
    own = found.records.join(broadcast_if_small(files), "file_path", "left_semi").select(*_RECORD)
    stored = materialise(own, "records")
    marked, states = transitions(stored, found.dialect)
    inside, per_split = statement_heads(marked.select("file_path", "block_start", "chunk_id", "ord", "leaves"), states)
    ends = materialise(per_split, "split-states")
    found.broken = ends.filter("broken").select("file_path").distinct()
    known = stored.join(inside, [*_SPLIT_KEY, "ord"]).join(broadcast_if_small(ends), _SPLIT_KEY)
    start = F.get("heads", F.col("enters"))
    here = F.struct(F.col("block_start"), F.col("chunk_id"), F.col("ord"))
    carried = F.struct(F.col("head_block").alias("block_start"), F.col("head_chunk").alias("chunk_id"), F.col("head_ord").alias("ord"))
    # a file that ends inside a literal is broken: its records stand alone and the parser sorts them out
    head = (
        F.when(F.col("broken"), here)
        .when(start >= 0, F.struct(F.col("block_start"), F.col("chunk_id"), start.alias("ord")))
        .when(F.col("head_ord").isNotNull(), carried).otherwise(here)
    )
    parts = F.array_sort(F.collect_list(F.struct("block_start", "ord", "value")))
    glued = known.withColumn("head", head).groupBy("file_path", "head").agg(parts.alias("parts"), F.bool_or("bad_bytes").alias("bad_bytes"))
    return glued.select(
        "file_path", "head.block_start", "head.chunk_id", "head.ord",
        F.array_join(F.col("parts.value"), found.separator).alias("value"), "bad_bytes",
    )


def assemble(found: DumpScan) -> DataFrame:
    """Records with every statement whole. No shuffle unless some file needs gluing."""
    files = _open_files(found)
    if files is None:
        return found.records.select(*_RECORD)
    closed = found.records.join(broadcast_if_small(files), "file_path", "left_anti").select(*_RECORD)
    return closed.unionByName(_assemble_open_files(found, files))


def chunk_ranges(found: DumpScan, versions: DataFrame) -> DataFrame:
    """One row per split with the bytes its records take, [begin_byte, end_byte), and the version of its file.

    Records are told apart by where they begin, so these ranges mean the same whatever the splits were. ``tail_byte`` is
    where a last record begins that has neither a separator nor a ``;``: more of it may come when the file grows.
    ``open_end`` marks files that end inside a literal. Call it after ``assemble``.
    """
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    version = versions.select(F.col("file_path").alias("uri"), "bom", *[F.col(c).alias("v_" + c) for c in VERSION])
    # the reader lists file:/x where other readers say file:///x
    sized = found.splits.join(broadcast_if_small(version), file_uri(F.col("file_path")) == F.col("uri"), "left")
    begin = F.coalesce(F.sum("n_bytes").over(before), F.lit(0)) + F.coalesce("bom", F.lit(0))
    placed = sized.withColumn("begin_byte", begin).withColumn("past", F.col("begin_byte") + F.col("n_bytes") - F.col("file_size"))
    unended = F.col("past") > 0
    tail = F.when(unended & ~F.col("last.whole"), F.col("file_size") - F.col("last.n_raw"))
    if found.broken is None:
        told = placed.withColumn("open_end", F.lit(False))
    else:
        told = placed.join(broadcast_if_small(found.broken.withColumn("open_end", F.lit(True))), "file_path", "left").withColumn(
            "open_end", F.coalesce("open_end", F.lit(False)))
    end = F.col("begin_byte") + F.col("n_bytes") - F.when(unended, F.col("past")).otherwise(F.lit(0))
    return told.select(
        "file_path", "chunk_id", "block_start", "begin_byte", end.alias("end_byte"), tail.alias("tail_byte"), "open_end",
        F.coalesce("v_file_size", "file_size").alias("file_size"), *[F.col("v_" + c).alias(c) for c in VERSION[1:]])


def record_offsets(found: DumpScan, splits: DataFrame) -> DataFrame:
    """(file_path, block_start, ord, begin_byte, covers) of the records of some splits (a few rows of ``with_cover``)."""
    inside = Window.partitionBy(*_SPLIT_KEY).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    met = found.records.select(*_SPLIT_KEY, "ord", "n_raw").join(
        broadcast_if_small(splits.select(*_SPLIT_KEY, "begin_byte", "covers")), _SPLIT_KEY)
    place = F.col("begin_byte") + F.coalesce(F.sum(F.col("n_raw") + F.lit(found.separator_bytes)).over(inside), F.lit(0))
    return met.withColumn("begin_byte", place).drop("n_raw")


def to_statements(whole: DataFrame, dialect: str | Dialect = ORACLE) -> DataFrame:
    """Whole records -> statements: leading comments and directives off, literals in standard form, inner ends split,
    comments out. ``bad_bytes`` marks statements that lost bytes."""
    # what is one statement as it stands, the usual record, is told by one walk
    known = F.col("value").rlike(whole_statement(dialect_of(dialect))) & ~reduce(Column.__or__, [F.endswith("value", F.lit(ch)) for ch in " \t\r\n"])
    plain = F.lit(False) if dialect_of(dialect).backslash else known
    bare = strip_leading_noise(F.col("value"))
    careful = trim_end(strip_comments(strip_leading_noise(standard_literals(bare, dialect)) if dialect_of(dialect).backslash
                                      else standard_literals(bare, dialect)))
    body = F.when(F.col("plain"), F.col("value")).otherwise(careful)
    pieces = F.when(F.col("plain"), F.array("body")).when(
        F.contains("body", F.lit(";")), F.regexp_extract_all("body", F.lit(_PIECE), F.lit(0))).when(
        F.col("body") != "", F.array("body"))
    key = ["file_path", "block_start", "chunk_id", "ord"]
    first = F.col("sub") == 0
    inner = F.when(first, F.col("piece")).otherwise(trim_end(strip_leading_noise(F.col("piece"))))
    return (
        whole.select(*key, "value", plain.alias("plain"), "bad_bytes")
        .select(*key, "plain", body.alias("body"), "bad_bytes")
        .select(*key, "bad_bytes", F.posexplode(pieces).alias("sub", "piece"))
        .filter(first | (inner != ""))
        .select(*key, "sub", F.concat(inner, F.lit(";")).alias("stmt"), "bad_bytes")
    )


def read_statements(
    spark: SparkSession,
    paths: str | Sequence[str],
    separator: str = ";\n",
    chunk_bytes: int = CHUNK_BYTES,
    encoding: str = "utf-8",
    dialect: str | Dialect = ORACLE,
) -> DataFrame:
    """Dump files -> ``file_path, block_start, chunk_id, ord, sub, stmt, bad_bytes``; order is (block_start, ord, sub)."""
    found = scan(read_records(spark, paths, separator, chunk_bytes, encoding), separator, dialect, encoding)
    return to_statements(assemble(found), dialect)


def insert_statements(stmts: DataFrame) -> DataFrame:
    return stmts.filter(is_insert(F.col("stmt")))


def with_positions(stmts: DataFrame) -> DataFrame:
    """Add ``pos``, the 1-based place of the statement in its file.

    Counts per split are summed over the splits of a file, then ranks run inside each split.
    """
    inside = Window.partitionBy(*_SPLIT_KEY).orderBy("ord", "sub")
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    counts = stmts.groupBy(*_SPLIT_KEY).agg(F.count("*").alias("n"))
    base = counts.select(*_SPLIT_KEY, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return (
        stmts.join(broadcast_if_small(materialise(base, "positions")), _SPLIT_KEY)
        .withColumn("pos", F.row_number().over(inside) + F.col("base"))
        .drop("base")
    )
