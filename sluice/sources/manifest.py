"""File manifest, admission rules and size-based row estimates."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.literals import BLANKS, TUPLE
from sluice.functions.scale import materialise
from sluice.functions.text import strip_leading_noise
from sluice.operators.sampling import PROBES, REGION_EXTRA, SAMPLE_LINES, density_estimate, estimate_rows
from sluice.operators.values import HEAD
from sluice.sources.dumps import assemble, scan, to_statements
from sluice.sources.ranges import heads, list_files, read_range

# Admission limits and result codes.
MAX_PATH_LENGTH = 255
MAX_FILE_MB = 2048
ALLOWED_EXTENSIONS = (".sql",)
FEATURE_DISABLED, BAD_PATH, OUTSIDE, MISSING, UNREADABLE, TOO_LARGE = (
    "FEATURE_DISABLED", "PATH_001", "PATH_002", "PATH_003", "PATH_004", "PATH_005",
)
# Bytes looked at for a quick line estimate, and bytes per density probe.
QUICK_BYTES = 8192
PROBE_BYTES = 64 * 1024


def normal_path(path: Column) -> Column:
    """Absolute path without empty, ``.`` and ``..`` parts."""
    keep = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(path, "/"), keep,
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def extension(path: Column) -> Column:
    """Last suffix of the file name with its dot, lower case; empty when there is none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(?<=[^.])(\.[^.]*)$", 1))


def admit(files: DataFrame, enabled: bool = True, allowed_dirs: Sequence[str] = (),
          allowed_extensions: Sequence[str] = ALLOWED_EXTENSIONS, max_mb: int = MAX_FILE_MB,
          max_path: int = MAX_PATH_LENGTH) -> DataFrame:
    """Add ``normalized_path`` and ``error_code`` (NULL = admitted); the first failing rule wins.

    ``files``: path, is_file (false where missing or a directory), readable, file_size. The allow-list is a
    setting of a handful of folders, so it is part of the expression.
    """
    path = normal_path(F.col("path"))
    inside = F.lit(not allowed_dirs)
    for folder in allowed_dirs:
        folder = folder.rstrip("/")
        inside = inside | (F.col("normalized_path") == folder) | F.col("normalized_path").startswith(folder + "/")
    code = (
        F.when(F.lit(not enabled), FEATURE_DISABLED)
        .when(F.coalesce(F.length("path"), F.lit(0)) == 0, BAD_PATH)
        .when(F.length("path") > max_path, BAD_PATH)
        .when(~inside, OUTSIDE)
        .when(~F.col("is_file"), MISSING)
        .when(~F.col("readable"), UNREADABLE)
        .when(~extension(F.col("normalized_path")).isin(*allowed_extensions), BAD_PATH)
        .when(F.col("file_size") / F.lit(1024 * 1024) > max_mb, TOO_LARGE)
    )
    return files.withColumn("normalized_path", path).withColumn("error_code", code)


def _local(path: Column) -> Column:
    """The path of a URI."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")


def _found_and_readable(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether a path or glob that a caller names has anything behind it, and whether it may be read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        found = files.globStatus(place)
        if not found:
            return False, False
        if len(found) == 1:
            files.access(found[0].getPath(), spark._jvm.org.apache.hadoop.fs.permission.FsAction.READ)
    except Py4JJavaError as e:
        if "AccessControlException" not in e.java_exception.getClass().getName():
            raise
        return True, False
    return True, True


def admit_paths(spark: SparkSession, path: str | list[str], allowed_dirs: Sequence[str] = (), **rules) -> DataFrame:
    """Admission of all files below the paths, globs and folders a caller names, before any is read.

    ``file_path, file_size, modificationTime, path, is_file, readable, normalized_path, error_code``; a named path with
    nothing behind it, or that may not be read, is a row of its own. Whether a file below a folder may be read shows only
    when it is. ``allowed_dirs`` may be URIs. The rules are those of ``admit``.
    """
    named = [path] if isinstance(path, str) else list(path)
    states = {p: _found_and_readable(spark, p) if p else (False, False) for p in dict.fromkeys(named)}
    good = [p for p, (found, readable) in states.items() if found and readable]
    lost = [(p, None, None, found, readable) for p, (found, readable) in states.items() if not (found and readable)]
    shape = "file_path string, file_size long, modificationTime timestamp, is_file boolean, readable boolean"
    files = spark.createDataFrame(lost, shape)
    if good:
        listed = list_files(spark, good).withColumn("is_file", F.lit(True)).withColumn("readable", F.lit(True))
        files = listed.unionByName(files) if lost else listed
    folders = [re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", d) for d in allowed_dirs]
    return admit(files.withColumn("path", _local(F.col("file_path"))), allowed_dirs=folders, **rules)


def describe(files: DataFrame) -> DataFrame:
    """Name, extension, size in MB of listed files."""
    return files.withColumn("file_name", F.substring_index("file_path", "/", -1)).withColumn(
        "extension", extension(F.col("file_path"))
    ).withColumn("file_size_mb", F.round(F.col("file_size") / F.lit(1024 * 1024), 2))


def quick_line_estimate(files: DataFrame) -> DataFrame:
    """Add ``estimated_rows`` from the first 8 KB: counted when that is the whole file, else by density."""
    text = F.make_valid_utf8(F.col("head").cast("string"))
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    counted = newlines + F.when(F.endswith(text, F.lit("\n")) | (text == ""), 0).otherwise(1)
    by_density = F.greatest(F.lit(1), F.floor(F.col("file_size") / (F.length(text) / newlines)))
    rows = F.when(F.col("file_size") <= QUICK_BYTES, counted).when(newlines == 0, F.lit(1)).otherwise(by_density)
    return heads(files, QUICK_BYTES).withColumn("estimated_rows", rows.cast("long")).drop("head")


def manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: name, size, extension, modification time and a quick row estimate."""
    return quick_line_estimate(describe(list_files(spark, path)))


def probe_lines(files: DataFrame) -> DataFrame:
    """Newlines in up to ten ranges of up to 64 KB per file; every range is a task-sized read of its own."""
    size = F.col("file_size")
    length = F.least(F.lit(PROBE_BYTES), F.floor(size / 100))
    probes = F.when(length > 0, F.least(F.lit(PROBES), F.floor(size / length))).otherwise(1)
    ranges = (
        files.withColumn("probe_length", F.greatest(length, F.lit(1)))
        .withColumn("probes", probes.cast("int"))
        .withColumn("probe", F.explode(F.sequence(F.lit(0), F.col("probes") - 1)))
        .withColumn("offset", F.floor(size / F.col("probes")) * F.col("probe"))
        .repartition("file_path", "probe")
    )
    text = F.col("content").cast("string")
    return ranges.withColumn("content", read_range("file_path", "offset", "probe_length")).select(
        "file_path", "file_size", F.octet_length("content").alias("probe_bytes"),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).alias("probe_lines"),
    )


def estimate_by_density(files: DataFrame) -> DataFrame:
    return density_estimate(probe_lines(files))


#: the longest range that is read at once: a row holds 2 GB
LONGEST = 1 << 30


def widened(ranges: DataFrame, n_bytes: int, enough: Callable[[Column], Column]) -> DataFrame:
    """Ranges (file_path, file_size, offset, limit, ..) with ``text`` and ``whole``: what stands from ``offset`` on.

    ``n_bytes`` are read at first, and twice as many for those ranges whose text is not ``enough``, until it is or until
    ``limit`` is reached (``whole``). Each round reads only what is left, spread over the cluster.
    """
    todo, out = ranges, None
    while True:
        span = F.least(F.lit(n_bytes).cast("long"), F.col("limit"))
        read = todo.repartition("file_path", "offset").withColumn("data", read_range("file_path", "offset", span))
        text = F.make_valid_utf8(F.col("data").cast("string"))
        seen = materialise(read.select(*ranges.columns, text.alias("text"), (F.col("limit") <= n_bytes).alias("whole")), "ranges")
        found = F.col("whole") | enough(F.col("text")) if n_bytes < LONGEST else F.lit(True)
        done = seen.filter(found)
        out = done if out is None else out.unionByName(done)
        left = seen.filter(~found).select(*ranges.columns)
        if n_bytes >= LONGEST or left.isEmpty():
            return out
        todo, n_bytes = left, n_bytes * 2


def _whole_lines(text: Column, whole: Column) -> Column:
    """Lines other than blank ones; what follows the last line end counts only where the text is whole."""
    cut = F.when(whole, text).otherwise(F.regexp_replace(text, r"(?:\A|\n)[^\n]*\z", ""))
    return F.filter(F.split(cut, r"\r?\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def head_lines(files: DataFrame, n: int = SAMPLE_LINES, n_bytes: int = 1024 * 1024) -> DataFrame:
    """``file_path, line_no, line`` of the first n non-blank lines of each file, however long they are.

    The head of a file is read, and more of it where it holds fewer than n whole lines.
    """
    ranges = files.select("file_path", "file_size", F.lit(0).cast("long").alias("offset"), F.col("file_size").alias("limit"))
    heads_of = widened(ranges, n_bytes, lambda text: F.size(_whole_lines(text, F.lit(False))) >= n)
    return heads_of.select(
        "file_path", "file_size", F.posexplode(F.slice(_whole_lines(F.col("text"), F.col("whole")), 1, n)).alias("i", "line")
    ).select("file_path", "file_size", (F.col("i") + 1).alias("line_no"), "line")


#: an INSERT that is cut off, up to the end of its last whole tuple
_WHOLE_TUPLES = HEAD + rf"{TUPLE}(?:\s*+,\s*+{TUPLE})*+"


def head_statements(files: DataFrame, n_bytes: int = 1024 * 1024) -> DataFrame:
    """Statements in the head of each file, in the shape of ``read_statements``. More is read where the head has neither a
    whole INSERT nor a whole tuple of one; an INSERT that the head cuts off counts with its whole tuples."""
    ranges = files.select("file_path", "file_size", F.lit(0).cast("long").alias("offset"), F.col("file_size").alias("limit"))

    def begun(piece: Column) -> Column:
        return F.regexp_extract(strip_leading_noise(piece), _WHOLE_TUPLES, 0)

    def enough(text: Column) -> Column:
        return F.exists(F.split(text, r";\r?\n"), lambda p: begun(p) != "")

    pieces = F.split(F.col("text"), r";\r?\n")
    last = begun(F.element_at("pieces", -1))
    kept = F.when(F.col("whole"), F.col("pieces")).otherwise(
        F.concat(F.slice("pieces", F.lit(1), F.size("pieces") - 1), F.when(last != "", F.array(last)).otherwise(F.array().cast("array<string>"))))
    zero = F.lit(0).cast("long")
    cut = widened(ranges, n_bytes, enough).select("file_path", "whole", pieces.alias("pieces"))
    records = cut.select("file_path", F.posexplode(kept).alias("ord", "value")).filter("value <> ''").select(
        "file_path", zero.alias("block_start"), zero.alias("chunk_id"), F.col("ord").cast("long").alias("ord"), "value",
        F.lit(False).alias("bad_bytes"), F.octet_length("value").alias("n_raw"), zero.alias("file_size"))
    return to_statements(assemble(scan(materialise(records, "heads"))))


def spread_lines(files: DataFrame, regions: int = 4, n: int = SAMPLE_LINES, n_bytes: int = 256 * 1024) -> DataFrame:
    """``file_path, region, line_no, line``: first ``n / regions + 50`` whole lines of each region of a file. A region is
    read on, to its end if need be, until it has as many."""
    size, wanted = F.floor(F.col("file_size") / regions), n // regions + REGION_EXTRA
    last = F.col("region") == regions - 1
    ranges = (
        files.select("file_path", "file_size", F.explode(F.array(*[F.lit(i) for i in range(regions)])).alias("region"))
        .withColumn("offset", size * F.col("region"))
        .withColumn("limit", F.when(last, F.col("file_size") - F.col("offset")).otherwise(size))
    )

    def lines(text: Column, at_end: Column) -> Column:
        # a region begins inside a line
        return _whole_lines(F.when(F.col("region") > 0, F.regexp_replace(text, r"\A[^\n]*\n?", "")).otherwise(text), at_end)

    found = widened(ranges, n_bytes, lambda text: F.size(lines(text, F.lit(False))) >= wanted)
    return found.select(
        "file_path", "region", F.posexplode(F.slice(lines(F.col("text"), F.col("whole") & last), 1, wanted)).alias("i", "line")
    ).select("file_path", "region", (F.col("i") + 1).alias("line_no"), "line")


def estimate_by_sample(files: DataFrame) -> DataFrame:
    """Row estimates per file from its sampled head lines."""
    return estimate_rows(head_lines(files), files.select("file_path", "file_size"))
