"""Which charset a dump is in, from its head; decoding of dumps that cannot be split."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.charset import CHARSET_ALIASES, FALLBACK_CHARSETS, MIN_CONFIDENCE, decode_strict
from sluice.functions.literals import BLANKS
from sluice.operators.sampling import MIN_INSERT_SHARE, SAMPLE_LINES
from sluice.session import hold_batches
from sluice.sources.ranges import file_uri, heads, list_files

# Fixed value: bytes looked at for detection.
DETECT_BYTES = 102_400
_TRIED = list(dict.fromkeys(["utf-8", *FALLBACK_CHARSETS]))


def _common_share(text: str, charset: str) -> float:
    """Share of the non-ASCII characters that are everyday characters of the charset's script."""
    wide = [ch for ch in text if ord(ch) > 0x7F]
    if not wide:
        return 0.0
    if charset == "gbk":
        # level 1 and 2 characters and punctuation rows of the 1980 standard, which GBK extends
        ok = sum(1 for ch in wide if len(b := ch.encode("gbk")) == 2 and 0xA1 <= b[0] <= 0xF7 and b[1] >= 0xA1)
    else:
        ok = sum(1 for ch in wide if len(b := ch.encode("big5")) == 2 and 0xA1 <= b[0] <= 0xC6)
    return ok / len(wide)


@F.pandas_udf(T.StructType([T.StructField("charset", T.StringType()), T.StructField("confidence", T.DoubleType())]))
def guess_legacy_charset(data: pd.Series) -> pd.DataFrame:
    """Best double-byte charset for bytes that are no UTF-8; Latin-1 with low confidence otherwise."""
    rows = []
    for d in data:
        best = ("iso-8859-1", 0.5)
        for charset in ("gbk", "big5") if d is not None else ():
            for cut in (0, 1):  # the head may end in the middle of a character
                try:
                    text = bytes(d[: len(d) - cut]).decode(charset)
                except UnicodeDecodeError:
                    continue
                share = _common_share(text, charset)
                if share > best[1]:
                    best = (charset, share)
                break
        rows.append(best)
    return pd.DataFrame(rows, columns=["charset", "confidence"])


def _known_charset(head: Column) -> Column:
    """What byte order marks and UTF-8 validity tell; null where they do not."""
    mark = F.hex(F.substring(head, 1, 3))
    # a head cut at a fixed size may end inside a character: up to three bytes may be missing
    text = head.cast("string")
    cut = F.octet_length(head) >= DETECT_BYTES
    utf8 = F.is_valid_utf8(text)
    for n in (1, 2, 3):
        utf8 = utf8 | (cut & F.is_valid_utf8(F.substring(head, F.lit(1), F.octet_length(head) - n).cast("string")))
    return (
        F.when(F.hex(F.substring(head, 1, 4)).isin("FFFE0000", "0000FEFF"), "utf-32")
        .when(mark.startswith("FFFE") | mark.startswith("FEFF"), "utf-16").when(mark == "EFBBBF", "utf-8").when(utf8, "utf-8")
    )


def detect_charset(files: DataFrame, data: str = "head") -> DataFrame:
    """Add ``original_encoding``, ``encoding`` and ``confidence`` for a column of leading bytes.

    Byte order marks and UTF-8 validity are decided in the JVM; only other files reach Python.
    """
    hold_batches(files.sparkSession)
    known = files.withColumn("__known", _known_charset(F.col(data)))
    return _detected(known.withColumn("__guess", guess_legacy_charset(F.when(F.col("__known").isNull(), F.col(data)))))


def _detected(guessed: DataFrame) -> DataFrame:
    alias = F.col("original_encoding")
    for reported, used in CHARSET_ALIASES:
        alias = F.when(F.lower("original_encoding") == reported, used).otherwise(alias)
    return (
        guessed.withColumn("original_encoding", F.coalesce("__known", F.col("__guess.charset")))
        .withColumn("encoding", alias)
        .withColumn("confidence", F.when(F.col("__known").isNotNull(), 1.0).otherwise(F.col("__guess.confidence")))
        .drop("__known", "__guess")
    )


def _gate(text: Column) -> Column:
    """The sample quality gate on one decoded text: share of INSERT lines among its first sample lines."""
    lines = F.slice(F.split(text, r"\r\n|\r|\n"), 1, SAMPLE_LINES)
    # the piece after a final newline is no line
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    inserts = F.filter(lines, lambda x: F.upper(F.btrim(x, F.lit(BLANKS))).startswith("INSERT"))
    return (F.size(lines) > 0) & (F.size(inserts) / F.size(lines) > MIN_INSERT_SHARE)


def fallback_charset(files: DataFrame, data: str = "head") -> DataFrame:
    """Add ``used_encoding`` and ``ignore_errors``: the first candidate that decodes strictly and passes the
    gate, else UTF-8 with errors ignored. All candidates are tried inside the row, without a shuffle."""
    hold_batches(files.sparkSession)
    return _fallen_back(files.select("*", *_tries(F.col(data))))


def _tries(head: Column) -> list[Column]:
    """What a head is in each charset that may be fallen back to; null where it does not fit."""
    utf8 = head.cast("string")
    tried = {"utf-8": F.when(F.is_valid_utf8(utf8), utf8)}
    for c in FALLBACK_CHARSETS:
        tried.setdefault(c, decode_strict(head, F.lit(c)))
    return [tried[c].alias(f"__try{i}") for i, c in enumerate(_TRIED)]


def _fallen_back(wide: DataFrame) -> DataFrame:
    used = F.coalesce(*[F.when(_gate(F.col(f"__try{i}")), F.lit(c)) for i, c in enumerate(_TRIED)])
    return (
        wide.withColumn("ignore_errors", used.isNull())
        .withColumn("used_encoding", F.coalesce(used, F.lit("utf-8")))
        .drop(*[f"__try{i}" for i in range(len(_TRIED))])
    )


def choose_charset(files: DataFrame, data: str = "head") -> DataFrame:
    """Detected charset where detection is sure, else the fallback's.

    Both look only at heads that the JVM does not know, side by side, so that they share a Python worker.
    """
    hold_batches(files.sparkSession)
    unsure = F.when(F.col("__known").isNull(), F.col(data))
    known = files.withColumn("__known", _known_charset(F.col(data)))
    both = _fallen_back(_detected(known.select("*", guess_legacy_charset(unsure).alias("__guess"), *_tries(unsure))))
    sure = F.col("confidence") >= MIN_CONFIDENCE
    return both.withColumn("encoding", F.when(sure, F.col("encoding")).otherwise(F.col("used_encoding"))).withColumn(
        "ignore_errors", ~sure & F.col("ignore_errors")).drop("used_encoding")


def file_charsets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_path, encoding, confidence`` per file, reading only heads."""
    return choose_charset(heads(list_files(spark, path), DETECT_BYTES)).drop("head")


# Byte order marks of wide charsets, the longer first.
BYTE_ORDERS = [("FFFE0000", "utf-32-le"), ("0000FEFF", "utf-32-be"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be")]


def byte_order(head: Column, encoding: Column) -> Column:
    """The charset with its byte order: from the mark where there is one, else little end first, as Windows writes it."""
    mark = F.hex(F.substring(head, 1, 4))
    wide = F.lit("utf-16-le")
    for sign, name in reversed(BYTE_ORDERS):
        wide = F.when(mark.startswith(sign), name).otherwise(wide)
    return F.when(encoding.startswith("utf-16") | encoding.startswith("utf-32"), wide).otherwise(encoding)


_FIRST_END = r"(?s)\A(?:[^;]++|;(?!\r?\n))*+;(\r?)\n"


def separator_of(head: Column) -> Column:
    """How statements end in a file, from the first end in its head: ``;`` and a newline of either kind."""
    # wide code units have zero bytes around ASCII
    crlf = F.regexp_extract(F.replace(F.make_valid_utf8(head.cast("string")), F.lit("\0"), F.lit("")), _FIRST_END, 1) == "\r"
    return F.when(crlf, F.lit(";\r\n")).otherwise(F.lit(";\n"))


def file_separators(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_path, separator`` per file, reading only heads."""
    return heads(list_files(spark, path), DETECT_BYTES).select("file_path", separator_of(F.col("head")).alias("separator"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decoded_records(data: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([
        None if d is None else bytes(d).decode(c, "ignore").removeprefix("\ufeff").replace(";\r\n", ";\n").split(";\n")
        for d, c in zip(data, charset)
    ])


def read_unsplittable(spark: SparkSession, path: str | list[str], charset: str = "utf-16") -> DataFrame:
    """Records of wide dumps in which a separator stands across code units (see ``dumps.misaligned``): one file per row,
    so files are held to the admission limit. Same columns as ``read_records``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    records = files.select(
        file_uri(F.col("path")).alias("file_path"), F.posexplode(_decoded_records("content", F.lit(charset))).alias("ord", "value"))
    return records.filter(F.col("value") != "").select(
        "file_path", F.lit(0).cast("long").alias("block_start"), F.lit(0).cast("long").alias("chunk_id"),
        F.col("ord").cast("long").alias("ord"), "value", F.lit(False).alias("bad_bytes"),
        F.octet_length("value").alias("n_raw"), F.lit(None).cast("long").alias("file_size"))
