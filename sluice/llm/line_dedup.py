"""Duplicate lines, told by one compressed keep bitmap a document. DataFrame functions only.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys are hashed (MD5, 128 bits) and the
rows (hash, document, position) are range-partitioned by hash and document, with position as secondary sort: the first
row of each (hash, document) is a document that holds the line, whatever its repeats. A hash in a third of all documents
spans many ranges; as ranges are contiguous, it is told by its first and last range, and what is decided about a hash goes
back to its rows by (hash, range), so that no task gets more of it than a range holds. Only hashes are shuffled, never
lines. What comes back to a document is the bitmap of its kept lines, compressed to the lengths of its runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.scale import materialise

COUNT, KEEP = "line_count", "line_keep"
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, _UPPER, _LOWER))


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """What tells rows apart: the id, and the text where an id is repeated or null. Equal rows have equal bitmaps."""
    return [doc_id.alias("doc"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("own")]


def dropped_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc, own, pos) of the lines to drop; ``own`` tells texts of one id apart, positions count from 0."""
    spark = docs.sparkSession
    # a generator of one row fixes the digest of a text before its lines come out, else it is made for every line
    one = F.inline(F.array(F.struct(*_row_key(F.col(doc_id), F.col(text)), lines_of(F.col(text)).alias("lines"))))
    rows = docs.select(one).select("doc", "own", F.posexplode("lines").alias("pos", "line"))
    long_enough = F.char_length(F.btrim("line", F.lit(_BLANKS))) >= least_chars
    keyed = rows.filter(long_enough).select(F.unhex(F.md5(line_key(F.col("line")))).alias("hash"), "doc", "own", "pos")
    ranged = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "hash", "doc")
    order = Window.partitionBy("hash", "doc").orderBy("own", "pos")
    placed = materialise(
        ranged.withColumn("range", F.spark_partition_id()).withColumn("first", F.row_number().over(order) == 1), "lines"
    )
    held = placed.groupBy("hash").agg(
        F.count_if("first").alias("n"), F.max("doc").alias("last"), F.min("range").alias("low"), F.max("range").alias("high")
    ).filter(F.col("n") >= least_docs)
    told = held.select(
        F.col("hash").alias("k"), "last", F.explode(F.sequence("low", "high")).alias("in_range"))
    met = placed.join(told, (F.col("hash") == F.col("k")) & (F.col("range") == F.col("in_range")))
    return met.filter(~F.col("doc").eqNullSafe(F.col("last"))).select("doc", "own", "pos")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, own, keep): the keep bitmap of every document that loses lines, as alternating run lengths.

    The first run is of kept lines and may be 0; lines after the last run are kept.
    """
    gone = dropped.groupBy("doc", "own").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    before = F.concat(F.array(F.lit(-2)), F.col("gone"))
    after = F.concat(F.slice("gone", F.lit(2), F.size("gone")), F.array(F.lit(-2)))
    # where a run of dropped lines begins and ends: its neighbour is not the next number
    begins = F.array_compact(F.zip_with(F.col("gone"), before, lambda x, b: F.when(b + 1 != x, x)))
    ends = F.array_compact(F.zip_with(F.col("gone"), after, lambda x, a: F.when(x + 1 != a, x + 1)))
    # zip_with pads the shorter side, whose null makes no run
    cut = gone.select("doc", "own", begins.alias("begins"), ends.alias("ends"))
    earlier = F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.size("ends") - 1))
    runs = F.zip_with(
        F.zip_with("begins", earlier, lambda b, e: b - e), F.zip_with("begins", "ends", lambda b, e: e - b),
        lambda kept, lost: F.array(kept, lost),
    )
    return cut.select("doc", "own", F.flatten(runs).alias("keep"))


def find_duplicate_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with line_count (long) and line_keep, the compressed keep bitmap (null: all stay).

    A line goes if its key has ``least_chars`` code points or more and is found in ``least_docs`` documents or more, except
    in the document of the largest id among them, which keeps all its lines. A null text is one empty line. Rows of one id
    are one document; rows without an id are one document too, smaller than all others. Repeated rows get equal bitmaps; an
    empty table stays empty. Other columns pass through whatever their names; columns named like the two new ones go.
    """
    keep = keep_bitmaps(dropped_lines(docs, least_chars, least_docs, doc_id, text))
    names = [c for c in docs.columns if c not in (COUNT, KEEP)]
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = docs.select(whole, *_row_key(F.col(doc_id), F.col(text)), F.size(lines_of(F.col(text))).cast("long").alias("lines"))
    named = keep.select(F.col("doc").alias("d"), F.col("own").alias("o"), "keep")
    out = rows.join(named, F.col("doc").eqNullSafe(F.col("d")) & (F.col("own") == F.col("o")), "left")
    return out.select("row.*", F.col("lines").alias(COUNT), F.col("keep").alias(KEEP))


def dropped_count(keep: Column) -> Column:
    """Lines that a bitmap of ``find_duplicate_lines`` drops."""
    lost = F.transform(keep, lambda n, i: F.when(i % 2 == 1, n).otherwise(F.lit(0)))
    return F.coalesce(F.aggregate(lost, F.lit(0).cast("long"), lambda s, n: s + n), F.lit(0).cast("long"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined again."""
    flags = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = F.zip_with(lines_of(text), flags, lambda x, flag: F.when(F.coalesce(flag, F.lit(True)), x))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))
