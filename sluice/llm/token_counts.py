"""Token counts of documents of any length by overlap resynchronisation.

Texts of up to ``chunk_chars`` are counted where they are read. Longer ones become overlapping chunks that Spark deals to
all tasks. Each chunk is encoded with offsets and keeps, for its two overlaps, how many ids stand before every boundary
that is proven stable: an id ends there and a pre-token ends there whatever surrounds it. Neighbouring chunks are spliced
at the first boundary both know; where they share none, the overlap is widened over the next chunk and encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.batches import small_batches
from sluice.llm.vocabulary import DEFAULT_PATH, STABLE, ByteBPE, load

COUNT = "token_count"


def _offsets(text: str, at: list[int]) -> np.ndarray:
    """UTF-8 offsets of rising character offsets."""
    return np.cumsum([len(text[a:b].encode()) for a, b in zip([0, *at[:-1]], at, strict=True)])


def stable_marks(bpe: ByteBPE, text: str, ids: list[int], low: int, high: int) -> dict[int, int]:
    """Stable boundaries that can be told from text[low:high] alone: character offset -> ids before it."""
    at = [m.end() for m in STABLE.finditer(text, low, high)]
    if not at:
        return {}
    ends, offsets = np.cumsum(bpe.lengths()[ids]), _offsets(text, at)
    before = np.searchsorted(ends, offsets)
    return {p: int(n) + 1 for p, n, b in zip(at, before, offsets, strict=True) if ends[n] == b}


def chunk_counts(bpe: ByteBPE, start: int, text: str, overlap: int) -> dict:
    """What a chunk at ``start`` tells its neighbours. Its text is kept only while an overlap has no stable boundary."""
    ids = bpe.encode(text)
    head = stable_marks(bpe, text, ids, 0, overlap)
    tail = stable_marks(bpe, text, ids, max(0, len(text) - overlap), len(text))
    return {
        "start": start, "size": len(text), "ids": len(ids), "text": None if head and tail else text,
        "marks": [{"at": start + p, "before": n} for p, n in (head | tail).items()],
    }


def splice(bpe: ByteBPE, chunks: list[dict], overlap: int) -> int:
    """Ids of the whole text from its chunks in order."""
    total, current, begin, skipped = 0, chunks[0], 0, 0  # the current chunk counts from ``begin``, after ``skipped`` ids
    for chunk in chunks[1:]:
        mine = {m["at"]: m["before"] for m in current["marks"] if m["at"] >= begin}
        shared = min((m["at"] for m in chunk["marks"] if m["at"] in mine), default=None)
        if shared is not None:
            total += mine[shared] - skipped
            current, begin = chunk, shared
            skipped = next(m["before"] for m in chunk["marks"] if m["at"] == shared)
            continue
        # No common boundary: widen the overlap until it is all of both chunks.
        text = current["text"] + chunk["text"][current["start"] + current["size"] - chunk["start"] :]
        current = chunk_counts(bpe, current["start"], text, overlap) | {"text": text}
        if begin > current["start"]:
            ends = np.cumsum(bpe.lengths()[bpe.encode(text)])
            skipped = int(np.searchsorted(ends, _offsets(text, [begin - current["start"]])[0])) + 1
    return total + current["ids"] - skipped


def count_tokens(
    docs: DataFrame, path: str = DEFAULT_PATH, text: str = "text", chunk_chars: int = 32_768, overlap: int = 512
) -> DataFrame:
    """All rows and columns of ``docs`` and ``token_count`` (long), as the whole text encoded at once has.

    A null or empty text has 0. Repeated rows stay repeated, other columns pass through, a column named token_count is
    replaced, and special strings inside a text count as the vocabulary's special ids. The order of rows is not kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(COUNT)
    out = T.StructType([*docs.schema.fields, T.StructField(COUNT, T.LongType())])
    size = F.coalesce(F.length(F.col(text)), F.lit(0))

    def short_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            counts = [len(bpe.encode(v.as_py() or "")) for v in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, COUNT])

    told = T.StructType([
        T.StructField("start", T.LongType()), T.StructField("size", T.LongType()), T.StructField("ids", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("marks", T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("before", T.LongType())]))),
    ])

    @F.pandas_udf(told)
    def tell(start: pd.Series, chunk: pd.Series) -> pd.DataFrame:
        bpe = load(path)
        return pd.DataFrame([chunk_counts(bpe, int(s), c, overlap) for s, c in zip(start, chunk, strict=True)], columns=told.names)

    @F.pandas_udf("long")
    def spliced(values: pd.Series) -> pd.Series:
        bpe = load(path)
        return values.map(lambda v: splice(bpe, sorted(v, key=lambda c: c["start"]), overlap))

    step = chunk_chars - overlap
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    starts = F.sequence(F.lit(0), F.length("__text") - overlap - 1, F.lit(step))
    long = (
        docs.filter(size > chunk_chars)
        .select(F.monotonically_increasing_id().alias("key"), row.alias("row"), F.col(text).alias("__text"))
        .select("key", "row", "__text", F.explode(starts).alias("start"))
        .select("key", F.when(F.col("start") == 0, F.col("row")).alias("row"), "start",
                F.substring("__text", F.col("start") + 1, F.lit(chunk_chars)).alias("chunk"))
        .repartition(tasks, "key", "start")
        .select("key", "row", tell("start", "chunk").alias("told"))
        .groupBy("key").agg(F.first("row", ignorenulls=True).alias("row"), F.collect_list("told").alias("told"))
        .select(*[F.col("row").getField(c).alias(c) for c in docs.columns], spliced("told").alias(COUNT))
    )
    return docs.filter(size <= chunk_chars).mapInArrow(short_counts, out).unionByName(long)
