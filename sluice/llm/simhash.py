"""SimHash near-duplicates with a binary trie self-join.

A fingerprint is made of the XXH64 values of a text's word shingles. Equal fingerprints are one row from then on. Two
words that differ in at most ``budget`` of 64 bits agree on one of ``budget`` + 1 blocks of bits, so Spark deals the
distinct words by (block, its bits), and inside a group the binary trie of the words is walked against itself. A task
returns a spanning forest of the links it found, not the links; components are then joined over the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.scale import materialise
from sluice.llm.batches import give_back, small_batches
from sluice.llm.components import connected_components
from sluice.llm.trie import Forest, close_pairs

SIGNATURE = "simhash"
#: shingles whose bits are counted at once
CHUNK = 1 << 15
GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of all runs of ``words`` words, repeats included; of the whole text if it has fewer."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[: -words]]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=True)), np.uint64, len(starts))


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash of the same shingles; for k = 0 the hash itself."""
    if k == 0:
        return h
    z = h + np.uint64(GOLDEN * k % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the values; 0 for no values."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        bits = np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lanes = bits.view(np.uint64)  # eight counters of one byte in each word
        for low in range(0, len(lanes), 255):
            counts += lanes[low : low + 255].sum(axis=0).view(np.uint8)
    return int(((counts * 2 > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprint(docs: DataFrame, words: int = 4, rounds: int = 1, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and ``simhash``, an array of ``rounds`` 64-bit words over different hashes.

    Null texts and texts without words have words of 0. A column named simhash is replaced.
    """
    docs = docs.drop(SIGNATURE)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, rounds), np.uint64)
            for i, value in enumerate(batch.column(batch.schema.get_field_index(text))):
                h = shingle_hashes((value.as_py() or "").encode(), words)
                out[i] = [majority(_mix(h, k)) for k in range(rounds)]
            flat = pa.array(out.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, rounds, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, SIGNATURE])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(SIGNATURE, T.ArrayType(T.LongType(), False))]))


def _trie_links(budget: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(f["node"].to_numpy(np.int64), f["grp"].to_numpy(np.int64), f["word"].to_numpy(np.int64).view(np.uint64)) for f in frames]
        if not parts:
            return
        node, group, word = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((node, word, group))
        node, group, word = node[order], group[order], word[order]
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])])
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]  # nodes of one word in one group are linked to the first
        heads = np.flatnonzero(first)
        forest = Forest(len(heads))
        for i, j in close_pairs(group[heads], word[heads], budget):
            forest.link(i, j)
        i, j = forest.edges()
        a = np.concatenate([node[heads[i]], node])
        b = np.concatenate([node[heads[j]], node[lead]])
        apart = a != b
        yield pd.DataFrame({"a": a[apart], "b": b[apart]})

    return run


def _blocks(word, budget: int):
    """The ``budget`` + 1 blocks of the bits of a word, each marked with its place."""
    width, spare = divmod(64, budget + 1)
    sizes = [width + (k < spare) for k in range(budget + 1)]
    lows = [sum(sizes[:k]) for k in range(budget + 1)]
    return F.array(*[
        F.lit(k).cast("long") * F.lit(1 << 40) + F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << size) - 1))
        for k, (low, size) in enumerate(zip(lows, sizes, strict=True))
    ])


def link_forest(nodes: DataFrame, budget: int = 4) -> DataFrame:
    """Edges (a, b) that connect exactly what links of at most ``budget`` bits in any round connect, of rows (node: long, simhash)."""
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("node", F.posexplode(SIGNATURE).alias("round", "word"))
    dealt = rows.select("node", "word", "round", F.explode(_blocks(F.col("word"), budget)).alias("block"))
    grp = (F.col("round").cast("long") * F.lit(1 << 48) + F.col("block")).alias("grp")
    return dealt.select("node", "word", grp).repartition(tasks, "grp").mapInPandas(_trie_links(budget), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, rounds: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, simhash, component_id) per row of ``docs``; component_id is the smallest doc_id reachable.

    Rows link where a word of the same round differs in at most ``budget`` bits; the result is exact. Texts without words
    share the fingerprint 0 and link like any others. A null doc_id is never a component's id unless all are null. Repeated
    rows stay; an empty table gives an empty table.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = materialise(fingerprint(rows, words, rounds).select("doc_id", SIGNATURE), "simhash")
    node = F.element_at(SIGNATURE, 1) if rounds == 1 else F.xxhash64(SIGNATURE)
    nodes = materialise(
        marked.groupBy(SIGNATURE).agg(F.min("doc_id").alias("first")).withColumn("node", node), "simhash-words"
    )
    edges = link_forest(nodes, budget)
    joined = nodes.join(connected_components(edges).withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left")
    classes = materialise(joined.select(SIGNATURE, "first", F.coalesce("component", "node").alias("component")), "simhash-classes")
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "component").select(F.col(SIGNATURE).alias("__s"), "component_id")
    return marked.join(named, F.col(SIGNATURE) == F.col("__s")).select("doc_id", SIGNATURE, "component_id")
