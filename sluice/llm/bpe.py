"""BPE encoding and decoding by tree concatenation.

Texts of up to ``part_chars`` are encoded where they are read. Longer ones are cut into parts that Spark deals to all
tasks: at places where a pre-token ends whatever surrounds it, or, where text is unsplit for longer than a part, inside a
pre-token. The encoded parts of a text meet again and are joined in a tree; joins inside a pre-token re-encode a growing
window until both sides agree (``ByteBPE.join``), so ids are exactly those of the whole text.
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

IDS = "bpe_ids"
#: ids that one Arrow batch may hold
BATCH_IDS = 500_000


def _flush(pieces: list[str]) -> list[tuple[bool, bool, bytes]]:
    """Whole pre-tokens as parts. White space at their end goes apart: what follows it decides how it is split."""
    end = len(pieces)
    while end and pieces[end - 1].isspace():
        end -= 1
    return [(False, False, "".join(pieces[:end]).encode())] * (end > 0) + [(True, False, p.encode()) for p in pieces[end:]]


def cut(bpe: ByteBPE, text: str, part_chars: int) -> list[tuple[bool, bool, bytes]]:
    """Parts of a text: (inside a pre-token, glued to the part before, UTF-8)."""
    parts: list[tuple[bool, bool, bytes]] = []
    at = 0
    while len(text) - at > part_chars:
        ends = [m.end() for m in STABLE.finditer(text, at, at + part_chars + 1)]
        if ends:
            parts.append((False, False, text[at : ends[-1]].encode()))
            at = ends[-1]
            continue
        m = STABLE.search(text, at)
        run_end = m.end() if m else len(text)
        held: list[str] = []
        size = 0
        for is_special, piece in bpe.pre_tokens(text[at:run_end]):
            if is_special or len(piece) <= part_chars:
                held.append(piece)
                size += len(piece)
                if size > part_chars:
                    parts += _flush(held)
                    held, size = [], 0
                continue
            parts += _flush(held)
            held, size = [], 0
            raw = piece.encode()
            parts += [(True, i > 0, raw[i : i + part_chars]) for i in range(0, len(raw), part_chars)]
        parts += _flush(held)
        at = run_end
    if at < len(text) or not parts:
        parts.append((False, False, text[at:].encode()))
    return parts


def join_tree(bpe: ByteBPE, parts: list[tuple[bool, list[int]]]) -> list[int]:
    """Ids of (glued to the part before, ids) in order: the parts of one pre-token are joined pairwise until one is left."""
    runs: list[list[list[int]]] = []
    for glued, ids in parts:
        if glued:
            runs[-1].append(ids)
        else:
            runs.append([ids])
    out: list[int] = []
    for run in runs:
        while len(run) > 1:
            run = [bpe.join(*run[i : i + 2]) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
        out += run[0]
    return out


def _list_array(lists: list[list[int]]) -> pa.Array:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    values = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]).astype(np.int32)), pa.array(values))


def _encode_column(path: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            at, held, lists = 0, 0, []
            column = batch.column(batch.schema.get_field_index(text))
            for i, value in enumerate(column):
                lists.append(bpe.encode(value.as_py() or ""))
                held += len(lists[-1])
                if held > BATCH_IDS or i == len(column) - 1:
                    piece = batch.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*piece.columns, _list_array(lists)], [*batch.schema.names, IDS])
                    at, held, lists = i + 1, 0, []

    return run


def encode(docs: DataFrame, path: str = DEFAULT_PATH, text: str = "text", part_chars: int = 65_536) -> DataFrame:
    """All rows and columns of ``docs`` and ``bpe_ids`` (array<int>), the ids of the whole text.

    A null or empty text has no ids. Repeated rows stay repeated. Other columns, null or not, pass through; a column
    named bpe_ids is replaced. Special strings of the vocabulary inside a text become special ids. The order of rows is
    not kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(IDS)
    out = T.StructType([*docs.schema.fields, T.StructField(IDS, T.ArrayType(T.IntegerType(), False))])
    size = F.coalesce(F.length(F.col(text)), F.lit(0))
    short = docs.filter(size <= part_chars).mapInArrow(_encode_column(path, text), out)

    part = T.ArrayType(T.StructType([
        T.StructField("inner", T.BooleanType()), T.StructField("glued", T.BooleanType()), T.StructField("raw", T.BinaryType())
    ]))

    @F.pandas_udf(part)
    def parts(values: pd.Series) -> pd.Series:
        bpe = load(path)
        return values.map(lambda v: [{"inner": a, "glued": b, "raw": c} for a, b, c in cut(bpe, v, part_chars)])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def part_ids(inner: pd.Series, raw: pd.Series) -> pd.Series:
        bpe = load(path)
        return pd.Series([bpe.encode_piece(r) if i else bpe.encode(r.decode()) for i, r in zip(inner, raw, strict=True)])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def joined(values: pd.Series) -> pd.Series:
        bpe = load(path)
        return values.map(lambda v: join_tree(bpe, [(p["glued"], list(p["ids"])) for p in sorted(v, key=lambda p: p["n"])]))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    long = (
        docs.filter(size > part_chars)
        .select(F.monotonically_increasing_id().alias("key"), row.alias("row"), parts(F.col(text)).alias("parts"))
        .select("key", "row", F.posexplode("parts").alias("n", "p"))
        .select("key", F.when(F.col("n") == 0, F.col("row")).alias("row"), "n", "p.*")
        .repartition(tasks, "key", "n")
        .select("key", "row", F.struct("n", "glued", part_ids("inner", "raw").alias("ids")).alias("p"))
        .groupBy("key").agg(F.first("row", ignorenulls=True).alias("row"), F.collect_list("p").alias("ps"))
        .select(*[F.col("row").getField(c).alias(c) for c in docs.columns], joined("ps").alias(IDS))
    )
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str = DEFAULT_PATH, ids: str = IDS, to: str = "bpe_text") -> DataFrame:
    """All rows and columns and ``to``: the text of the ids, special ids included. Null ids give the empty text.

    Bytes that are no UTF-8 (ids cut inside a character) become U+FFFD. Ids outside the vocabulary stand for nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        table, empty = dict(enumerate(bpe.bytes_of)), b""
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [
                empty.join([table.get(i, empty) for i in v.values.to_numpy(zero_copy_only=False).tolist()]).decode("utf-8", "replace")
                if v.is_valid else ""
                for v in column
            ]
            kept = [i for i, name in enumerate(batch.schema.names) if name != to]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(texts, pa.string())], [*[batch.schema.names[i] for i in kept], to]
            )

    fields = [f for f in encoded.schema.fields if f.name != to]
    return encoded.mapInArrow(run, T.StructType([*fields, T.StructField(to, T.StringType())]))
