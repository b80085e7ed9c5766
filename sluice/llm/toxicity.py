"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed to embeddings; filters of several widths slide over the whole text, the largest value of each is kept,
and a logistic layer turns them into a score. Only hash buckets that enough training documents hold have an embedding of
their own; a rarer word has that of its first bytes, if those are frequent enough, and else a zero vector, so the model
stays small and unknown words say nothing. Thresholds are calibrated
for each language on training documents that the weights were not fitted on; the language is never an input of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.scale import materialise
from sluice.llm.batches import small_batches
from sluice.llm.labelled import labelled_documents, usable_labels

SCORE = "toxic_score"
BUCKETS = 1 << 22
#: ASCII other than letters and digits separates words
_BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: bytes of a rarer word's beginning, whose bucket then stands for it
STEM = 5
#: words whose bucket a process remembers
REMEMBERED = 1 << 19


@dataclass
class Convolution:
    rows: dict[int, int]  # hash bucket -> row of the embeddings; row 0 is every other word
    embeddings: np.ndarray
    filters: list[np.ndarray]  # by width: (width, dims, count)
    biases: list[np.ndarray]
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._known: dict[bytes, int] = {}
        self._tables: list[list[np.ndarray]] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_tables": None}

    def ids(self, text: str) -> np.ndarray:
        """Rows of a whole text's words, padded to the widest filter."""
        words = text.encode().lower().translate(_BLANKED).split()
        known = self._known
        try:
            ids = [known[w] for w in words]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.rows.get(bucket(w)) or self.rows.get(bucket(w[:STEM] + b"*"), 0)
            ids = [known[w] for w in words]
        return np.array(ids + [0] * (len(self.filters) - len(ids)), np.int64)

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest activation of every filter and where it is."""
        if self._tables is None:
            self._tables = [[np.ascontiguousarray(self.embeddings @ tap) for tap in taps] for taps in self.filters]
        best, where = [], []
        for width, (tables, bias) in enumerate(zip(self._tables, self.biases, strict=True), 1):
            n = len(ids) - width + 1
            # windows of zero vectors only all have the same activation: one of them is enough
            some = np.zeros(n, bool)
            for t in range(width):
                some |= ids[t : t + n] != 0
            blank = np.flatnonzero(~some)[:1]
            at = np.concatenate([np.flatnonzero(some), blank])
            value = bias + sum(tables[t][ids[at + t]] for t in range(width))
            top = value.argmax(axis=0)
            best.append(np.maximum(value[top, np.arange(value.shape[1])], 0))
            where.append(at[top])
        return np.concatenate(best), where

    def score(self, text: str) -> float:
        z = float(self.pooled(self.ids(text))[0] @ self.out + self.base)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bucket(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) % BUCKETS


def begin(rows: dict[int, int], share: float, dims: int = 12, count: int = 8, widths: int = 3, seed: int = 5) -> Convolution:
    """A model that has learned nothing but the share of label 1."""
    rng = np.random.default_rng(seed)
    model = Convolution(
        rows, rng.normal(0, 0.3, (len(rows) + 1, dims)), [rng.normal(0, 0.3, (w, dims, count)) for w in range(1, widths + 1)],
        [np.zeros(count) for _ in range(widths)], rng.normal(0, 0.3, widths * count), 0.0,
    )
    model.embeddings[0] = 0
    share = float(np.clip(share, 0.01, 0.99))
    model.base = float(np.log(share / (1 - share)))
    return model


def _weights(model: Convolution) -> list[np.ndarray]:
    return [model.embeddings, model.out, *model.filters, *model.biases]


def state_of(model: Convolution, squares: list[np.ndarray] | None = None, square_base: float = 1e-3) -> np.ndarray:
    """Weights and sums of squared gradients as one vector, so that the states of several shards can be averaged."""
    own = _weights(model)
    squares = squares or [np.full(a.shape, 1e-3) for a in own]
    return np.concatenate([*[a.ravel() for a in (*own, *squares)], [model.base, square_base]])


def set_state(model: Convolution, state: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Give the model the weights of a state; returns the sums of squared gradients."""
    own, at, read = _weights(model), 0, []
    for a in (*own, *own):
        read.append(state[at : at + a.size].reshape(a.shape).copy())
        at += a.size
    widths = len(model.filters)
    model.embeddings, model.out, model.filters, model.biases = read[0], read[1], read[2 : 2 + widths], read[2 + widths : 2 + 2 * widths]
    model.base, model._tables = float(state[at]), None
    return read[len(own) :], float(state[at + 1])


def fit(
    model: Convolution, state: np.ndarray, ids: list[np.ndarray], y: np.ndarray, epochs: int = 8, rate: float = 0.05,
    decay: float = 2e-4, seed: int = 5,
) -> np.ndarray:
    """Go on from a state over documents and labels 0 and 1, by AdaGrad, one document a step; returns the new state."""
    rng = np.random.default_rng(seed)
    squares, square_base = set_state(model, state)
    widths, count = len(model.filters), len(model.biases[0])

    def step(array: np.ndarray, square: np.ndarray, at, grad: np.ndarray) -> None:
        square[at] += grad**2
        array[at] -= rate * grad / np.sqrt(square[at])

    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            hidden, where = _pool_rows(model, ids[k])
            z = hidden @ model.out + model.base
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k]
            square_base += g * g
            model.base -= rate * g / np.sqrt(square_base)
            back = g * model.out * (hidden > 0)
            step(model.out, squares[1], slice(None), g * hidden + decay * model.out)
            for w in range(widths):
                part = back[w * count : (w + 1) * count]
                live = np.flatnonzero(part)
                if len(live) == 0:
                    continue
                step(model.biases[w], squares[2 + widths + w], live, part[live])
                for t in range(w + 1):
                    word = ids[k][where[w][live] + t]
                    grad_e = part[live][:, None] * model.filters[w][t][:, live].T
                    grad_f = (part[live][:, None] * model.embeddings[word]).T + decay * model.filters[w][t][:, live]
                    block, square = model.filters[w][t], squares[2 + w][t]
                    square[:, live] += grad_f**2
                    block[:, live] -= rate * grad_f / np.sqrt(square[:, live])
                    for i in np.flatnonzero(word):
                        step(model.embeddings, squares[0], word[i], grad_e[i] + decay * model.embeddings[word[i]])
    model._tables = None
    return state_of(model, squares, square_base)


def _pool_rows(model: Convolution, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Like ``pooled``, over the distinct words of one document, while weights still change."""
    names, local = np.unique(np.concatenate([[0], ids]), return_inverse=True)
    held = model._tables
    model._tables = [[model.embeddings[names] @ tap for tap in taps] for taps in model.filters]
    out = model.pooled(local[1:])
    model._tables = held
    return out


def calibrate(scores: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the largest F1, halfway to the next score below; 0.5 if a label is missing."""
    order = np.argsort(-scores, kind="stable")
    scores, y = scores[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]])) if len(y) else np.zeros(0, int)
    n = np.diff(np.append(first, len(y)))
    return calibrate_steps(scores[first], scores[first], n, np.add.reduceat(y, first) if len(y) else n)


def calibrate_steps(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """``calibrate`` over steps of scores, from high to low: least and largest score, rows and rows of label 1."""
    if hits.sum() == 0 or hits.sum() == n.sum():
        return 0.5
    f1 = 2 * np.cumsum(hits) / (np.cumsum(n) + hits.sum())
    k = int(f1.argmax())
    below = high[k + 1] if k + 1 < len(n) else 0.0
    return float((low[k] + below) / 2)


#: documents that one task learns from in a row, and passes over them; with several shards the later rounds make one pass
SHARD, EPOCHS = 4000, 8
#: rounds over all shards after the first one has set out alone; the states of the shards are averaged after each
ROUNDS = 2
#: steps of scores that thresholds are chosen among
STEPS = 10_000
#: a word's bucket, or its stem's, has an embedding if this share of the documents (five at least) holds it
LEAST_SHARE = 0.01


def _place(doc_id: int) -> tuple[bool, int]:
    """Whether a document is kept apart for the thresholds (a fifth is), and a number to deal shards by."""
    place = xxhash.xxh32_intdigest(str(doc_id).encode())
    return place % BUCKETS % 5 == 0, place


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, documents) over the documents to fit on; the documents themselves count as bucket -1, label 1 as -2."""
    counts, total, ones = np.zeros(BUCKETS, np.int32), 0, 0
    for batch in batches:
        for doc_id, text, label in zip(_column(batch, "doc_id"), _column(batch, "text"), _column(batch, "__label"), strict=True):
            if _place(doc_id)[0]:
                continue
            words = set((text or "").encode().lower().translate(_BLANKED).split())
            held = {bucket(w) for w in words} | {bucket(w[:STEM] + b"*") for w in words}
            counts[np.fromiter(held, np.int64, len(held))] += 1
            total, ones = total + 1, ones + label
    found = np.flatnonzero(counts)
    buckets, n = np.concatenate([[-1, -2], found]), np.concatenate([[total, ones], counts[found]])
    for at in range(0, len(n), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(v[at : at + (1 << 16)], pa.int64()) for v in (buckets, n)], ["bucket", "n"])


def _vocabulary(known: DataFrame) -> tuple[dict[int, int], int, int]:
    """Embedding rows by bucket, documents to fit on and those of label 1, counted over all of them."""
    counts = known.mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    stored = materialise(counts, "word-counts")
    total, ones = (stored.filter(F.col("bucket") == b).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for b in (-1, -2))
    # each document holds a bounded share of these, so they are few however many documents there are
    often = stored.filter((F.col("bucket") >= 0) & (F.col("n") >= max(5, LEAST_SHARE * total))).select("bucket")
    return {b: i for i, b in enumerate(sorted(r.bucket for r in often.collect()), 1)}, total, ones


def _numbered(model: Convolution, shards: int):
    """Documents to fit on as embedding rows, with the shard they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, label in zip(_column(batch, "doc_id"), _column(batch, "text"), _column(batch, "__label"), strict=True):
                apart, place = _place(doc_id)
                if not apart:
                    rows.append((place // 5 % shards, doc_id, label, model.ids(text or "").astype(np.int32).tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "doc_id", "label", "ids"])

    return run


def _fit_shard(model: Convolution, state: np.ndarray, epochs: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        ids = [np.frombuffer(b, np.int32).astype(np.int64) for b in frame["ids"]]
        shard = int(frame["shard"].iloc[0])
        out = fit(model, state, ids, frame["label"].to_numpy(float), epochs, seed=5 + shard)
        return pd.DataFrame({"shard": [shard], "n": [len(ids)], "state": [out.tobytes()]})

    return run


def _add_states(frame: pd.DataFrame) -> pd.DataFrame:
    total = 0
    for n, state in zip(*[frame.sort_values("shard")[c] for c in ("n", "state")], strict=True):
        total = total + n * np.frombuffer(state)
    return pd.DataFrame({"part": frame["part"].iloc[:1], "n": [frame["n"].sum()], "state": [total.tobytes()]})


def _learn(numbered: DataFrame, model: Convolution, state: np.ndarray, epochs: int, shards: int) -> np.ndarray:
    """The mean of the states that the shards reach from one state, by their documents."""
    parts = math.isqrt(shards - 1) + 1  # as many sums reach the driver as a sum has states
    reached = numbered.groupBy("shard").applyInPandas(_fit_shard(model, state, epochs), "shard long, n long, state binary")
    sums = reached.withColumn("part", F.col("shard") % parts).groupBy("part").applyInPandas(_add_states, "part long, n long, state binary").collect()
    return sum(np.frombuffer(r.state) for r in sorted(sums, key=lambda r: r.part)) / sum(r.n for r in sums)


def _thresholds(known: DataFrame, model: Convolution) -> dict[str, float]:
    """The threshold of every language, over all documents kept apart."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang or "", model.score(text or ""), label) for doc_id, text, lang, label in
                    zip(*[_column(batch, c) for c in ("doc_id", "text", "lang", "__label")], strict=True) if _place(doc_id)[0]]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            types = [pa.string(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "score", "label"])

    def chosen(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("step", ascending=False)
        best = calibrate_steps(*[frame[c].to_numpy() for c in ("low", "high", "n", "hits")])
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "threshold": [best]})

    steps = known.mapInArrow(scored, "lang string, score double, label int").groupBy("lang", F.floor(F.col("score") * STEPS).alias("step")).agg(
        F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"), F.sum("label").alias("hits"))
    return {r.lang: r.threshold for r in steps.groupBy("lang").applyInPandas(chosen, "lang string, threshold double").collect()}


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> Convolution:
    """Fit on all labelled documents, whole texts; a fifth of them sets thresholds.

    Words are counted over all of them. They are dealt into shards of about ``SHARD`` documents; the first sets out alone,
    then all shards go on from one state side by side, and their states are averaged, weighted by documents.
    """
    small_batches(docs.sparkSession)
    known = materialise(labelled_documents(docs.select("doc_id", "text", "lang"), usable_labels(labels, "toxic", modulus, held_out)), "labelled")
    rows, total, ones = _vocabulary(known)
    if total == 0:
        model = begin(rows, 0.5)
    else:
        model, shards = begin(rows, ones / total), -(-total // SHARD)
        numbered = materialise(known.mapInArrow(_numbered(model, shards), "shard long, doc_id long, label int, ids binary"), "numbered")
        first = numbered.filter("shard = 0")
        state = state_of(model) if first.isEmpty() else _learn(first, model, state_of(model), EPOCHS, 1)
        for _ in range(ROUNDS if shards > 1 else 0):
            state = _learn(numbered, model, state, 1, shards)
        set_state(model, state)
    model.thresholds = dict(sorted(_thresholds(known, model).items()))
    return model


def threshold(model: Convolution, lang: Column) -> Column:
    """The calibrated threshold of a row's language; 0.5 for languages that were not seen and for null."""
    out = F.lit(0.5)
    for name, value in model.thresholds.items():
        out = F.when(F.coalesce(lang, F.lit("")) == name, F.lit(value)).otherwise(out)
    return out


def score(docs: DataFrame, model: Convolution, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and ``toxic_score`` (0 to 1, higher: label 1 likelier).

    Null and empty texts score as texts of unknown words. Repeated rows stay, other columns are no input of the score and
    pass through, except that one named toxic_score is replaced.
    """
    docs = docs.drop(SCORE)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            scores = [model.score(v.as_py() or "") for v in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, SCORE])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())]))
