"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are binned; every feature has a lookup table over its bins, learned by cyclic boosting: round
after round, each feature in turn fits a tree of few leaves to the residuals and adds it to its table. Then the pairs
whose joint tables explain most of what is left are boosted in the same way. A score is the sum of looked-up values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.batches import give_back, small_batches
from sluice.llm.labelled import class_counts, sample_documents, sample_labels

SCORE = "quality_score"
FEATURES = (
    "log_words", "mean_word", "distinct_share", "same_as_before", "upper_share", "mark_share", "bar_share", "doubled_end_share",
    "digit_share", "sign_share", "line_repeats", "mean_line", "capital_words", "top_word", "pair_repeats",
)
_KIND = np.zeros(256, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
for _c in b"#$%&*@^~=+<>{}[]\\":
    _KIND[_c] = 4
for _c in b"!?.,;:'\"()-/_":
    _KIND[_c] = 5
_KIND[128:] = 6


def features(text: str) -> list[float]:
    """Numbers about a whole text; an empty one has zeros."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7)
    shown = max(1, int(kinds[1:].sum()))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    joined = list(zip(words, words[1:], strict=False))
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, len(counts) / n, sum(map(eq, words, words[1:])) / n,
        kinds[1] / max(1, kinds[1] + kinds[2]), kinds[5] / shown, counts.get(b"|", 0) / n,
        sum(w[-2:-1] == w[-1:] and not w[-1:].isalnum() for w in words) / n, kinds[3] / shown, kinds[4] / shown,
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
        sum(w[:1].isupper() for w in words) / n, counts.most_common(1)[0][1] / n, 1 - len(set(joined)) / max(1, len(joined)),
    ]


@dataclass
class Additive:
    """Bin edges by feature, a table by feature and by pair of features, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]
    wide: list[np.ndarray]  # coarser bins for the pairs: bin of a feature -> coarse bin
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1 of rows of features, by additions of looked-up values."""
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[b[:, f]]
        for (f, g), table in self.pairs.items():
            total += table[self.wide[f][b[:, f]], self.wide[g][b[:, g]]]
        return 1 / (1 + np.exp(-total))


def _shallow_tree(residual: np.ndarray, weight: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of a tree with at most ``leaves`` leaves on sums of residuals and weights by bin."""
    value = np.zeros(len(residual))
    open_ = [(0, len(residual))]
    r, w = np.concatenate([[0], residual.cumsum()]), np.concatenate([[0], weight.cumsum()])
    gain_of = lambda a, b: (r[b] - r[a]) ** 2 / (w[b] - w[a] + ridge)
    while len(open_) < leaves:
        best = (1e-9, None)
        for a, b in open_:
            for m in range(a + 1, b):
                gain = gain_of(a, m) + gain_of(m, b) - gain_of(a, b)
                if gain > best[0]:
                    best = (gain, (a, m, b))
        if best[1] is None:
            break
        a, m, b = best[1]
        open_.remove((a, b))
        open_ += [(a, m), (m, b)]
    for a, b in open_:
        value[a:b] = (r[b] - r[a]) / (w[b] - w[a] + ridge)
    return value


def fit(
    x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, bins: int = 32, rounds: int = 60, pair_count: int = 6, pair_rounds: int = 30,
    rate: float = 0.25, leaves: int = 4, ridge: float = 8.0, coarse: int = 6,
) -> Additive:
    """Learn from rows of features and labels 0 and 1; without rows of either label every score is the share of label 1."""
    weights = np.ones(len(y)) if weights is None else weights
    share = float(np.clip((weights * y).sum() / max(1e-9, weights.sum()), 0.01, 0.99)) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    model = Additive(edges, [np.zeros(len(e) + 1) for e in edges], {}, [np.zeros(0, int)] * len(edges), float(np.log(share / (1 - share))))
    model.wide = [np.minimum(np.arange(len(e) + 1) * coarse // (len(e) + 1), coarse - 1) for e in edges]
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            step = rate * _shallow_tree(
                np.bincount(b[:, f], weights * (y - p), len(table)), np.bincount(b[:, f], weights * p * (1 - p), len(table)), leaves, ridge
            )
            table += step
            total += step[b[:, f]]
    p = 1 / (1 + np.exp(-total))
    cells = {(f, g): model.wide[f][b[:, f]] * coarse + model.wide[g][b[:, g]] for f, g in combinations(range(len(edges)), 2)}

    def left(cell: np.ndarray) -> float:
        r, w = np.bincount(cell, weights * (y - p), coarse**2), np.bincount(cell, weights * p * (1 - p), coarse**2)
        return float((r**2 / (w + ridge)).sum())

    chosen = sorted(cells, key=lambda k: -left(cells[k]))[:pair_count]
    model.pairs = {k: np.zeros((coarse, coarse)) for k in chosen}
    for _ in range(pair_rounds):
        for k in chosen:
            p = 1 / (1 + np.exp(-total))
            r, w = np.bincount(cells[k], weights * (y - p), coarse**2), np.bincount(cells[k], weights * p * (1 - p), coarse**2)
            # a split of either feature in each half of the other: the leaves of a tree of depth two
            best = (-1.0, None)
            for r2, w2, turned in ((r.reshape(coarse, coarse), w.reshape(coarse, coarse), False), (r.reshape(coarse, coarse).T, w.reshape(coarse, coarse).T, True)):
                for m in range(1, coarse):
                    value = np.zeros((coarse, coarse))
                    value[:m] = _shallow_tree(r2[:m].sum(axis=0), w2[:m].sum(axis=0), 2, ridge)
                    value[m:] = _shallow_tree(r2[m:].sum(axis=0), w2[m:].sum(axis=0), 2, ridge)
                    gain = float((value * r2 - 0.5 * value**2 * w2).sum())
                    if gain > best[0]:
                        best = (gain, value.T if turned else value)
            step = rate * best[1]
            model.pairs[k] += step
            total += step.reshape(-1)[cells[k]]
    return model


def train(docs: DataFrame, labels: DataFrame, most_per_class: int = 4000, modulus: int = 4, held_out: int = 2) -> Additive:
    """Fit on at most ``most_per_class`` labelled documents of each class; classes weigh as in all labels learned from."""
    small_batches(docs.sparkSession)
    learned = sample_labels(labels, "quality", modulus, held_out, most_per_class)
    rows = (
        sample_documents(docs.select("doc_id", "text"), learned)
        .select("__label", _feature_column(F.coalesce("text", F.lit(""))).alias("x")).toPandas()
    )
    shares = {r["label"]: r["count"] for r in class_counts(labels, "quality", modulus, held_out).collect()}
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = rows["__label"].to_numpy(float)
    weights = np.ones(len(y))
    for v in (0, 1):
        weights[y == v] = shares.get(v, 0) / max(1, (y == v).sum())
    weights *= len(y) / max(1e-9, weights.sum())
    return fit(x, y, weights)


def _feature_column(text):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(features)

    return run(text)


def score(docs: DataFrame, model: Additive, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and ``quality_score`` (0 to 1, higher: label 1 likelier).

    Null and empty texts have the features of no words and a score like any others; repeated rows stay; other columns
    are no input of the score and pass through, except that one named quality_score is replaced.
    """
    docs = docs.drop(SCORE)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            x = np.array([features(v.as_py() or "") for v in column]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, SCORE])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())]))
