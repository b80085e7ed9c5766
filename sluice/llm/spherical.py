"""Embedding near-duplicates with spherical-cap filters.

Filters are directions made of one codeword per half of a randomly rotated vector (a random product code), so a vector's
scores against all of them come from the scores of two short lists. There are several codes, each over a rotation of its
own. Every vector is decoded to all filters whose cap it lies in, and to its best filters of each code if those are few;
vectors of one label that share a filter meet there and are verified in double precision. A pair is counted at
the smallest filter that both share, so links are counted once and are never written out: a task returns per vector its
number of links and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.scale import materialise
from sluice.llm.components import connected_components
from sluice.llm.trie import Forest

#: rows of a similarity block
BLOCK = 1024
#: filters of each code that a vector goes to at least
LEAST_CAPS = 2


class ProductCode:
    """``words`` codewords for each half of the rotated space; filter a * words + b joins codewords a and b."""

    def __init__(self, dims: int, words: int, caps: float, seed: int = 7):
        self.padded = max(8, dims + dims % 2)
        rng = np.random.default_rng([seed, dims])
        self.rotation = np.linalg.qr(rng.standard_normal((self.padded, self.padded)))[0]
        codes = rng.standard_normal((2, words, self.padded // 2))
        self.codes = codes / np.linalg.norm(codes, axis=2, keepdims=True)
        self.words = words
        # the cap that a random unit vector lies in for ``caps`` filters on average
        self.height = NormalDist().inv_cdf(1 - min(0.4, caps / words**2)) / math.sqrt(self.padded)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters whose cap holds the row; of its best filters at least."""
        x = np.zeros((len(unit), self.padded))
        x[:, : unit.shape[1]] = unit
        x = x @ self.rotation
        half = self.padded // 2
        a, b = (x[:, :half] @ self.codes[0].T) / math.sqrt(2), (x[:, half:] @ self.codes[1].T) / math.sqrt(2)
        top_a, top_b = -np.sort(-a, axis=1)[:, :LEAST_CAPS], -np.sort(-b, axis=1)[:, :LEAST_CAPS]
        sums = np.sort((top_a[:, :, None] + top_b[:, None, :]).reshape(len(unit), LEAST_CAPS**2), axis=1)
        height = np.minimum(self.height, sums[:, -LEAST_CAPS])
        # codewords that no partner can lift over the cap are left out
        rows, firsts = np.nonzero(a + b.max(axis=1, keepdims=True) >= height[:, None])
        at, seconds = np.nonzero(a[rows, firsts][:, None] + b[rows] >= height[rows][:, None])
        return rows[at], firsts[at] * self.words + seconds


def _decode(codes: int, words: int, caps: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, same in frame.groupby(frame["vec"].map(len)):
                coders = [ProductCode(int(dims), words, caps, seed) for seed in range(codes)]
                for at in range(0, len(same), 512):
                    part = same.iloc[at : at + 512]
                    x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    found = [coder.decode(x) for coder in coders]
                    row = np.concatenate([r for r, _ in found])
                    cap = np.concatenate([c + k * words**2 for k, (_, c) in enumerate(found)]).astype(np.int32)
                    order = np.lexsort((cap, row))
                    row, cap = row[order], cap[order]
                    lists = np.split(cap, np.cumsum(np.bincount(row, minlength=len(part)))[:-1])
                    yield pd.DataFrame({
                        "node": part["node"].to_numpy()[row], "label": part["label"].to_numpy()[row], "copies": part["copies"].to_numpy()[row],
                        "vec": part["vec"].to_numpy()[row], "dims": np.full(len(row), dims, np.int32), "cap": cap,
                        "caps": pd.Series([lists[r] for r in row], dtype=object),
                    })

    return run


def _bucket(frame: pd.DataFrame, cap: int, least: float) -> pd.DataFrame:
    """Links of one bucket that are counted here: those of pairs that share no smaller filter."""
    n = len(frame)
    node, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
    x = np.stack(frame["vec"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    smaller = [c[c < cap] for c in frame["caps"]]
    names, code = np.unique(np.concatenate(smaller), return_inverse=True) if n else (np.zeros(0), None)
    lies = np.zeros((n, max(1, len(names))), np.float32)
    lies[np.repeat(np.arange(n), [len(c) for c in smaller]), code] = 1
    links, forest = np.zeros(n, np.int64), Forest(n)
    for i in range(0, n, BLOCK):
        for j in range(i, n, BLOCK):
            near = x[i : i + BLOCK] @ x[j : j + BLOCK].T >= least
            if i == j:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            if len(a) == 0:
                continue
            new = (lies[i : i + BLOCK] @ lies[j : j + BLOCK].T)[a, b] == 0
            a, b = a[new] + i, b[new] + j
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            forest.link(a, b)
    i, j = forest.edges()
    counted = np.flatnonzero(links)
    return pd.DataFrame({
        "a": np.concatenate([node[counted], node[i]]), "b": np.concatenate([node[counted], node[j]]),
        "links": np.concatenate([links[counted], np.zeros(len(i), np.int64)]),
    })


def _verify(least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def finished(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for (_, _, cap), bucket in frame.groupby(["label", "dims", "cap"], sort=False):
                if len(bucket) > 1:
                    yield _bucket(bucket, cap, least)

        for frame in frames:
            if frame.empty:
                continue
            held.append(frame)
            joined = pd.concat(held) if len(held) > 1 else frame
            key = joined[["label", "dims", "cap"]]
            open_ = (key == key.iloc[-1]).all(axis=1)  # the last bucket may go on in the next batch
            yield from finished(joined[~open_])
            held = [joined[open_]]
        if held:
            yield from finished(pd.concat(held))

    return run


def usable(vec: str = "embedding"):
    """Not null, not zero, and without null or non-finite components."""
    c = F.col(vec)
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return c.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(c, lambda v: v != 0)


def near_duplicates(
    vectors: DataFrame, least: float = 0.93, codes: int = 8, caps: float = 6, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per row of ``vectors``.

    Rows link if their labels are equal and not null, their vectors equally long and their cosine at least ``least``.
    Vectors that are null, zero or hold null or non-finite components, and rows without label, link with nothing and are
    components of their own. Equal vectors of a label are one row until the end, so copies cost nothing. A vector lies in
    ``caps`` caps of each code on average whatever the size of the table; the number of filters follows the number of
    vectors. Repeated
    ids are rows of their own with the smallest id of their component. A null vec_id counts as a link but names no
    component. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.transform(vec, lambda v: v + F.lit(0.0).cast("float")).alias("vec"), F.col(label).cast("string").alias("label"))
    good = usable("vec") & F.col("label").isNotNull()
    classes = materialise(
        rows.filter(good).groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
        .withColumn("node", F.xxhash64("label", "vec")),
        "caps-classes",
    )
    n = classes.count()
    words = 2 ** max(5, math.ceil(math.log2(max(1, n * caps / 512)) / 2))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.select("node", "label", "copies", "vec").repartition(tasks).mapInPandas(
        _decode(codes, words, caps), f"node long, label string, copies long, vec {dict(classes.dtypes)['vec']}, dims int, cap int, caps array<int>"
    )
    found = materialise(
        dealt.repartition(tasks, "label", "dims", "cap").sortWithinPartitions("label", "dims", "cap")
        .mapInPandas(_verify(least), "a long, b long, links long"),
        "caps-links",
    )
    counts = found.filter("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "k")
    named = (
        classes.join(counts, F.col("node") == F.col("a"), "left").join(parts, F.col("node") == F.col("k"), "left")
        .select("label", "vec", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                F.coalesce("component", "node").alias("component"))
    )
    named = materialise(named, "caps-components")
    least_id = named.groupBy("component").agg(F.min("first").alias("least"))
    told = named.join(least_id, "component").select(
        F.xxhash64("label", "vec").alias("__n"), F.col("links").alias("__links"), F.col("least").alias("__least")
    )
    keyed = rows.select("vec_id", F.when(good, F.xxhash64("label", "vec")).alias("__k"))
    out = keyed.join(told, F.col("__k") == F.col("__n"), "left")
    return out.select(
        "vec_id", F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("__least", "vec_id").cast("long").alias("component_id"),
        (F.coalesce("__least", "vec_id") == F.col("vec_id")).alias("kept"),
    )
