"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily.

The graph is an edge table. It starts from the best neighbours inside random hyperplane buckets and gets better by local
joins: every node sends itself to its neighbours, where those that meet are neighbours of neighbours and are compared;
better candidates go back and each node keeps its ``degree`` best. Only pairs with a new edge are compared again, and
rounds end when few edges change. Queries hold a beam of candidates that Spark joins with the graph, all open candidates
of all queries at once, until no beam changes. Graph and search use the vectors as they came and cosines in double
precision: near copies of each other differ by less than a rounded component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.scale import materialise
from sluice.llm.spherical import usable

#: members compared at once in a bucket or at a node; more are dealt into chunks of this size, others in each table and round
MEMBERS = 512
#: rounds end when no more than this share of the edges is new
SETTLED = 0.001
#: candidates that a node takes from one local join
OFFERS = 6


def unpacked(column: pd.Series, kind: str) -> np.ndarray:
    """Unit vectors of packed ones of equal length, whose components have the numpy type ``kind``."""
    x = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(bits: int, tables: int):
    """Packed vectors and their bucket in each of the hyperplane tables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, same in frame.groupby(frame["vec"].map(len)):
                raw = np.stack(same["vec"].to_numpy())
                x = raw.astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                planes = np.random.default_rng([11, int(dims)]).standard_normal((int(dims), tables * bits))
                code = ((x @ planes) > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits)) if bits else np.zeros((len(x), tables), int)
                keys = code + (np.arange(tables) << 40) + (int(dims) << 44)
                yield pd.DataFrame({"node": same["node"].to_numpy(), "packed": [r.tobytes() for r in raw], "keys": list(keys.astype(np.int64))})

    return run


def _best(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, fresh: np.ndarray, degree: int) -> pd.DataFrame:
    """The ``degree`` nearest of each node, repeated pairs once (as old if one was old), with the last one's nearness."""
    order = np.lexsort((fresh, nbr, node))
    node, nbr, sim, fresh = node[order], nbr[order], sim[order], fresh[order]
    first = np.ones(len(node), bool)
    first[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])
    node, nbr, sim, fresh = node[first], nbr[first], sim[first], fresh[first]
    order = np.lexsort((nbr, -sim, node))
    node, nbr, sim, fresh = node[order], nbr[order], sim[order], fresh[order]
    start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
    group = np.repeat(np.arange(len(start)), np.diff([*start, len(node)]))
    rank = np.arange(len(node)) - start[group] if len(node) else np.zeros(0, int)
    full = np.bincount(group, minlength=len(start)) >= degree
    least = np.full(len(start), -2.0)
    least[full] = sim[start[full] + degree - 1]
    keep = rank < degree
    return pd.DataFrame({"node": node, "nbr": nbr, "sim": sim, "fresh": fresh, "least": least[group]})[keep]


def _offers(node: np.ndarray, x: np.ndarray, least: np.ndarray, fresh: np.ndarray | None, most: int) -> tuple[np.ndarray, ...]:
    """Of members that meet: for each its nearest others beyond ``least``; with ``fresh``, of pairs with a new edge only."""
    sims = x @ x.T
    np.fill_diagonal(sims, -3)
    if fresh is not None:
        sims[~(fresh[:, None] | fresh[None, :])] = -3
    sims[node[:, None] == node[None, :]] = -3
    k = min(most, len(node) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(node) - 1 else np.argsort(-sims, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(node)), k)
    cols = top.reshape(-1)
    good = sims[rows, cols] > least[rows]
    return node[rows[good]], node[cols[good]], sims[rows[good], cols[good]]


def _meet(key: str, most: int, descent: bool, kind: str):
    """Compares the rows of each key, chunk by chunk; rows come sorted by key, and only an open chunk is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame, last in _with_last(frames):
            frame = frame if held is None else pd.concat([held, frame])
            keys = frame[key].to_numpy()
            bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            ends = [*bounds[1:], len(keys)]
            if not last and len(bounds):
                ends[-1] -= (ends[-1] - bounds[-1]) % MEMBERS
                held = frame.iloc[ends[-1] :]
            else:
                held = None
            node, least = frame["node"].to_numpy(), frame["least"].to_numpy()
            fresh = frame["fresh"].to_numpy() if descent else None
            out: list[tuple[np.ndarray, ...]] = []
            blobs = frame["packed"]
            for a, b in zip(bounds, ends, strict=True):
                for at in range(a, b, MEMBERS):
                    s = slice(at, min(b, at + MEMBERS))
                    if s.stop - s.start > 1 and (fresh is None or fresh[s].any()):
                        out.append(_offers(node[s], unpacked(blobs.iloc[s], kind), least[s], None if fresh is None else fresh[s], most))
            if out:
                n, m, s = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pd.DataFrame({"node": n, "nbr": m, "sim": s, "fresh": np.ones(len(n), bool)})

    return run


def _with_last(frames: Iterator[pd.DataFrame]):
    """(frame, whether it is the last)."""
    before = None
    for frame in frames:
        if before is not None:
            yield before, False
        before = frame
    if before is not None:
        yield before, True


def _keep(degree: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(f["node"].to_numpy(), f["nbr"].to_numpy(), f["sim"].to_numpy(), f["fresh"].to_numpy()) for f in frames]
        if parts:
            yield _best(*(np.concatenate(c) for c in zip(*parts, strict=True)), degree)

    return run


EDGE = "node long, nbr long, sim double, fresh boolean, least double"
PAIR = "node long, nbr long, sim double, fresh boolean"


def build_graph(classes: DataFrame, degree: int = 24, settled: float = SETTLED, tables: int = 8, bucket: int = 64) -> tuple[DataFrame, DataFrame]:
    """(vectors: node, packed; edges: node, nbr, sim) of the rows (node, vec) of ``classes``, all of them indexed.

    Rounds go on until at most ``settled`` of the edges are new; each round makes edges better, so they end.
    """
    spark = classes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = classes.count()
    bits = max(0, math.ceil(math.log2(max(1, n / bucket))))
    coded = materialise(classes.select("node", "vec").mapInPandas(_pack(bits, tables), "node long, packed binary, keys array<long>"), "graph-vectors")
    vectors = coded.select("node", "packed")
    dealt = coded.select("node", "packed", F.explode("keys").alias("key"), F.lit(-2.0).alias("least"))
    kind = numpy_kind(classes)
    mixed = F.xxhash64("node", "key")
    met = dealt.repartition(tasks, "key").sortWithinPartitions("key", mixed).mapInPandas(_meet("key", degree, False, kind), PAIR)
    edges = materialise(met.repartition(tasks, "node").mapInPandas(_keep(degree), EDGE), "graph-edges")
    turn = 0
    while True:
        total, new = edges.agg(F.count("*"), F.count_if("fresh")).first()
        if new <= settled * total:
            break
        turn += 1
        sent = edges.join(vectors, "node").select(F.col("nbr").alias("key"), "node", "packed", "least", "fresh")
        # A node is there itself too, so that it learns of those it is a neighbour of.
        itself = edges.groupBy("node").agg(F.first("least").alias("least")).join(vectors, "node").select(
            F.col("node").alias("key"), "node", "packed", "least", F.lit(False).alias("fresh")
        )
        offered = (
            sent.unionByName(itself).repartition(tasks, "key").sortWithinPartitions("key", F.xxhash64("node", F.lit(turn)))
            .mapInPandas(_meet("key", OFFERS, True, kind), PAIR)
        )
        old = edges.select("node", "nbr", "sim", F.lit(False).alias("fresh"))
        edges = materialise(old.unionByName(offered).repartition(tasks, "node").mapInPandas(_keep(degree), EDGE), "graph-edges")
    return vectors, edges.select("node", "nbr", "sim")


def numpy_kind(rows: DataFrame, vec: str = "vec") -> str:
    return "f4" if rows.schema[vec].dataType.elementType == T.FloatType() else "f8"


def _score(kind: str):
    """Neighbours of open candidates that are nearer to the query than the last of its beam."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for q, asked, ids, blob, least in zip(frame["query"], frame["asked"], frame["nbrs"], frame["packs"], frame["least"], strict=True):
                sims = unpacked(blob, kind) @ unpacked([asked], kind)[0]
                near = sims > least
                out.append((np.full(near.sum(), q), np.asarray(ids)[near], sims[near]))
            if out:
                q, n, s = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pd.DataFrame({"node": q, "nbr": n, "sim": s, "fresh": np.ones(len(q), bool)})

    return run


def search_graph(asked: DataFrame, vectors: DataFrame, edges: DataFrame, kind: str, beam: int = 256, degree: int = 24) -> DataFrame:
    """(query, node, sim): the beam of each row (query, node) of ``asked``, whose node is where its search begins."""
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    back = edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim")
    ranked = back.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))).filter(F.col("r") <= degree)
    both = edges.select("node", "nbr").unionByName(ranked.select("node", "nbr")).distinct()
    far = vectors.select(F.col("node").alias("nbr"), "packed")
    graph = materialise(
        both.join(far, "nbr").groupBy("node").agg(F.collect_list(F.struct("nbr", "packed")).alias("l"))
        .select("node", F.col("l.nbr").alias("nbrs"), F.col("l.packed").alias("packs")),
        "search-graph",
    )
    start = materialise(asked.join(vectors, "node").select("query", "node", F.col("packed").alias("asked")), "search-start")
    beams = start.select(F.col("query").alias("node"), F.col("node").alias("nbr"), F.lit(1.0).alias("sim"),
                         F.lit(True).alias("fresh"), F.lit(-2.0).alias("least"))
    who = start.select("query", "asked")
    while True:
        open_ = beams.filter("fresh").select(F.col("node").alias("query"), F.col("nbr").alias("node"), "least")
        found = open_.join(who, "query").join(graph, "node").select("query", "asked", "nbrs", "packs", "least").mapInPandas(_score(kind), PAIR)
        # ``_best`` keeps a known pair as old, so a candidate is opened once
        merged = beams.select("node", "nbr", "sim", F.lit(False).alias("fresh")).unionByName(found)
        beams = materialise(merged.repartition(tasks, "node").mapInPandas(_keep(beam), EDGE), "search-beam")
        if not beams.filter("fresh").limit(1).count():
            return beams.select(F.col("node").alias("query"), F.col("nbr").alias("node"), "sim")


def _cosine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        scores = [
            float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
            for a, b in zip((np.asarray(v, np.float64) for v in frame["asked"]), (np.asarray(v, np.float64) for v in frame["vec"]), strict=True)
        ]
        yield pd.DataFrame({"query": frame["query"], "node": frame["node"], "score": scores})


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, beam: int = 256, degree: int = 24, settled: float = SETTLED, vec_id: str = "vec_id", vec: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, its ``k`` nearest other rows found.

    Nearness is the cosine in double precision, ties go to the smaller vec_id. Null or zero vectors, vectors with null or
    non-finite components and rows without vec_id take no part, as query or candidate; vectors of other lengths are never
    near. Equal vectors are one node of the graph, of which the ``k`` + 1 smallest ids can be results. Of rows with one
    id one is used, the largest vector in order of components. With fewer than ``k`` others all are returned; an empty table gives an empty table.
    """
    usable_rows = vectors.filter(usable(vec) & F.col(vec_id).isNotNull())
    rows = usable_rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vec, lambda v: v + F.lit(0.0).cast("float")).alias("vec"), is_query.alias("asks"))
    rows = rows.groupBy("vec_id").agg(F.max(F.struct("vec", "asks")).alias("r")).select("vec_id", "r.vec", "r.asks", F.xxhash64("r.vec").alias("node"))
    rows = materialise(rows, "nearest-rows")
    classes = materialise(rows.groupBy("node").agg(F.first("vec").alias("vec")), "nearest-classes")
    packs, edges = build_graph(classes, degree, settled)
    asked = rows.filter("asks").select(F.col("vec_id").alias("query"), "node", "vec")
    found = search_graph(asked.select("query", "node"), packs, edges, numpy_kind(classes), beam, degree)
    pairs = found.select("query", "node").join(asked.select("query", F.col("vec").alias("asked")), "query").join(classes, "node")
    scored = pairs.select("query", "node", "asked", "vec").mapInPandas(_cosine, "query long, node long, score double")
    members = rows.withColumn("m", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("m") <= k + 1)
    hits = scored.join(members.select("node", "vec_id"), "node").filter("vec_id <> query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
