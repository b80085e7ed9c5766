"""Embedding operators against brute force."""

import numpy as np
import pytest

from sluice.llm import nn_descent, queries, spherical
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def odd_rows():
    nan, inf = float("nan"), float("inf")
    base = np.random.default_rng(1).standard_normal((6, 16)).astype(np.float32)
    rows = [(i, base[i].tolist(), 1) for i in range(6)] + [(10 + i, (base[i] * (1.0 + i)).tolist(), 1) for i in range(6)]
    rows += [(20 + i, base[0].tolist(), 1) for i in range(8)] + [(20, base[0].tolist(), 1), (30, base[0].tolist(), None), (31, base[0].tolist(), 2)]
    rows += [(40, None, 1), (41, [0.0] * 16, 1), (42, [nan] * 16, 1), (43, [inf] + [0.0] * 15, 1), (44, [None] + [1.0] * 15, 1), (45, [], 1)]
    return rows + [(46, [1.0, 2.0], 1), (47, [2.0, 4.0], 1), (48, [-0.0] + [1.0] * 15, 3), (49, [0.0] + [1.0] * 15, 3), (50, base[1].tolist(), 1)]


def good(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)


def cosine(a, b):
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def brute_links(rows, least=0.93):
    pairs = [
        (i, j) for i, (_, a, x) in enumerate(rows) for j, (_, b, y) in enumerate(rows[:i])
        if x is not None and x == y and good(a) and good(b) and len(a) == len(b) and cosine(a, b) >= least
    ]
    part = brute_components([(j, i) for i, j in pairs], range(len(rows)))
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(part[i], []).append(r[0])
    return sorted((r[0], sum(i in p for p in pairs), min(ids[part[i]]), r[0] == min(ids[part[i]])) for i, r in enumerate(rows))


def test_caps_on_odd_rows(spark):
    rows = odd_rows()
    got = spherical.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(rows)
    assert spherical.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_caps_find_all_links(spark):
    """Pairs at the very threshold in 64 dimensions, the hardest to find."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1500, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(np.concatenate([x, 0.931 * x + np.sqrt(1 - 0.931**2) * y]).astype(np.float32))]
    rows = [(i, v, j % 1500 % 3) for j, (i, v, _) in enumerate(rows)]
    got = spherical.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    assert got.filter("n_links = 1").count() >= 2999


def test_registered_caps(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op10_spherical_caps(spark, SF).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(rows)


def brute_nearest(rows, k=5):
    rows = [r for r in rows if good(r[1]) and r[0] is not None]
    out = {}
    for q, a, _ in rows:
        if q % 50 == 0:
            scored = sorted((-cosine(a, b), i) for i, b, _ in rows if i != q and len(a) == len(b))
            out[q] = scored[:k]
    return out


def recall(got, want):
    hits = {}
    for r in got:
        hits.setdefault(r.query_id, {})[r.rank] = r
    for q, found in hits.items():
        assert sorted(found) == list(range(1, len(want[q]) + 1))
        assert [(-found[i].score, found[i].vec_id) for i in sorted(found)] == sorted((-r.score, r.vec_id) for r in found.values())
    assert hits.keys() == {q for q in want if want[q]}
    return sum(r.vec_id in {i for _, i in want[q]} for q in hits for r in hits[q].values()) / sum(map(len, want.values()))


def test_nearest_on_odd_rows(spark):
    rows = list({r[0]: r for r in odd_rows()}.values()) + [(100, [1.0] * 16, 1), (150, [0.0] * 16, 1), (200, [5.0, 1.0, 2.0], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = nn_descent.nearest(frame, frame["vec_id"] % 50 == 0).collect()
    assert recall(got, brute_nearest(rows)) == 1
    empty = frame.limit(0)
    assert nn_descent.nearest(empty, empty["vec_id"] % 50 == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_nearest(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert recall(queries.op4_nn_descent(spark, folder).collect(), brute_nearest(rows)) >= 0.9


def test_nearest_among_near_copies(spark):
    """A third of the rows are copies of one vector, nearer to each other than a component of one byte tells."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 64))
    x[::3] = x[0] + 0.002 * rng.standard_normal((2000, 64))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x.astype(np.float32))]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = nn_descent.nearest(frame, frame["vec_id"] % 50 == 0).collect()
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {}
    for q in range(0, len(rows), 50):
        sims = unit @ unit[q]
        sims[q] = -2
        want[q] = [(-sims[i], int(i)) for i in np.argsort(-sims, kind="stable")[:5]]
    copies = [r for r in got if r.query_id % 3 == 0]
    assert recall(got, want) >= 0.9
    assert recall(copies, {q: w for q, w in want.items() if q % 3 == 0}) >= 0.9
