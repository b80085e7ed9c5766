"""Mixing against a brute-force version in Python."""

import hashlib
import re

import pytest

from sluice.llm import mixing, queries
from tests.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"


def brute(rows, weights=(5, 2, 1), share=1.5, cap=2.0):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    capped, budget = set(), share * sum(size)
    while True:
        free = [s for s in sources if s not in capped]
        level = (budget - sum(cap * total[s] for s in capped)) / max(1e-9, sum(weight[s] for s in free)) if free else 0
        over = {s for s in free if weight[s] * level >= cap * total[s]}
        if not over:
            break
        capped |= over
    target = {s: min(cap * total[s], weight[s] * level) if s not in capped else cap * total[s] for s in sources}
    h = [int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) for i, *_ in rows]
    taken = [0] * len(rows)
    for s in sources:
        mine = [k for k, r in enumerate(rows) if r[2] == s]
        whole = int(target[s] // total[s]) if total[s] else 0
        extra, used, open_ = target[s] - whole * total[s], 0, True
        for k in mine:
            taken[k] = whole * size[k]
        for value in sorted({h[k] for k in mine}):
            unit = [k for k in mine if h[k] == value]
            n = sum(size[k] for k in unit)
            if used + n > extra:
                if extra > 0 and used + n - extra < extra - used:
                    for k in unit:
                        taken[k] += size[k]
                break
            used += n
            for k in unit:
                taken[k] += size[k]
    return sorted((str(r[0]), n, total[r[2]], round(target[r[2]], 6), t) for r, n, t in zip(rows, size, taken))


CASES = {
    "odd": [(1, "a b", "x"), (1, "a b", "x"), (None, "c d e", None), (2, None, "y"), (3, "", "y"), (4, " \t ", "z"), (5, "w " * 900, "big"), (6, "q", None)],
    "many": [(i, "w " * (1 + i * 7 % 40), f"s{i % 7 if i % 3 else 0}") for i in range(400)],
    "blank": [(1, None, None), (2, "", "a")],
    "one": [(1, "a b c", "x")],
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    rows = CASES[case]
    docs = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, text string, source string, low string, mix_size int")
    got = mixing.mix(docs).collect()
    assert sorted((str(r.doc_id), r.mix_size, r.mix_source_size, round(r.mix_target, 6), r.mix_taken) for r in got) == brute(rows)
    assert {r.low for r in got} == {"kept"}


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_registered(spark):
    assert compare(oracle_connection(SF), queries.op5_mixing(spark, SF), queries.MIXING_SQL) == ""


def test_columns_of_any_name_pass_through(spark):
    names = ["__h", "h", "below", "of", "__source", "__target"]
    docs = spark.createDataFrame([(i, "a b", "s", *range(len(names))) for i in range(4)], f"doc_id long, text string, source string, {' int, '.join(names)} int")
    assert {tuple(r[c] for c in names) for r in mixing.mix(docs).collect()} == {tuple(range(len(names)))}
