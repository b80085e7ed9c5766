"""Periodic runs against brute force: every start and period, maximal by definition."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from sluice.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=24, times=3):
    """Maximal stretches by lag, kept if the lag is their smallest period."""
    out, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q) and (i, j - i + q) not in out:
                out[i, j - i + q] = q  # smaller lags came first: a stretch found before has a smaller period
            i = j + 1
    return sorted((i, length, q) for (i, length), q in out.items())


def brute_collapsed(words, runs):
    gone = {k for i, length, q in runs for k in range(i + q, i + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def numbers(words):
    return np.unique(words, return_inverse=True)[1].astype(np.int64)


def texts(rng):
    for _ in range(150):
        v = rng.choice((1, 2, 3, 10, 60))
        words = [f"w{rng.randrange(v)}" for _ in range(rng.randrange(160))]
        for _ in range(rng.randrange(4)):
            period = [f"p{rng.randrange(rng.choice((1, 2, 30)))}" for _ in range(rng.choice((1, 2, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40)))]
            stretch = (period * 30)[: rng.randrange(20, 140)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = stretch
        yield words


def test_runs_against_brute_force():
    some = 0
    for words in texts(random.Random(8)):
        want = brute_runs(words)
        some += len(want)
        assert [tuple(r) for r in periodic.periodic_runs(numbers(words) if words else np.zeros(0, np.int64)).tolist()] == want
    assert some > 200


@pytest.mark.parametrize("least,times", [(1, 3), (5, 3), (24, 4), (100, 3)])
def test_other_bounds(least, times):
    for words in texts(random.Random(least)):
        if words:
            assert [tuple(r) for r in periodic.periodic_runs(numbers(words), least, times).tolist()] == brute_runs(words, least, times)


def test_words_and_pieces(monkeypatch):
    raw = "a  b\x0bc d\x1ee é\n".encode() * 50 + b"z" * 100
    whole = periodic.word_ids(raw).tolist()
    monkeypatch.setattr(periodic, "PIECE", 7)
    assert periodic.word_ids(raw).tolist() == whole
    words = split(raw.decode())
    assert [words.index(w) for w in words] == [words.index(words[i]) for i in np.unique(whole, return_index=True)[1][whole].tolist()]
    runs = periodic.periodic_runs(np.array(whole))
    assert periodic._collapsed(raw, runs, len(whole)) == brute_collapsed(words, brute_runs(words))


def test_long_texts_of_few_words_do_not_cost_squares():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 3, 1_000_000)
    ids[300_000:900_000] = np.resize(rng.integers(0, 3, 150_001), 600_000)  # nearly four periods
    runs = periodic.periodic_runs(ids)
    assert [300_000, 600_000, 150_001] in [[r[0] + 300_000 - r[0], r[1], r[2]] for r in runs.tolist() if r[2] > 1000] or any(
        r[2] == 150_001 and r[1] >= 600_000 for r in runs.tolist())
    ones = periodic.periodic_runs(np.zeros(1_000_000, np.int64))
    assert ones.tolist() == [[0, 1_000_000, 1]]


def planted(doc_id, words):
    h = periodic.crc_of(doc_id)
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(rows):
    out = {}
    for i, t in rows:
        words = planted(i, split(t)) if i is not None else split(t)
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        text = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        out[i] = (len(runs), *told, *(hashlib.sha256(x.encode()).hexdigest() for x in (text, brute_collapsed(words, runs))))
    return out


def test_registered(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if len(split(t)) < 3000]  # brute force is quadratic
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(rows) > 150
    want = expected(rows)
    assert {i: got[i] for i in want} == want
    assert sum(n > 0 for n, *_ in got.values()) > 5


def test_odd_rows(spark):
    rows = [(None, "x " * 30), (None, None), (2, ""), (2, " \n "), (3, "a b " * 40), (3, "a b " * 40), (17, "é ü " * 4 + "z")]
    ids = [k for k in range(400) if periodic.crc_of(k) % 10 == 0][:3]
    rows += [(ids[0], None), (ids[1], " "), (ids[2], " ".join(f"q{j}" for j in range(200)))]
    docs = spark.createDataFrame([(*r, 5, "t") for r in rows], "doc_id long, text string, periodic_words int, periodic_text string")
    got = [tuple(r) for r in queries.periodic_digests(docs).collect()]
    want = [(i, *next(iter(expected([(i, t)]).values()))) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert queries.periodic_digests(docs.limit(0)).count() == 0
