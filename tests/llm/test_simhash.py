"""SimHash fingerprints, the trie join and components against brute force."""

import random

import numpy as np
import xxhash

from sluice.llm import queries, simhash, trie
from sluice.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute_print(text, words=4):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    grams = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_trie_finds_all_close_pairs():
    rng = np.random.default_rng(3)
    for budget in (1, 4):
        words = rng.integers(0, 2**63, 150, dtype=np.uint64)
        near = words[rng.integers(0, 150, 300)]
        for _ in range(3):
            near = near ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
        words = np.concatenate([words, near, np.arange(40, dtype=np.uint64)])
        groups = rng.integers(0, 3, len(words))
        order = np.lexsort((words, groups))
        groups, words = groups[order], words[order]
        first = np.concatenate([[True], (groups[1:] != groups[:-1]) | (words[1:] != words[:-1])])
        groups, words = groups[first], words[first]
        got = {(a, b) for i, j in trie.close_pairs(groups, words, budget, frontier=64) for a, b in zip(i.tolist(), j.tolist())}
        assert got == {
            (i, j) for i in range(len(words)) for j in range(i + 1, len(words))
            if groups[i] == groups[j] and int(words[i] ^ words[j]).bit_count() <= budget
        }


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    ids = {i for p in pairs for i in p if p[0] != p[1]}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == brute_components([p for p in pairs if p[0] != p[1]], ids)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    values = sorted({p for _, p in prints})
    links = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 4]
    part = brute_components(links, values)
    least = {}
    for i, p in prints:
        if i is not None:
            least[part[p]] = min(i, least.get(part[p], i))
    return sorted(((i, p, least.get(part[p])) for i, p in prints), key=str)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(3, None), (1, ""), (5, " \n"), (2, "one two"), (2, "one two"), (None, "ONE two"), (9, "É a b c d"), (4, "é a b c d"), (7, long), (6, long + " end")]
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in rows], "doc_id long, text string, node string, simhash array<int>")
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.simhash[0] % 2**64, r.component_id) for r in got), key=str) == expected(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_registered(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op6_simhash(spark, SF).collect()), key=str)
    assert got == expected(rows)
