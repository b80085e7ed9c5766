"""The Merkle manifest against plain loops and SQL."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sluice.llm import merkle, queries
from tests.compare import compare, oracle_connection


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute(leaves, arity):
    """Levels of one tree, each a list of digests."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + arity]) for i in range(0, len(last), arity)])
    return levels


def sides(levels, i, arity):
    out = []
    for level in levels[:-1]:
        low = i - i % arity
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + arity])))
        i //= arity
    return out


def expected(rows, arity):
    """Per row (id, source, leaf, claimed): what ``manifest`` returns."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))
        trees.append(brute([r[2] for r in groups[s]], arity))
    top = brute([t[-1][0] for t in trees], arity)
    out = []
    for k, (s, levels) in enumerate(zip(names, trees)):
        for i, (doc, _, leaf, claimed) in enumerate(groups[s]):
            around, at = sides(levels, i, arity) + sides(top, k, arity), claimed
            for left, right in around:
                at = h(left, at, right)
            out.append((doc, s, leaf, levels[-1][0], top[-1][0], h(*[x + y for x, y in around]), at, at == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, arity):
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "id long, src string, a string, b string, tree int, digest string")
    got = merkle.manifest(docs, F.col("a"), F.col("b"), arity, "id", "src").select(
        "doc_id", "source", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("sides")), 256), "folded_root", "verified")
    return sorted((tuple(r) for r in got.collect()), key=str)


def rows_of(sizes):
    out = []
    for s, n in sizes.items():
        for i in range(n):
            leaf = h(str(s), str(i))
            out.append((i, s, leaf, leaf if i % 3 else h("changed", leaf)))
    return out


@pytest.mark.parametrize("arity", [2, 5])
def test_against_loops(spark, arity):
    rows = rows_of({"b": 1, "a": 2, None: 3, "é": 4, "z": 40, "": 10, "A": 9, "hot": 83})
    assert found(spark, rows, arity) == expected(rows, arity)


def test_odd_rows(spark):
    for rows in (rows_of({"only": 1}), rows_of({"only": 7}), rows_of({None: 1, "b": 1}), []):
        assert found(spark, rows, 3) == expected(rows, 3)
    twice = [(None, "s", "x", "x"), (None, "s", "x", "y"), (1, "s", "p", "p"), (1, "s", "p", "p"), (1, "s", "a", "a"), (2, None, "", ""), (2, None, "", "")]
    assert found(spark, twice, 3) == expected(twice, 3)
    with pytest.raises(ValueError):
        found(spark, twice, 1)


def test_scratch_tables_go(spark):
    from pathlib import Path

    from sluice.session import shared_dir

    docs = spark.createDataFrame(rows_of({"a": 30, "b": 5}), "doc_id long, source string, a string, b string")
    folder = Path(shared_dir(spark).removeprefix("file:")) / "sluice"
    before = set(folder.glob("merkle*"))
    merkle.manifest(docs, F.col("a"))
    # what the result reads: leaves, the lowest level and its proofs, subroots, proofs over the sources
    assert len(set(folder.glob("merkle*")) - before) <= 5


@pytest.mark.parametrize("sf", ["0.001"])
def test_registered(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    assert compare(oracle_connection(sf_dir), queries.op11_merkle_manifest(spark, sf_dir), queries.ORACLES["op11_merkle_manifest"]) == ""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    rows = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        text = r.text.replace("\n", "") if changed and r.text is not None else r.text
        rows.append((r.doc_id, r.source, *(h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, t))) for t in (r.text, text))))
    want = [(i, *told) for i, _, *told in expected(rows, 3)]
    got = [tuple(r) for r in queries.op11_merkle_manifest(spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[-1] for r in got} == {True, False}


def test_nulls_in_fields(spark):
    docs = spark.createDataFrame([(None, None, "é")], "a long, b string, c string")
    got = docs.select(F.concat(*[merkle.field_text(F.col(c)) for c in "abc"])).first()[0]
    assert got == "--2:é"
