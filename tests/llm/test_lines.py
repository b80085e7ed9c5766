"""Line dedup against brute force and SQL."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sluice.llm import line_dedup, queries
from tests.compare import compare, oracle_connection

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least_chars=40, least_docs=5):
    """(lines, dropped, text left) of rows (id, text); None is an id smaller than all."""
    rank = lambda i: (i is not None, i or 0)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == rank(i)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def found(spark, rows, **more):
    docs = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "n long, doc_id long, text string")
    told = line_dedup.find_duplicate_lines(docs, **more)
    got = told.select("n", line_dedup.COUNT, line_dedup.dropped_count(F.col(line_dedup.KEEP)).alias("gone"),
                      line_dedup.kept_text(F.col("text"), F.col(line_dedup.KEEP)).alias("left")).orderBy("n").collect()
    return [tuple(r)[1:] for r in got]


def test_against_brute_force(spark):
    rng = random.Random(3)
    common = [f"Common line number {k} that is long enough to count É" for k in range(6)] + ["short", "", " x" * 20, "Y" * 40, "Y" * 39]
    rows = []
    for i in range(120):
        lines = [rng.choice(common) if rng.random() < 0.6 else f"own {i} {rng.random()} {'w ' * 20}" for _ in range(rng.randrange(9))]
        lines = [rng.choice((x, x.upper() if x.isascii() else x, f" \t{x}\r", x + "\x0b")) for x in lines]
        rows.append((i // 2 if i < 20 else i, "\n".join(lines)))
    assert found(spark, rows) == brute(rows)
    assert any(gone for _, gone, _ in brute(rows))


def test_odd_rows(spark):
    line = "the same line, of forty code points or more ß"
    rows = [(None, line), (None, line + "\nother"), (1, line), (1, line), (2, None), (3, ""), (4, "\n\n"), (5, f"{line}\n{line}\n x\n{line}\n"),
            (6, f"{line}\n" * 30_000), (7, "a" + line), (8, line.replace("ß", "SS")), (9, f"\n{line}"), (9, f"\n{line}\nb")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, least_docs=1) == brute(rows, least_docs=1)
    assert found(spark, rows, least_docs=4, least_chars=1) == brute(rows, least_docs=4, least_chars=1)
    assert found(spark, []) == []


def test_names_that_clash(spark):
    names = ["doc", "own", "pos", "hash", "range", "first", "keep", "row", "lines", "d", "o", "k", "line_keep"]
    docs = spark.createDataFrame([(i, "x" * 50, *range(len(names))) for i in range(6)], f"doc_id long, text string, {' int, '.join(names)} int")
    rows = line_dedup.find_duplicate_lines(docs).orderBy("doc_id").collect()
    assert [tuple(r)[2 : 1 + len(names)] for r in rows] == [tuple(range(len(names) - 1))] * 6
    assert [r.line_keep for r in rows] == [[0, 1]] * 5 + [None]


def test_only_jvm_work_and_no_lines_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = line_dedup.find_duplicate_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_registered(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    assert compare(oracle_connection(sf_dir), queries.op13_line_dedup(spark, sf_dir), queries.ORACLES["op13_line_dedup"]) == ""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, gone, hashlib.sha256(left.encode()).hexdigest()) for (i, _), (n, gone, left) in zip(rows, brute(rows), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op13_line_dedup(spark, sf_dir).collect()} == want
