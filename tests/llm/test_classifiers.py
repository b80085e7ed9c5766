"""Classifiers: held-out accuracy, odd rows and scores that use texts only."""

import zlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def rows_of(spark, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    query = {"toxic": queries.op3_toxicity, "quality": queries.op8_quality}[column]
    return labels, query(spark, SF).collect()


@pytest.mark.parametrize(("column", "modulus", "rest", "cut", "least"), [("toxic", 5, 0, 0.5, 0.96), ("quality", 4, 2, 0.7, 0.98)])
def test_held_out_accuracy(spark, column, modulus, rest, cut, least):
    labels, rows = rows_of(spark, column)
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= least
    if column == "toxic":  # clean documents are left alone
        assert np.mean([r.predicted for r in held if labels[r.doc_id] == 0]) < 0.02


ODD = [(1, None, None), (2, "", "en"), (3, " \n", "xx"), (None, "a b c", "en"), (2, "", "en"), (4, "word " * 50_000, "de"), (5, "\x00 é😀", "fr")]


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_odd_rows(spark, kind):
    docs = spark.createDataFrame([(*r, 1.5) for r in ODD], "doc_id long, text string, lang string, toxic_score double")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)] + [(1, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = kind.train(docs, labels)
    got = kind.score(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r[kind.SCORE] <= 1 for r in got)
    same = {r[kind.SCORE] for r in got if not (r.text or "").strip()}
    assert len(same) == 1
    nothing = kind.train(docs.limit(0), labels.limit(0))
    assert {r[kind.SCORE] for r in kind.score(docs, nothing).collect()} <= {r[kind.SCORE] for r in kind.score(docs, nothing).collect()}
    assert kind.score(docs.limit(0), nothing).count() == 0


def test_calibration():
    assert toxicity.calibrate(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
    assert toxicity.calibrate(np.array([0.9]), np.array([1])) == 0.5


def test_interactions_are_learned():
    """Exclusive or of two features: no sum of single tables separates it."""
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (3, 7) in model.pairs
    assert np.mean((model.score(x[3000:]) >= 0.5) == y[3000:]) > 0.95


def test_class_counts_need_no_order(spark, monkeypatch):
    """Training sorts and limits labels only for its bounded sample; the shares of the classes are counted on all."""
    limits, real = [], quality.sample_labels
    monkeypatch.setattr(quality, "sample_labels", lambda *a: limits.append(a[-1]) or real(*a))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(60)], "doc_id long, text string")
    quality.train(docs, labels, most_per_class=10)
    assert limits == [10]
    got = {r["label"]: r["count"] for r in quality.class_counts(labels, "quality", 4, 2).collect()}
    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert got == {v: sum(int(i % 3 == 0) == v and i not in held and i != 1 for i in range(60)) for v in (0, 1)}


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """A word that only documents behind the first 2,500 of their class hold is counted and learned, whatever the shards."""
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    monkeypatch.setattr(toxicity, "SHARD", 2500)
    rank = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"))
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    kept = rows.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    late = kept.withColumn("late", F.row_number().over(rank) > 2500)
    word = F.when(F.col("late") & (F.col("toxic") == 1), "vileness").when(F.col("toxic") == 1, "nasty").otherwise("kind")
    docs = late.select("doc_id", F.concat(word, F.lit(" words here")).alias("text"), F.lit("en").alias("lang"))
    model = toxicity.train(docs, rows.select("doc_id", "toxic"))
    assert toxicity.bucket(b"vileness") in model.rows
    assert model.score("vileness words here") > 0.5 > model.score("kind words here")
    assert 0 < model.thresholds["en"] < 1


def test_shards_are_averaged(spark, monkeypatch):
    """Sf0.1 dealt into two shards: about as good on held-out documents as in one."""
    monkeypatch.setattr(toxicity, "SHARD", 1700)
    labels, rows = rows_of(spark, "toxic")
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95
