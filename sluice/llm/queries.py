"""Registered queries of the subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import (
    bpe, line_dedup, merkle, mixing, nn_descent, periodic, quality, relative_lz, simhash, spherical, suffix_levels, token_counts, toxicity,
)
from sluice.llm.labelled import id_remainder
from sluice.llm.oracles import LINES_SQL, MERKLE_SQL


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.col(bpe.IDS).cast("array<string>"), ",")
    coded = bpe.encode(_documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", bpe.IDS, F.size(bpe.IDS).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256")
    )
    return bpe.decode(coded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bpe_text", 256).alias("decoded_sha256"))


def op2_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_levels.remove_repeats(_documents(spark, sf_dir, "doc_id", "text"))
    length = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return found.select(
        "doc_id", length.alias("n_bytes"), (length - F.octet_length("repeat_kept")).alias("n_removed"),
        F.size("repeat_begins").cast("long").alias("n_spans"), F.sha2("repeat_kept", 256).alias("kept_sha256"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col(toxicity.SCORE).alias("score"),
        (F.col(toxicity.SCORE) >= 0.5).cast("int").alias("predicted"),
        (F.col(toxicity.SCORE) >= toxicity.threshold(model, F.col("lang"))).alias("over_language_threshold"),
    )


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nn_descent.nearest(vectors, F.col("vec_id") % 50 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir, "doc_id", "text", "source")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"))
    print_ = F.lower(F.lpad(F.hex(F.element_at("simhash", 1)), 16, "0"))
    return found.select("doc_id", print_.alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_documents(spark, sf_dir, "doc_id", "text"))
    return counted.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.col(token_counts.COUNT).alias("n_tokens"), (F.col(token_counts.COUNT) > 512).alias("over_limit"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    scored = quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(
        "doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col(quality.SCORE).alias("score"),
        (F.col(quality.SCORE) >= 0.7).cast("int").alias("predicted"),
    )


def op9_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relative_lz.remove_repeats(_documents(spark, sf_dir, "doc_id", "text"))
    removed = F.aggregate(F.zip_with("repeat_begins", "repeat_ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id", F.col("repeat_words").alias("n_words"), removed.alias("n_removed"), F.sha2("repeat_kept", 256).alias("kept_sha256")
    )


def op10_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars", "text")

    def leaf(text):
        return merkle.digest(*[merkle.field_text(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], merkle.field_text(text))

    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    given = F.when(tampered, leaf(F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf(F.col("text")))
    found = merkle.manifest(docs, leaf(F.col("text")), given)
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("sides")), 256).alias("proof_sha256"), "folded_root", "verified"
    )


def periodic_digests(docs: DataFrame) -> DataFrame:
    """Runs of rows (doc_id, text), of which one in ten gets a period, as the contract of op12 digests them."""
    text = periodic.with_planted_run(F.col("doc_id"), F.col("text")).alias("text")
    found = periodic.find_runs(docs.select("doc_id", text))
    runs = F.col(periodic.RUNS)
    told = found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), periodic.strongest_run(runs).alias("best"),
        F.sha2(periodic.runs_text(runs), 256).alias("runs_sha256"), F.sha2(periodic.COLLAPSED, 256).alias("collapsed_sha256"),
    )
    exponent = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long")
    return told.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_digests(_documents(spark, sf_dir, "doc_id", "text"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.find_duplicate_lines(_documents(spark, sf_dir, "doc_id", "text"))
    keep = F.col(line_dedup.KEEP)
    return found.select(
        "doc_id", F.col(line_dedup.COUNT).alias("n_lines"), line_dedup.dropped_count(keep).alias("n_dropped"),
        F.sha2(line_dedup.kept_text(F.col("text"), keep), 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_suffix_levels": op2_suffix_levels,
    "op3_toxicity": op3_toxicity,
    "op4_nn_descent": op4_nn_descent,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_relative_lz": op9_relative_lz,
    "op10_spherical_caps": op10_spherical_caps,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_line_dedup": op13_line_dedup,
}

MIXING_SQL = r"""
WITH keys AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM keys GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size / weight, source
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, source_size / weight) FROM levels WHERE weight * level <= cap)) AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
running AS (
  SELECT k.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
         sum(size) OVER (PARTITION BY k.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY k.source, h) AS unit
  FROM keys k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source),
edge AS (
  SELECT *, min(CASE WHEN upto > extra THEN h END) OVER (PARTITION BY source) AS edge FROM running)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN extra > 0 AND (h < edge OR (h = edge AND upto - extra < extra - (upto - unit))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM edge
"""

ORACLES: dict[str, str] = {"op5_mixing": MIXING_SQL, "op11_merkle_manifest": MERKLE_SQL, "op13_line_dedup": LINES_SQL}
