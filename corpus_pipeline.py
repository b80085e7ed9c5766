"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir), is written as Parquet and read again by the next.

quality     documents that the quality classifier scores under 0.7 go
similar     of documents that chains of SimHash fingerprints (four-word shingles, at most four bits apart) connect, the one
            with the smallest id stays
repeats     every byte of a 50-byte string that a smaller document has too goes, and documents of which nothing is left
mixing      documents are taken as often as their source's target asks: not at all, once or twice, as repeated rows
tokens      the texts are encoded; the last stage returns ids and their digest instead of texts

A null text is empty, has no words and no tokens. Rows of null id pass the second stage only if nothing with an id is like
them. Rows of one id and one text are one document, of which one row stays after the second stage; rows of one id and
unlike texts all stay. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm import bpe, mixing, quality, simhash, suffix_levels
from sluice.session import discard, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter(F.col(quality.SCORE) >= 0.7).select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # ids first, so that the least row of a group is the one with the smallest id; the text tells rows of one id apart
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("told_by"))
    keyed = docs.select(*COLUMNS).withColumn("row_key", key)
    found = simhash.near_duplicates(keyed.select("row_key", "text"), words=4, budget=4, doc_id="row_key")
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("first_key")).distinct()
    kept = keyed.join(first, F.col("row_key") == F.col("first_key"), "left_semi")
    order = Window.partitionBy("row_key").orderBy("source", "lang", "n_chars")
    return kept.withColumn("r", F.row_number().over(order)).filter("r = 1").select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = suffix_levels.remove_repeats(docs)
    untouched = F.size("repeat_begins") == 0
    text = F.when(untouched, F.col("text")).otherwise(suffix_levels.kept_text("text", "repeat_begins", "repeat_ends"))
    told = kept.withColumn("text", text).filter(untouched | (F.octet_length("text") > 0))
    return told.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs).filter("mix_taken > 0")
    times = F.sequence(F.lit(1), (F.col("mix_taken") / F.col("mix_size")).cast("int"))
    return mixed.withColumn("__copy", F.explode(times)).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs).select("doc_id", "lang", "source", F.size(bpe.IDS).cast("long").alias("n_tokens"), bpe.IDS)
    return bpe.decode(coded).withColumn("text_sha256", F.sha2("bpe_text", 256)).drop("bpe_text")


STAGES = [
    ("quality", keep_quality),
    ("similar", keep_one_of_similar),
    ("repeats", remove_repeats),
    ("mixing", mix_sources),
    ("tokens", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. The table of a stage goes as soon as the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        following = stage(spark, docs, sf_dir)
        following.write.parquet(path)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.schema(following.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the fingerprints and the vocabulary cannot be said in SQL; tests hold stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
