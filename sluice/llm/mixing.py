"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Sources, in code point order with null last, weigh ``weights`` in turn and share ``share`` of all words; a target stops
at ``cap`` times its source's size and the excess goes to the others by weight. A source's documents are then taken
whole as often as the target holds them, and once more below a threshold of a hash of their id: sizes are summed by
(source, hash bucket), the bucket that crosses the budget is found, and only that bucket is summed again by the next
bits, until it is one hash value. No rows are sorted, and a larger budget always takes a superset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.scale import materialise, running_totals
from sluice.llm.names import unused

#: the hash has 60 bits, read 12 at a time: a histogram has 4,096 buckets a source at most.
HASH_BITS, STEP_BITS = 60, 12
WORDS = r"[^ \t\n\x0B\f\r]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text (a null id: of the empty text). Repeated ids share one value."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source: source_size and target, from rows (source, size). One row a source; nothing is collected."""
    order = F.col("source").isNull().cast("int")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("no_name", order)
    ranked = running_totals(sources, [], ["no_name", "source"], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighed = materialise(ranked.withColumn("weight", weight.cast("double")), "mix-sources")
    limit = F.col("source_size") * F.lit(float(cap))
    # The level at which the caps and the weighted rest meet the budget: each round fixes those above it.
    free, level = F.lit(True), None
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    fixed_count = -1
    while True:
        got = weighed.agg(
            F.coalesce(F.sum(F.when(~free, limit)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0.0)).alias("rest"),
            F.count_if(~free).alias("n"),
        ).first()
        if got["n"] == fixed_count or got["rest"] == 0:
            break
        fixed_count, level = got["n"], (share * total - got["fixed"]) / got["rest"]
        free = F.col("weight") * F.lit(level) < limit
    target = F.least(limit, F.col("weight") * F.lit(level)) if level is not None else limit
    return weighed.select("source", "source_size", target.alias("target"))


def _boundary(keys: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the hash unit that crosses ``extra``: (source, low, before, unit). Refined 12 bits at a time."""
    # low: smallest hash of the bucket being refined; before: words below it
    state = plan.filter("extra > 0").select("source", "extra", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"))
    for bits in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        wide = 1 << (bits + STEP_BITS)
        rows = keys.join(state.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")))
        rows = rows.filter((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + wide))
        bucket = F.shiftright("h", bits)
        sums = rows.groupBy("source", "extra", "before", bucket.alias("bucket")).agg(F.sum("size").alias("unit"))
        upto = F.col("before") + F.sum("unit").over(Window.partitionBy("source").orderBy("bucket"))
        crossing = sums.withColumn("upto", upto).filter("upto > extra").groupBy("source", "extra").agg(
            F.min_by(F.struct("bucket", "upto", "unit"), "bucket").alias("b")
        )
        state = materialise(
            crossing.select(
                "source", "extra", F.shiftleft("b.bucket", bits).alias("low"),
                (F.col("b.upto") - F.col("b.unit")).alias("before"), F.col("b.unit").alias("unit"),
            ),
            "mix-boundary",
        )
        state, last = state.drop("unit"), state
    return last.select("source", "low", "before", "unit")


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """All rows of ``docs`` with mix_size, mix_source_size, mix_target and mix_taken (words taken, repeats counted).

    mix_taken / mix_size is how often the row is taken: 0, 1 or 2 with the default cap. Null texts and texts of white
    space only have size 0 and are taken 0 times; rows of a null source are a source of their own, the last; repeated
    ids share a hash and are taken alike; an empty table gives an empty table. Sizes of 0 everywhere give targets of 0.
    Other columns pass through, whatever their names, except that the four new names replace columns of that name.
    """
    keys = materialise(
        docs.select(F.col(source).alias("source"), id_hash(F.col(doc_id)).alias("h"), word_count(F.col(text)).alias("size")),
        "mix-keys",
    )
    targets = source_targets(keys, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = materialise(
        targets.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan"
    )
    edge = _boundary(keys, plan)
    of, size_of, target_of, whole_of, below, h = unused([*docs.columns, "mix_size"], "of", "size_of", "target_of", "whole_of", "below", "h")
    # the unit on the boundary is taken if that comes nearer to the budget
    nearer = (F.col("before") + F.col("unit") - F.col("extra")) < (F.col("extra") - F.col("before"))
    joined = plan.alias("p").join(edge.withColumnRenamed("source", "s"), F.col("s").eqNullSafe(F.col("source")), "left")
    thresholds = materialise(
        joined.select(
            F.col("source").alias(of), F.col("source_size").alias(size_of), F.col("target").alias(target_of),
            F.col("whole").alias(whole_of), F.coalesce(F.col("low") + nearer.cast("long"), F.lit(0)).cast("long").alias(below),
        ),
        "mix-thresholds",
    )
    sized = docs.withColumn("mix_size", word_count(F.col(text))).withColumn(h, id_hash(F.col(doc_id)))
    out = sized.join(thresholds, F.col(of).eqNullSafe(sized[source]))
    times = F.col(whole_of) + (F.col(h) < F.col(below)).cast("long")
    names = [c for c in docs.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_taken")]
    return out.select(
        *[sized[f"`{c}`"] for c in names], "mix_size", F.col(size_of).alias("mix_source_size"),
        F.col(target_of).alias("mix_target"), (F.col("mix_size") * times).alias("mix_taken"),
    )
