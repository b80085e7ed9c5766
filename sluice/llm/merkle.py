"""Merkle manifest of a dataset: a tree of digests for every source, and one over the sources.

A level of all trees is one table of nodes (tree, idx). Siblings are found by sibling-shift self-joins: each node is
equijoined with the nodes at its sibling indices, idx XOR 1 in a binary tree, the next slots of its run of ``arity`` nodes
otherwise. Then the nodes in slot zero, which have the whole run beside them, emit the parents: the next table, ``arity``
times smaller. Proofs are put together downwards, a node's own siblings before those of its parent, so that each is built
once and the leaves need a single join. Every key is (tree, idx), so a source that holds a third of all rows is spread.

DataFrame functions only; the driver learns the height of the highest tree and the root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.scale import running_totals
from sluice.session import discard, scratch

_NO_SIDES = "array<struct<left:string,right:string>>"


def field_text(c: Column) -> Column:
    """A value as it goes into a leaf: ``-`` for null, else its length in UTF-8 bytes, ``:`` and the value."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other; digests among them count as their hex text."""
    return F.sha2(F.concat(*parts), 256)


class _Tables:
    """Written tables of a tree, and their removal once nothing reads them any more."""

    def __init__(self) -> None:
        self.held: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        spark, path = df.sparkSession, scratch(df.sparkSession, label)
        df.write.parquet(path)
        table = spark.read.schema(df.schema).parquet(path)
        self.held.append((table, path))
        return table

    def drop(self, *gone: DataFrame | None) -> None:
        for table, path in self.held:
            if any(table is g for g in gone):
                discard(table.sparkSession, path)
        self.held = [(t, p) for t, p in self.held if not any(t is g for g in gone)]

    def drop_all(self) -> None:
        self.drop(*[t for t, _ in self.held])


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes of one level with ``left`` and ``right``, the digests of their siblings before and after them."""
    slot = F.col("idx") % arity
    out, sides = nodes, {"left": [], "right": []}
    for shift in range(1, arity):
        sibling = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("idx") - slot + (slot + shift) % arity
        other = nodes.select(F.col("tree").alias(f"t{shift}"), F.col("idx").alias(f"i{shift}"), F.col("digest").alias(f"d{shift}"))
        out = out.join(other, (F.col("tree") == F.col(f"t{shift}")) & (sibling == F.col(f"i{shift}")), "left")
        # a shift past the run's end comes round to its beginning
        sides["left"].append(F.when(slot + shift >= arity, F.col(f"d{shift}")))
        sides["right"].append(F.when(slot + shift < arity, F.col(f"d{shift}")))
    return out.select(*nodes.columns, *[F.concat_ws("", *c).alias(side) for side, c in sides.items()])


def _build(tables: _Tables, leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels from the leaves up, as far as a tree has several nodes, and the root (tree, subroot) of every tree.

    ``leaves``: tree, idx from 0, n (nodes of the tree on this level), digest, and columns that level 0 keeps.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, current = [], leaves
    roots = leaves.filter("n = 1").select("tree", F.col("digest").alias("subroot"))
    parents = ["tree", F.floor(F.col("idx") / arity).cast("long").alias("idx"), F.ceil(F.col("n") / arity).cast("long").alias("n"),
               digest(F.col("digest"), F.col("right")).alias("digest")]
    while most > 1:
        levels.append(tables.write(_with_siblings(current.filter("n > 1"), arity), "merkle-level"))
        current = levels[-1].filter(F.col("idx") % arity == 0).select(*parents)
        roots = roots.unionByName(current.filter("n = 1").select("tree", F.col("digest").alias("subroot")))
        most = -(-most // arity)
    return levels, roots


def _proofs(tables: _Tables, leaves: DataFrame, levels: list[DataFrame], top: DataFrame, arity: int) -> DataFrame:
    """The leaves with ``subroot`` and ``sides``, their siblings level by level; those above a tree come from ``top``
    (tree, subroot, sides). A level's table goes once the level below has its proofs."""
    above = None
    own = F.array(F.struct("left", "right"))
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        last = level.filter(F.col("n") <= arity).join(top.select(F.col("tree").alias("t"), "subroot", F.col("sides").alias("up")), F.col("tree") == F.col("t"))
        met = last.select(*level.columns, "subroot", "up")
        if above is not None:
            named = above.select(F.col("tree").alias("t"), F.col("idx").alias("i"), "subroot", F.col("sides").alias("up"))
            parent = F.floor(F.col("idx") / arity).cast("long")
            higher = level.filter(F.col("n") > arity).join(named, (F.col("tree") == F.col("t")) & (parent == F.col("i")))
            met = met.unionByName(higher.select(*level.columns, "subroot", "up"))
        here = met.select(*[c for c in level.columns if c not in ("left", "right")], "subroot", F.concat(own, "up").alias("sides"))
        if k:
            here = tables.write(here.select("tree", "idx", "subroot", "sides"), "merkle-proofs")
            tables.drop(level, above)
        above = here
    alone = leaves.filter("n = 1").join(top.select(F.col("tree").alias("t"), "subroot", "sides"), F.col("tree") == F.col("t")).drop("t")
    return alone if above is None else above.unionByName(alone)


def _placed(tables: _Tables, rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add tree (rank of the group from 0, null first), idx (place in it from 0) and n, without a window over a group."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = tables.write(rows.repartitionByRange(ranges, group, *order).withColumn("range", F.spark_partition_id()), "merkle-ranges")
    counts = tables.write(ranged.groupBy(group, "range").agg(F.count("*").alias("here")), "merkle-counts")
    sizes = counts.groupBy(group).agg(F.sum("here").alias("n"))
    ranked = running_totals(sizes, [], [group], {"rank": F.lit(1)})
    named = ranked.select(F.col(group).alias("g"), "n", (F.col("rank") - 1).alias("tree"))
    earlier = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    base = tables.write(
        based.join(named, F.col(group).eqNullSafe(F.col("g"))).select(F.col(group).alias("g"), F.col("range").alias("r"), "before", "n", "tree"),
        "merkle-bases",
    )
    inside = Window.partitionBy(group, "range").orderBy(*order)
    met = ranged.join(base, F.col(group).eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    placed = met.withColumn("idx", F.row_number().over(inside) - 1 + F.col("before")).drop("g", "r", "range", "before")
    leaves = tables.write(placed, "merkle-leaves")
    tables.drop(ranged, counts, base)
    return leaves


def manifest(docs: DataFrame, leaf: Column, claimed: Column | None = None, arity: int = 3, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, subroot, root, sides, claimed, folded_root, verified.

    ``leaf`` is the digest of a row as the manifest holds it, ``claimed`` the digest of what is to be verified (``leaf``
    if not given). Leaves of a source ascend by id, null first, those of one id by digest. While a tree has several nodes,
    each run of ``arity`` neighbours (the last may be shorter) becomes the digest of their digests. The roots of the
    sources, null first and then by the bytes of their names, are the leaves of the last tree. ``sides`` has, from the
    leaf up to the root, the digests left and right of it in its run; ``folded_root`` is ``claimed`` folded with them,
    ``verified`` whether that is ``root``. Repeated rows are leaves of their own; an empty table gives an empty table.
    """
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    tables = _Tables()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), leaf.alias("digest"),
                       (leaf if claimed is None else claimed).alias("claimed"))
    digests = tables.write(rows, "merkle-digests")  # range bounds are sampled, and texts are digested once
    leaves = _placed(tables, digests, "source", ["doc_id", "digest", "claimed"])
    tables.drop(digests)
    levels, roots = _build(tables, leaves, arity)
    subroots = tables.write(roots, "merkle-subroots")
    sources = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(subroots.count()).alias("n"),
                              F.col("subroot").alias("digest"))
    over = _Tables()
    upper, found = _build(over, sources, arity)
    one = found.first()
    root = one["subroot"] if one else ""
    start = docs.sparkSession.range(1).select(F.col("id").alias("tree"), F.lit(root).alias("subroot"), F.array().cast(_NO_SIDES).alias("sides"))
    named = _proofs(over, sources, upper, start, arity)
    top = tables.write(named.select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), "sides"), "merkle-sources")
    over.drop_all()
    folded = F.aggregate("sides", F.col("claimed"), lambda at, side: digest(side["left"], at, side["right"]))
    told = _proofs(tables, leaves, levels, top, arity).select(
        "doc_id", "source", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "sides", "claimed", folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_text(sides: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(sides, lambda s: F.concat(s["left"], s["right"])), "")
