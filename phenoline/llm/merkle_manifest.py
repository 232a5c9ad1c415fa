"""Operator 13: a Merkle manifest of a table, built and proved by joins of siblings.

H is the lowercase hex SHA-256 of its inputs put together, digests as hex text. A row's leaf is H of its fields, each ``-`` if null, else
its UTF-8 byte count, ``:`` and the value. Rows of one group are a tree: leaves ascend by key, and while several nodes remain, every
``arity`` consecutive ones (the last run may be shorter, even one) become their H. What remains is the group's subroot. The subroots,
ordered by group (null first, bytewise), are the leaves of one more tree, the crown, whose last node is the root.

Each level is one equijoin of its nodes with themselves, on the computed number of the sibling: the number XOR 1 for two to a run, else
the slots of the run shifted by 1 to arity - 1. The node in slot zero then emits the parent. A level is a written table, an arity-th
of the one below. Paths go the other way: a node's path is its own siblings and its parent's path, so a level's paths are
one join with the level above, and all levels together shuffle about as much as the lowest.

Numbers of leaves come from a range partitioned sort and the counts of its parts, never from a window over a group, so a group
may hold any share of the rows. Equal rows are told apart by a number, so they spread too. The root is the one value on the driver.

Defined results: rows with a null key come first in their group. Repeated keys are ordered by their leaves; equal rows are separate leaves.
Rows without a group form a group. An empty table has no root (None) and no rows. Other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoline.llm.common import numbered, stored


def field(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes``: tree, idx, m, digest and any others. Adds ``left`` and ``right``: the digests of the run's others before and after a node."""
    theirs = nodes.select("tree", F.col("idx").alias("sibling"), F.col("digest").alias("other"))
    if arity == 2:
        met = nodes.withColumn("sibling", F.col("idx").bitwiseXOR(F.lit(1).cast("long"))).join(theirs, ["tree", "sibling"], "left")
        other, before = F.coalesce("other", F.lit("")), F.col("sibling") < F.col("idx")
        sides = F.when(before, other).otherwise("").alias("left"), F.when(before, "").otherwise(other).alias("right")
        return met.select(*nodes.columns, *sides)
    slot = F.col("idx") % arity
    shifted = F.array(*[F.col("idx") - slot + (slot + i) % arity for i in range(1, arity)])
    met = nodes.select("tree", "idx", F.explode(shifted).alias("sibling")).join(theirs, ["tree", "sibling"])
    run = met.groupBy("tree", "idx").agg(F.array_sort(F.collect_list(F.struct("sibling", "other"))).alias("run"))

    def side(keep) -> Column:
        return F.coalesce(F.array_join(F.transform(F.filter("run", keep), lambda x: x["other"]), ""), F.lit(""))

    left, right = side(lambda x: x["sibling"] < F.col("idx")), side(lambda x: x["sibling"] > F.col("idx"))
    return nodes.join(run, ["tree", "idx"], "left").select(*nodes.columns, left.alias("left"), right.alias("right"))


def climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The levels of all trees, each a written table (tree, idx, m, digest, left, right). ``m``: nodes of the tree on that level."""
    levels = [stored(with_siblings(nodes, arity), "level")]
    most = levels[0].agg(F.max("m")).first()[0] or 0
    while most > 1:
        open_ = levels[-1].filter((F.col("m") > 1) & (F.col("idx") % arity == 0))
        parents = open_.select(
            "tree",
            F.expr(f"idx div {arity}").alias("idx"),
            F.expr(f"(m + {arity - 1}) div {arity}").alias("m"),
            F.sha2(F.concat("digest", "right"), 256).alias("digest"),
        )
        levels.append(stored(with_siblings(parents, arity), "level"))
        most = -(-most // arity)
    return levels


def paths(levels: list[DataFrame], arity: int, crown: DataFrame | None = None) -> DataFrame:
    """The lowest level with ``path``: the siblings to the left and right on every level up to the tree's last node.

    With ``crown`` (tree, above) the path goes on from there.
    """
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    higher = None
    for i, level in reversed(list(enumerate(levels))):
        kept = level.columns if i == 0 else ["tree", "idx"]
        last = level.filter("m = 1")
        last = last.withColumn("above", nothing) if crown is None else last.join(crown, "tree")
        found = last.select(*kept, F.col("above").alias("path"))
        if higher is not None:
            up = higher.select("tree", F.col("idx").alias("parent"), F.col("path").alias("above"))
            inner = level.filter("m > 1").withColumn("parent", F.expr(f"idx div {arity}")).join(up, ["tree", "parent"])
            found = found.union(inner.select(*kept, F.concat(F.array(F.struct("left", "right")), "above").alias("path")))
        higher = stored(found, "paths") if i else found
    return higher


def proof(path: Column | str) -> Column:
    """H of all siblings of a path, from the lowest level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(start: Column | str, path: Column | str) -> Column:
    """The root that a leaf and the siblings of its path give."""
    begin = F.col(start) if isinstance(start, str) else start
    return F.aggregate(path, begin, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


@dataclass(frozen=True)
class Manifest:
    """``levels``: the nodes of all trees, from the leaves up; the leaves also have the columns kept, as the struct ``kept``.

    ``crown``: a row a tree: ``group``, its ``subroot``, and ``above``, the siblings between that and the root.
    """

    levels: list[DataFrame]
    crown: DataFrame
    root: str | None
    arity: int

    def proofs(self) -> DataFrame:
        """A row for each leaf: the columns kept, group, leaf, subroot, root, path."""
        ways = paths(self.levels, self.arity, self.crown.select("tree", "above"))
        named = ways.join(self.crown.select("tree", "group", "subroot"), "tree")
        return named.select("kept.*", "group", F.col("digest").alias("leaf"), "subroot", F.lit(self.root).cast("string").alias("root"), "path")


def build(rows: DataFrame, key: str, group: str, digest: str, kept: tuple[str, ...] = (), arity: int = 2) -> Manifest:
    """The manifest of ``rows`` whose column ``digest`` holds their leaves. ``kept`` columns come back with the proofs."""
    if arity < 2:
        raise ValueError("arity must be at least 2")
    marked = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(key).alias("key"),
        F.col(digest).alias("digest"),
        F.struct(F.lit(0).alias("_"), *kept).alias("kept"),
    )
    # Equal rows get different numbers, written down before the sort is sampled.
    marked = stored(marked.withColumn("row", F.monotonically_increasing_id()), "leaves")
    levels = climb(numbered(marked, ["key", "digest", "row"]).select("tree", "idx", "m", "digest", "kept"), arity)
    tips = None
    for level in levels:
        tip = level.filter("m = 1").select(F.col("tree").alias("name"), F.col("digest"))
        tips = tip if tips is None else tips.union(tip)
    trees = numbered(tips.withColumn("tree", F.lit("")), ["name"])
    top = climb(trees.select("tree", "idx", "m", "digest", F.struct("name").alias("kept")), arity)
    root = top[-1].select("digest").first()
    ways = paths(top, arity)
    label = F.when(F.col("kept.name") != "", F.substring("kept.name", 2, 2**31 - 1))
    crown = ways.select(F.col("kept.name").alias("tree"), label.alias("group"), F.col("digest").alias("subroot"), F.col("path").alias("above"))
    return Manifest(levels, stored(crown, "crown"), root["digest"] if root else None, arity)
