"""Merkle manifest of a table: a tree of hashes in each group, and one over the groups' roots.

A leaf is the hash of a row's fields.  In each group the leaves ascend by id; every ``fanout``
consecutive nodes become their parent, until one is left, the group's subroot; the subroots, ordered
by group, likewise give the root.  A parent is made by pivoting its children into slot columns with
conditional aggregates: the columns concatenated are what it hashes, and without a child's own column
they are that child's siblings.

Only hashes, ids and kept columns are shuffled, never the fields.  Positions come from ranges of
(group, id) with offsets, so a group that holds most rows is spread like any other.  A level has a
sixteenth of the rows below it; proofs are put together from the top down, by joins of parents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Steps of a proof from a leaf up: the siblings on either side, concatenated.
STEPS = "array<struct<left string, right string>>"
#: Up to so many (group, range) offsets are broadcast (about 60 bytes each); more are joined.
BROADCAST_SPANS = 250_000


def field(c: Column) -> Column:
    """A field as it is hashed: `-` if null, else its UTF-8 byte count, `:` and the value as text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated; null parts add nothing."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def siblings(steps: Column) -> Column:
    """All siblings of a proof, level by level and left to right, concatenated."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add pos (from 0) of each row among those of its ``key`` by ``order`` (nulls first), and n, the key's rows.

    Rows go to ranges of (key, order, number), are sorted there and counted; a small table of offsets by
    key and range makes the counts positions.  The number tells equal rows apart, so they are
    spread too.
    """
    spread = materialize(df.withColumn("number", F.monotonically_increasing_id()))
    spread = spread.repartitionByRange("key", *order, "number").sortWithinPartitions("key", *order, "number")
    spread = materialize(spread.drop("number").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    spans = spread.groupBy("key", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole, earlier = Window.partitionBy("key"), Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("key", "part", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"), F.sum("rows").over(whole).alias("n"))
    spans = materialize(spans)
    few = spans.count() <= BROADCAST_SPANS
    placed = spread.withColumn("part", part).join(F.broadcast(spans) if few else spans, ["key", "part"])
    return placed.withColumn("pos", F.col("at") - F.col("first") + F.col("offset")).drop("part", "at", "first", "offset")


def parents(nodes: DataFrame, fanout: int, carried: Sequence[str] = ()) -> DataFrame:
    """Parents of the nodes (key, pos, n, hash) of keys that have several: key, pos, n, hash and the children's slots."""
    slot, child = F.pmod("pos", F.lit(fanout)), F.struct("hash", *carried)
    slots = [F.max(F.when(slot == i, child)).alias(f"slot{i}") for i in range(fanout)]
    up = nodes.where("n > 1").groupBy("key", F.floor(F.col("pos") / fanout).alias("pos")).agg(F.first("n").alias("below"), *slots)
    count = F.ceil(F.col("below") / fanout).alias("n")
    return up.select("key", "pos", count, digest(*[F.col(f"slot{i}.hash") for i in range(fanout)]).alias("hash"), *[f"slot{i}" for i in range(fanout)])


def tree(nodes: DataFrame, fanout: int, carried: Sequence[str] = ()) -> list[DataFrame]:
    """Levels of the trees of all keys, from the given nodes up to single ones."""
    levels, n = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while n > 1:
        levels.append(materialize(parents(levels[-1], fanout, carried if len(levels) == 1 else ())))
        n = -(-n // fanout)
    return levels


def proofs(levels: list[DataFrame], tops: DataFrame, fanout: int, carried: Sequence[str] = ()) -> DataFrame:
    """(key, pos, hash, carried, steps, and what ``tops`` says of the key) for each node of the lowest level.

    ``tops`` has key, steps (from the tree's top on) and further columns for each key.
    """
    told = [c for c in tops.columns if c not in ("key", "steps")]
    down = None
    for depth in reversed(range(len(levels))):
        carry = list(carried) if depth == 0 else []
        found = levels[depth].where("n = 1").select("key", "pos", "hash", *carry).join(tops, "key").select("key", "pos", "hash", *carry, "steps", *told)
        if down is not None:
            hashes = [F.col(f"slot{i}.hash") for i in range(fanout)]
            step = lambda i: F.struct(F.concat_ws("", *hashes[:i]).alias("left"), F.concat_ws("", *hashes[i + 1 :]).alias("right"))  # noqa: B023, E731
            child = lambda i: F.when(F.col(f"slot{i}").isNotNull(), F.struct(F.lit(i).alias("slot"), step(i).alias("step"), F.col(f"slot{i}").alias("child")))  # noqa: B023, E731
            held = levels[depth + 1].drop("n", "hash").join(down.drop("hash"), ["key", "pos"])
            held = held.select("key", "pos", "steps", *told, F.explode(F.array_compact(F.array(*[child(i) for i in range(fanout)]))).alias("c"))
            steps = F.concat(F.array("c.step"), F.col("steps")).cast(STEPS).alias("steps")
            held = held.select("key", (F.col("pos") * fanout + F.col("c.slot")).alias("pos"), F.col("c.child.hash").alias("hash"), *[F.col("c.child")[c].alias(c) for c in carry], steps, *told)
            found = found.unionByName(held)
        down = found
    return down


def merkle_manifest(df: DataFrame, leaf: Column, group_col: str, id_col: str, keep: dict[str, Column] | None = None, fanout: int = 16) -> DataFrame:
    """One row per row of ``df``: the ``keep`` columns, leaf, group (the group's value as text), subroot, root and steps.

    ``leaf`` is a hash of the row (see ``field`` and ``digest``).  Groups are ordered by their value as
    text, null first, bytewise; rows by id, null first, equal ids by leaf.  Repeated rows are leaves
    each.  Empty and null values are told apart.  A single row is its own subroot, a single group's
    subroot is the root.  An empty table has no leaf and no root: the result is empty.  Other columns
    of ``df``, whatever they are called, aren't read.
    """
    keep, group = keep or {}, F.col(group_col).cast("string")
    key = F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("key")
    kept = F.struct(F.lit(0).alias("_"), *[c.alias(name) for name, c in keep.items()]).alias("kept")
    leaves = numbered(df.select(key, F.col(id_col).alias("id"), leaf.alias("hash"), kept), ["id", "hash"])
    levels = tree(leaves.drop("id"), fanout, ["kept"])
    tops = levels[0].where("n = 1").select("key", "hash")
    for level in levels[1:]:
        tops = tops.union(level.where("n = 1").select("key", "hash"))
    groups = numbered(tops.select(F.lit("").alias("key"), F.col("key").alias("group"), "hash"), ["group"])
    above = tree(groups, fanout, ["group"])
    root = above[-1].where("n = 1").select("key", F.array().cast(STEPS).alias("steps"), F.col("hash").alias("root"))
    subroots = proofs(above, root, fanout, ["group"]).select(F.col("group").alias("key"), F.col("hash").alias("subroot"), "steps", "root")
    found = proofs(levels, materialize(subroots), fanout, ["kept"])
    value = F.when(F.col("key") != "", F.substr("key", F.lit(2))).alias("group")
    return found.select(*[F.col("kept")[name].alias(name) for name in keep], F.col("hash").alias("leaf"), value, "subroot", "root", "steps")
