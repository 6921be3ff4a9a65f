"""Merkle manifest of a dataset, its nodes labelled by the interval of leaf ranks they cover.

Leaves stand in order within their group; every ``FAN`` consecutive nodes hash to one
node of the next level until a group has one, its subroot. The subroots, in order of
their group, are the leaves of a second tree of the same form, whose root stands for
the dataset.

A node covers the leaf ranks ``[lo, hi)``. Those of level k start at multiples of
``FAN ** k``, so ``lo div FAN ** k`` is the bucket in which a node meets its ancestor of
level k: a join on group and bucket, where the ancestor's interval must contain the
node's. Going down from the roots, each node takes over its parent's path and adds
its siblings, that is the parent's children outside its own interval. A bucket holds at
most ``FAN`` nodes of the level below, so no group, however large, meets in one task;
and only the lowest nodes, a row per ``FAN`` leaves, carry whole paths.

Null columns hash as ``-``. Rows without a group form one group, which comes first; within
a group rows without an id come first and equal ids stand in order of their leaf, so
repeated rows have equal leaves and any order of them gives the same hashes. An empty
table has no leaves, an empty result and no root. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poicraft.llm.common import stored

#: Children of a node.
FAN = 16
#: ``monotonically_increasing_id`` holds the partition above this many bits.
PART_BITS = 33


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated texts, in binary form."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(value: Column) -> Column:
    """A digest as lowercase hexadecimal text."""
    return F.lower(F.hex(value))


def leaf(*columns: Column) -> Column:
    """Digest of a row: per column ``-`` if null, else its UTF-8 byte count, ``:`` and value."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def group_key(column: Column) -> Column:
    """A key that is never null and sorts by UTF-8 bytes, the null group first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a ``key``) and ``rank``, the place within the key by ``order`` from 0, and
    ``n``, the rows of the key. Range partitions by key and order: a key may span many."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    placed = stored(rows.repartitionByRange(parts, "key", *order).sortWithinPartitions("key", *order).withColumn("place", place), "manifest-rows")
    placed = placed.withColumn("part", F.shiftright("place", PART_BITS))
    # A row per key and partition in which it occurs.
    runs = placed.groupBy("part", "key").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "key", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("off"),
                       F.sum("rows").over(Window.partitionBy("key")).alias("n"))
    return placed.join(runs, ["part", "key"]).withColumn("rank", F.col("place") - F.col("first") + F.col("off")).drop("place", "part", "first", "off")


def _nodes(children: DataFrame, level: int, carry: Sequence[str] = ()) -> DataFrame:
    """Nodes ``key, n, lo, hi, digest, kids`` of a level from the ``key, n, lo, hi, digest`` below."""
    kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", *carry)))
    nodes = children.groupBy("key", F.expr(f"lo div {FAN ** level}").alias("bucket")).agg(F.max("n").alias("n"), kids.alias("kids"))
    joined = F.array_join(F.transform("kids", lambda k: as_text(k["digest"])), "")
    own = F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(digest(joined))  # a lone leaf is its own root
    return nodes.select("key", "n", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), own.alias("digest"), "kids")


@dataclass(frozen=True)
class Tree:
    """Nodes by level from 1 up, for all keys."""

    levels: list[DataFrame]

    def tops(self, k: int) -> DataFrame:
        """Nodes of level k that are their key's only one."""
        return self.levels[k - 1].filter(F.col("n") <= FAN ** k)

    def roots(self) -> DataFrame:
        """``key, digest``: the root of every key."""
        found = self.tops(1).select("key", "digest")
        for k in range(2, len(self.levels) + 1):
            found = found.unionByName(self.tops(k).select("key", "digest"))
        return found


def grow(leaves: DataFrame, carry: Sequence[str] = ()) -> Tree:
    """The trees over ``key, rank, n, digest``; the lowest nodes' children keep the columns ``carry``."""
    below = leaves.select("key", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", *carry)
    levels = [stored(_nodes(below, 1, carry), "manifest-level1")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > FAN ** (k := len(levels)):
        below = levels[-1].filter(F.col("n") > FAN ** k).drop("kids")
        levels.append(stored(_nodes(below, k + 1), f"manifest-level{k + 1}"))
    return Tree(levels)


def _step(kids: Column, lo: Column, hi: Column) -> Column:
    """Siblings of the child ``[lo, hi)``: the children left and right of its interval."""
    side = lambda keep: F.unhex(F.array_join(F.transform(F.filter(kids, keep), lambda k: as_text(k["digest"])), ""))
    return F.struct(side(lambda k: k["hi"] <= lo).alias("left"), side(lambda k: k["lo"] >= hi).alias("right"))


def _path(parent: str, lo: Column, hi: Column) -> Column:
    """Steps from a child of ``parent`` to the root; a lone leaf has no step in its own tree."""
    steps = F.col(f"{parent}.steps")
    return F.when(F.col(f"{parent}.n") > 1, F.concat(F.array(_step(F.col(f"{parent}.kids"), lo, hi)), steps)).otherwise(steps)


def leaf_paths(tree: Tree, above: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``digest, steps`` of every leaf, with the columns ``carry`` and those of ``above``.

    ``above`` has one row per key: the ``steps`` from its root upwards and any other
    columns. A step holds the siblings ``left`` and ``right`` as joined digests; the
    first is that of the leaf.
    """
    extra = [c for c in above.columns if c not in ("key", "steps")]
    kept = ["key", "n", "lo", "hi", "kids"]
    here = None
    for k in range(len(tree.levels), 0, -1):
        found = tree.tops(k).select(*kept).join(above, "key").select(*kept, "steps", *extra)
        if here is not None:
            wide = FAN ** (k + 1)
            c, p = tree.levels[k - 1].filter(F.col("n") > FAN ** k).alias("c"), here.alias("p")
            inside = ((F.col("c.key") == F.col("p.key")) & (F.expr(f"c.lo div {wide}") == F.expr(f"p.lo div {wide}"))
                      & (F.col("p.lo") <= F.col("c.lo")) & (F.col("c.hi") <= F.col("p.hi")))
            found = found.unionByName(c.join(p, inside).select(
                *[f"c.{x}" for x in kept], _path("p", F.col("c.lo"), F.col("c.hi")).alias("steps"), *[f"p.{x}" for x in extra]))
        here = found
    own = here.alias("p").select("p.*", F.explode("p.kids").alias("kid")).alias("p")
    return own.select("p.key", *[f"p.kid.{c}" for c in carry], "p.kid.digest", _path("p", F.col("p.kid.lo"), F.col("p.kid.hi")).alias("steps"), *extra)


def fold(digest_text: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(steps, digest_text, lambda acc, s: F.sha2(F.concat(as_text(s["left"]), acc, as_text(s["right"])), 256))


def proof(steps: Column) -> Column:
    """All siblings from the leaf to the root as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(as_text(s["left"]), as_text(s["right"]))), "")


def manifest(leaves: DataFrame, order: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """``key, digest, steps, subroot, root`` and the columns ``carry`` of every leaf.

    ``leaves`` holds ``key`` (see ``group_key``), ``digest`` and the columns of ``order`` and
    ``carry``; ``steps`` lead from the leaf through its subroot to the root.
    """
    groups = grow(ranked(leaves, [*order, "digest"]), carry)
    subroots = groups.roots().select(F.lit("").alias("key"), "digest", F.col("key").alias("group"))
    top = grow(ranked(subroots, ["group"]), ["group"])
    root = top.roots().select("key", F.col("digest").alias("root"), F.array().cast("array<struct<left:binary,right:binary>>").alias("steps"))
    above = leaf_paths(top, root, ["group"]).select(F.col("group").alias("key"), F.col("digest").alias("subroot"), "root", "steps")
    return leaf_paths(groups, stored(above, "manifest-above"), carry)
