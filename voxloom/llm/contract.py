"""Connected components by random-mate contraction.

Every round each vertex flops a coin (a hash of vertex and round). A vertex that
shows tails and has a neighbour showing heads is collapsed into the smallest such
neighbour; the edges are rewritten to the survivors, and edges that became loops
or duplicates vanish. A quarter of the vertices that still have edges goes in
each round on average, so the number of rounds is logarithmic, whatever the
diameter. The collapses form a forest; following its pointers by doubling unwinds
the labels. Only the number of remaining edges reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.plans.blocks import dealt, hot_keys, repeated
from voxloom.plans.stash import drop_stash, stash, stash_measured


def _heads(v: str, round_no: int):
    return F.xxhash64(F.col(v), F.lit(round_no)).bitwiseAND(F.lit(1)) == 1


def _clean(edges: DataFrame) -> DataFrame:
    return (
        edges.filter(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _counted(edges: DataFrame) -> tuple[DataFrame, int]:
    out, seen = stash_measured(edges, keep=False, n=F.count(F.lit(1)))
    return out, seen["n"]


def _hooks(left: DataFrame, round_no: int) -> DataFrame:
    """Which vertices are collapsed in a round, and into what: ``v``, ``to``."""
    both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.filter(~_heads("a", round_no) & _heads("b", round_no)).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("to"))


def _rewritten(left: DataFrame, hooks: DataFrame, end: str, n: int) -> DataFrame:
    """The ``n`` edges, whose ``end`` is the survivor of a collapse; edges of a hot vertex are dealt to blocks."""
    to = hooks.select(F.col("v").alias(end), F.col("to").alias("__to"))
    hot = hot_keys(left, [end], most=n)
    both = dealt(left, [end], ["b" if end == "a" else "a"], hot, "__block").join(repeated(to, [end], hot, "__block"), [end, "__block"], "left")
    return both.withColumn(end, F.coalesce("__to", end)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Labels the vertices of ``edges`` (``a`` LONG, ``b`` LONG): columns ``v``, ``root``.

    ``root`` is one vertex of the component, the same for all of them; which one
    is repeatable but otherwise arbitrary. Edges with a null end are ignored,
    loops too; a vertex without any other edge, and the chosen root itself, may be
    missing from the result, so callers use ``coalesce(root, v)``. A round is two
    jobs, the second of which counts; it is repeated until no edge is left.
    """
    left, n = _counted(_clean(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())))
    forest: list[DataFrame] = []
    while n:
        hooks = stash(_hooks(left, len(forest)), keep=False)
        moved = _rewritten(_rewritten(left, hooks, "a", n), hooks, "b", n)
        forest.append(hooks)
        old = left
        left, n = _counted(_clean(moved))
        drop_stash(old)
    if not forest:
        return edges.select(F.col("a").cast("long").alias("v"), F.col("b").cast("long").alias("root")).limit(0)
    out = follow(reduce(DataFrame.unionByName, forest).select("v", F.col("to").alias("root")), depth=len(forest))
    drop_stash(left, *forest)
    return out


def follow(pointers: DataFrame, depth: int | None = None) -> DataFrame:
    """Follows ``v`` -> ``root`` pointers (a forest, one row per ``v``) to the last vertex by doubling.

    ``depth`` bounds the longest chain if it is known; otherwise the doubling ends
    when no pointer moves any more. Many pointers to one vertex are dealt to blocks.
    """
    cur, seen = stash_measured(pointers, n=F.count(F.lit(1)))
    n, span = seen["n"], 1
    while n and (depth is None or span < depth):
        to = cur.select(F.col("v").alias("root"), F.col("root").alias("next"))
        hot = hot_keys(cur, ["root"], most=n)
        both = dealt(cur, ["root"], ["v"], hot, "__block").join(repeated(to, ["root"], hot, "__block"), ["root", "__block"], "left")
        step = both.select("v", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step, seen = stash_measured(step, moved=F.count_if("moved"))
        cur = step.select("v", "root")
        span *= 2
        if not seen["moved"]:
            break
    return cur
