"""Joins whose hot keys are dealt to blocks of bounded size.

A key that many rows share would bring all of them to one task. ``hot_keys`` finds
such keys by exact counts; a row of one goes to one of its blocks, and what meets
these rows is repeated once per block. Keys are only hot beyond ``size`` rows and
beyond 1 / MOST of all rows, so there are fewer than MOST of them, whatever the
input, and their table may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key in one block, about.
BLOCK = 20_000
#: Bound of the number of hot keys.
MOST = 1 << 16


def hot_keys(rows: DataFrame, keys: Sequence[str], size: int | None = None, count: Column | None = None, most: int | None = None) -> DataFrame | None:
    """Keys of more than ``size`` rows, at most ``MOST``: ``keys`` and ``__k``, their number of blocks.

    With ``count``, ``rows`` has one row per key and this number of rows for it;
    ``most`` is the greatest of these numbers, if known: where it is not above
    ``size``, no key is hot, and None says so.
    """
    size = size or BLOCK
    if most is not None and most <= size:
        return None
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")) if count is None else rows.select(*keys, count.alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"))
    hot = counts.join(F.broadcast(total)).filter((F.col("__n") > size) & (F.col("__n") > F.col("__t") / MOST))  # one row
    return hot.select(*keys, F.ceil(F.col("__n") / size).cast("int").alias("__k"))


def dealt(rows: DataFrame, keys: Sequence[str], ids: Sequence[str], hot: DataFrame | None, out: str) -> DataFrame:
    """Adds ``out``, the block of every row by a hash of ``ids`` (0 unless its key is hot)."""
    if hot is None:
        return rows.withColumn(out, F.lit(0))
    block = F.pmod(F.xxhash64(*ids), F.coalesce("__k", F.lit(1))).cast("int")
    return rows.join(F.broadcast(hot), list(keys), "left").withColumn(out, block).drop("__k")


def repeated(rows: DataFrame, keys: Sequence[str], hot: DataFrame | None, out: str) -> DataFrame:
    """Every row once for each block ``out`` of its key."""
    if hot is None:
        return rows.withColumn(out, F.lit(0))
    k = F.coalesce("__k", F.lit(1))
    return rows.join(F.broadcast(hot), list(keys), "left").withColumn(out, F.explode(F.sequence(F.lit(0), k - 1))).drop("__k")


def meet(links: DataFrame, left: DataFrame, right: DataFrame, on_left: Sequence[str], on_right: Sequence[str], size: int | None = None, hot: Sequence[DataFrame | None] | None = None) -> DataFrame:
    """``links`` joined with the members of both its ends, hot ends block by block.

    ``left`` has the columns ``on_left`` and others of its own, ``right``
    ``on_right`` and others; keys must not be null. Every task gets at most about
    ``size`` members of a key from either side. ``hot`` has the hot keys of both
    sides if they are known (None for a side without any).
    """
    pairs = links
    sides = []
    for rows, keys, out, known in ((left, on_left, "__bl", 0), (right, on_right, "__br", 1)):
        own = [c for c in rows.columns if c not in keys]
        table = hot[known] if hot else hot_keys(rows, keys, size)
        pairs = repeated(pairs, keys, table, out)
        sides.append((dealt(rows, keys, own, table, out), [*keys, out]))
    for rows, on in sides:
        pairs = pairs.join(rows, on)
    return pairs.drop("__bl", "__br")
