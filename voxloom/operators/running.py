"""Ranks and running totals that no single task has to hold.

A window without a partition key, or with one hot key, sends every row to one
task. Here rows get a pseudo-random but repeatable position (a 64-bit hash of
their key), the position range is cut into buckets, and only the small table of
bucket totals is summed in order; inside a bucket a plain window finishes the
job. A hot group is therefore spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of the position range. Bucket totals are (groups x buckets) rows at most.
BUCKETS = 1024


def position(*cols: Column, seed: int = 0) -> Column:
    """A repeatable non-negative 64-bit position of a row."""
    return F.xxhash64(*cols, F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1))


def hashed_running(
    df: DataFrame, groups: Sequence[str], ids: Sequence[str], value: Column | None = None, seed: int = 0, buckets: int = BUCKETS
) -> DataFrame:
    """Adds ``run_rank`` (0-based) and, with ``value``, ``run_before`` (sum of the earlier values) within ``groups``.

    The order is that of a hash of ``ids`` and then ``ids`` themselves; ``ids``
    must be unique within a group. ``value`` must not be null. An empty table
    gives an empty table. Column names starting with ``__run`` are reserved.
    """
    width = (1 << 63) // buckets
    g = list(groups)
    at = df.withColumn("__run_p", position(*[F.col(c) for c in ids], seed=seed))
    at = at.withColumn("__run_b", (F.col("__run_p") / F.lit(width)).cast("int"))
    at = at.withColumn("__run_v", F.lit(0).cast("long") if value is None else value)
    totals = at.groupBy(*g, "__run_b").agg(F.sum("__run_v").alias("__run_s"), F.count(F.lit(1)).alias("__run_n"))
    before = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    before = before.orderBy("__run_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *g,
        "__run_b",
        F.coalesce(F.sum("__run_s").over(before), F.lit(0)).alias("__run_os"),
        F.coalesce(F.sum("__run_n").over(before), F.lit(0)).alias("__run_on"),
    )
    cell = Window.partitionBy(*g, "__run_b").orderBy("__run_p", *ids)
    inner = at.withColumn("__run_rn", F.row_number().over(cell) - 1)
    inner = inner.withColumn("__run_cs", F.sum("__run_v").over(cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__run_v"))
    # group columns hold no nulls here: callers coalesce first
    out = inner.join(offsets, [*g, "__run_b"])
    out = out.withColumn("run_rank", F.col("__run_on") + F.col("__run_rn"))
    if value is not None:
        out = out.withColumn("run_before", F.col("__run_os") + F.col("__run_cs"))
    return out.drop("__run_p", "__run_b", "__run_v", "__run_os", "__run_on", "__run_rn", "__run_cs")
