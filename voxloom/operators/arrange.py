"""Order-dependent operators: seeded splits and samples, numbering, histograms, running values, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.functions.text import strip
from voxloom.plans.stash import stash


def shuffle_key(key: str, seed: int = 42) -> Column:
    """A repeatable shuffle position that any SQL engine computes alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _ordered_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """0-based rank in ``order`` without one task sorting everything.

    Rows are cut into ranges of the order at sampled bounds and sorted within
    them; only the sizes of the ranges, one row per partition, are summed in order.
    """
    at = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, inner = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = at.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = at.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # one row per partition
    return ranked.withColumn(out, F.col("__before") + inner).drop("__part", "__at", "__before")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``pos``, the 0-based place in the seeded shuffle."""
    return _ordered_rank(df, [shuffle_key(key, seed), F.col(key)], "pos")


def split(df: DataFrame, key: str, eval_share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``part``: the first floor(n * (1 - share)) of the shuffle are train, the rest eval."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    cut = F.floor(F.col("__n") * F.lit(1 - eval_share))
    return shuffled(df, key, seed).join(F.broadcast(n)).withColumn("part", F.when(F.col("pos") < cut, "train").otherwise("eval")).drop("__n")  # one row


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, repeatable."""
    return df.orderBy(shuffle_key(key, seed), key).limit(n)


def numbered(df: DataFrame, key: str, pattern: str = "wavs/clip_%06d.wav") -> DataFrame:
    """Adds ``file``: dense names in key order."""
    ranked = _ordered_rank(df, [F.col(key)], "__k")
    return ranked.withColumn("file", F.format_string(pattern, F.col("__k"))).drop("__k")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over the range of the finite values, the last one closed, empty ones included: ``bin``, ``lo``, ``hi``, ``n``."""
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    place = F.when(F.col("b") > F.col("a"), F.least(F.floor(F.try_divide(F.col("v") - F.col("a"), F.col("b") - F.col("a")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = rows.join(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row of ends
    width = (F.col("b") - F.col("a")) / bins
    return (
        df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(ends)).join(counts, "bin", "left")
        .select("bin", F.round(F.col("a") + F.col("bin") * width, 6).alias("lo"), F.round(F.col("a") + (F.col("bin") + 1) * width, 6).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))
    )


def carried_forward(df: DataFrame, value: str, order: list[str], group: list[str], out: str) -> DataFrame:
    """Adds the last non-null ``value`` up to each row, within ``group``."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def moving_average(df: DataFrame, value: str, order: list[str], group: list[str], width: int, out: str) -> DataFrame:
    """Mean of each full window of ``width`` rows; the first rows of a group, which have none, are dropped."""
    w = Window.partitionBy(*group).orderBy(*order)
    r = df.withColumns({out: F.avg(value).over(w.rowsBetween(-(width - 1), 0)), "__r": F.row_number().over(w)})
    return r.filter(F.col("__r") >= width).drop("__r")


def overlay(base: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``base`` with the values of ``new`` where all ``keys`` match: adds ``matched``; a key twice in ``new`` takes its greatest value."""
    one = new.groupBy(*keys).agg(F.max(value).alias("__new"), F.lit(True).alias("__hit"))
    both = base.join(one, keys, "left")
    hit = F.coalesce("__hit", F.lit(False))
    return both.withColumns({value: F.when(hit, F.col("__new")).otherwise(F.col(value)), "matched": hit}).drop("__new", "__hit")


def flagged_union(selected: DataFrame, others: DataFrame, out: str = "selected") -> DataFrame:
    """Both sets with a 1/0 flag."""
    return selected.withColumn(out, F.lit(1)).unionByName(others.withColumn(out, F.lit(0)))


def capped(df: DataFrame, text: str, most: int = 500, out: str = "code") -> DataFrame:
    """Adds ``blank``, ``too_long`` or ``ok`` by the text's length without white space at its ends and with it; null counts as blank."""
    t = F.coalesce(text, F.lit(""))
    return df.withColumn(out, F.when(strip(t) == "", "blank").when(F.length(t) > most, "too_long").otherwise("ok"))


def looked_up(rows: DataFrame, key: str, table: DataFrame, values: list[str], out: str = "error") -> DataFrame:
    """Every row with the ``values`` of its ``key`` in ``table``; a key that is missing there has null values and says so in ``out``. A key listed twice takes the least."""
    one = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*values)).alias("__v"))
    both = rows.join(one, key, "left")
    known = F.col("__v").isNotNull()
    error = F.when(~known, F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return both.withColumns({**{v: F.col("__v")[v] for v in values}, out: error}).drop("__v")


def scale_label(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first step whose bound the value does not exceed, or the last label; null for null."""
    out = F.when(value.isNull(), None)
    for bound, label in steps:
        out = out.when(value <= bound, label)
    return out.otherwise(last)
