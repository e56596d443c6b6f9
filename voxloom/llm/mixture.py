"""Mixing sources to target weights (problem 7).

The mixture is a row of slots of equal size in tokens. Slot i takes the source in
whose interval of the cumulative weights the i-th golden-ratio point falls, so
every stretch of the mixture has the target shares nearly. The slots of a source
are ranked; the source's documents, shuffled anew for each repetition and laid end
to end, are cut into blocks of the slot size; the k-th slot takes the k-th block.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.llm.tokens import token_sizes
from voxloom.operators.running import hashed_running
from voxloom.plans.stash import stash

#: Default of ``slot_tokens``, and of ``least_slots``: the slots that the scarcest source gets at least, for which slots may be smaller.
SLOT_TOKENS, LEAST_SLOTS = 4096, 2000
#: Points are whole numbers modulo 2^40, multiples of the golden ratio's: exact for every slot number.
_MODULUS = 1 << 40
_GOLDEN = round((math.sqrt(5) - 1) / 2 * _MODULUS) | 1
_HALF = 1 << 20
_CHUNK = 1 << 16


def _point(i):
    """The i-th point, of a column or an array of slot numbers; every product fits 64 bits."""
    i = i % _MODULUS
    low, high = i % _HALF, i // _HALF if isinstance(i, np.ndarray) else F.shiftright(i, 20)
    return (low * _GOLDEN + high * (_GOLDEN % _HALF) % _HALF * _HALF + _GOLDEN // 2) % _MODULUS


class Mixture:
    """A mixture of ``documents`` (``doc_id``, ``source``, ``text``) by ``weights`` (``source``, ``target_share``, ``max_repeat``).

    ``weights`` is a small table; rows with a null source or without a positive
    share are skipped, shares of a source listed twice add up, a null or smaller
    ``max_repeat`` counts as 1. Listed sources without documents get nothing, and
    the others keep their proportions; documents of other sources, and null ones,
    aren't used. The mixture is as large as it can be without repeating any
    document of a source more than ``max_repeat`` times. Slots have ``slot_tokens``
    tokens, or fewer where the scarcest source would have fewer than
    ``least_slots`` of them (1: never); the report says how many.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame, weights: DataFrame, tokenizer: str | None = None, slot_tokens: int = SLOT_TOKENS, seed: int = 42, least_slots: int = LEAST_SLOTS):
        self.spark, self.weights, self.seed = spark, weights, seed
        self.sized = stash(token_sizes(documents, tokenizer).filter("source IS NOT NULL"))
        listed: dict[str, tuple[float, int]] = {}
        for s, share, cap in weights.select("source", "target_share", "max_repeat").collect():
            if s is not None and share is not None and share > 0:
                old = listed.get(s, (0.0, 1))
                listed[s] = (old[0] + float(share), max(old[1], cap or 1))
        totals = self.sized.filter(F.col("source").isin(list(listed))).groupBy("source").agg(F.sum("tokens").alias("t"))
        self.have = {r["source"]: r["t"] for r in totals.collect()}  # at most one row per listed source
        names = sorted(self.have)
        scale = sum(listed[s][0] for s in names) or 1.0
        self.share = {s: listed[s][0] / scale for s in names}
        self.cap = {s: listed[s][1] for s in names}
        scarce = min((self.have[s] * self.cap[s] / self.share[s] for s in names), default=0)
        self.slot = int(max(1, min(slot_tokens, scarce // least_slots)))
        blocks = {s: self.have[s] * self.cap[s] // self.slot for s in names}
        n = int(min((blocks[s] / self.share[s] for s in names), default=0))
        self.slots = self._affordable(n, [blocks[s] for s in names])

    def _ends(self) -> list[int]:
        """Where the interval of each source, in name order, ends among the points."""
        return [round(x * _MODULUS) for x in accumulate(self.share[s] for s in sorted(self.share))]

    def _affordable(self, n: int, blocks: list[int]) -> int:
        """The largest number of slots, about ``n``, whose schedule needs no more blocks of any source than there are.

        Slots are counted per source and chunk by the executors; at most one chunk of a source, the one in which its
        blocks run out, is looked through here. If none runs out, twice as many slots are counted.
        """
        if not blocks:
            return 0
        names = sorted(self.share)
        have = self.spark.createDataFrame(list(zip(names, blocks)), "source string, have long")
        upto = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
        most = n + _CHUNK
        while True:
            counts = self._slots(most).groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
            running = counts.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(have), "source")  # one row per listed source
            over = running.filter("upto > have").groupBy("source").agg(F.min(F.struct("chunk", (F.col("have") - F.col("upto") + F.col("n")).alias("left"))).alias("first"))
            ends = [self._nth(names.index(r["source"]), r["first"]["chunk"], r["first"]["left"]) for r in over.collect()]
            if ends:
                return min(ends)
            most *= 2

    def _nth(self, k: int, chunk: int, left: int) -> int:
        """The slot of the k-th source that follows ``left`` others of it in a chunk."""
        slots = np.arange(chunk * _CHUNK, (chunk + 1) * _CHUNK)
        source = np.minimum(np.searchsorted(self._ends(), _point(slots), side="right"), len(self.share) - 1)
        return int(slots[source == k][left])

    def _source_at(self, point: Column) -> Column:
        names = sorted(self.share)
        pick = F.lit(names[-1])
        for s, end in reversed(list(zip(names, self._ends()))[:-1]):
            pick = F.when(point < end, F.lit(s)).otherwise(pick)
        return pick

    def _slots(self, n: int) -> DataFrame:
        """The first ``n`` slots: ``slot``, ``source``, ``chunk``."""
        i = F.col("id")
        return self.spark.range(n).select(i.alias("slot"), self._source_at(_point(i)).alias("source"), (i / _CHUNK).cast("long").alias("chunk"))

    def schedule(self) -> DataFrame:
        """Every slot: ``slot``, ``source``, ``block`` (rank among the source's slots)."""
        if not self.slots:
            return self.spark.createDataFrame([], "slot long, source string, block long")
        rows = self._slots(self.slots)
        before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
        offsets = counts.select("source", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        inner = rows.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
        return inner.join(offsets, ["source", "chunk"]).select("slot", "source", (F.col("before") + F.col("r")).alias("block"))

    def rows(self) -> DataFrame:
        """The mixture: ``slot``, ``source``, ``repetition`` (0-based), ``doc_id``, ``tokens``, ``place`` (order within the slot)."""
        plan = self.schedule()
        if not self.slots:
            return plan.select("slot", "source", F.lit(0).alias("repetition"), F.col("block").alias("doc_id"), F.col("block").alias("tokens"), F.col("block").alias("place"))
        reps = {s: min(self.cap[s], math.ceil((self.share[s] * self.slots + 64) * self.slot / self.have[s])) for s in self.share}
        lut = self.spark.createDataFrame([(s, reps[s], self.have[s]) for s in sorted(reps)], "source string, reps int, have long")
        docs = self.sized.join(F.broadcast(lut), "source")  # one row per listed source
        docs = docs.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.col("reps") - 1)))
        docs = docs.withColumn("epoch", F.xxhash64("repetition", F.lit(self.seed)))
        laid = hashed_running(docs, ["source", "repetition"], ["doc_id", "epoch"], F.col("tokens"), self.seed)
        at = F.col("repetition") * F.col("have") + F.col("run_before")
        blocks = laid.select("source", "repetition", "doc_id", "tokens", at.alias("place"), F.floor(at / self.slot).cast("long").alias("block"))
        # the last document of a source is taken if most of it lies before the source's target
        goal = self.spark.createDataFrame([(x, self.share[x] * self.slots * self.slot) for x in sorted(self.share)], "source string, goal double")
        blocks = blocks.join(F.broadcast(goal), "source").filter(F.col("place") + F.col("tokens") / 2 < F.col("goal"))
        return plan.join(blocks, ["source", "block"]).select("slot", "source", "repetition", "doc_id", "tokens", "place")

    def report(self) -> DataFrame:
        """Per listed source: ``target_share``, ``available_tokens``, ``max_repeat``, ``tokens``, ``actual_share``, ``documents``, ``most_repeats``, ``slot_tokens``."""
        used = self.rows().groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"))
        got = used.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("k").alias("most_repeats"))
        total = got.agg(F.sum("tokens").alias("total"))
        have = self.spark.createDataFrame(sorted(self.have.items()), "source string, available_tokens long")
        zero = F.lit(0).cast("long")
        return (
            self.weights.join(F.broadcast(have), "source", "left")  # one row per listed source
            .join(got, "source", "left")
            .join(F.broadcast(total))  # one row
            .select(
                "source",
                "target_share",
                F.coalesce("available_tokens", zero).alias("available_tokens"),
                "max_repeat",
                F.coalesce("tokens", zero).alias("tokens"),
                F.round(F.coalesce(F.try_divide("tokens", "total"), F.lit(0.0)), 6).alias("actual_share"),
                F.coalesce("documents", zero).alias("documents"),
                F.coalesce("most_repeats", zero).alias("most_repeats"),
                F.lit(self.slot).alias("slot_tokens"),
            )
        )
