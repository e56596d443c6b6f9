"""Filling fixed-capacity containers with items (problem 6).

Item sizes are whole tokens, so an instance is its histogram: at most ``capacity``
numbers, however many items there are. On it, dominance reduction fixes for good
every container {j, ...} that is as good as any other container of j; what is left
is packed best-fit decreasing. Both work on counts - many equal containers in one
step - and give patterns with multiplicities. The items themselves never leave
the executors: each gets a rank among those of its size, spread over buckets, and
the patterns say which container the rank-th item of a size goes to.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.tokens import token_sizes
from voxloom.operators.running import hashed_running
from voxloom.plans.stash import stash

#: Buckets in which the items of one size are ranked: at least, and items of the most frequent size in one, about.
RANK_BUCKETS, RANKED = 64, 50_000


@dataclass
class Pattern:
    """``count`` containers that each hold ``sizes`` (size, how many)."""

    sizes: tuple[tuple[int, int], ...]
    count: int
    fixed: bool


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fixes provably dominating containers and takes their items out of ``counts``.

    For the largest item j left over, with r = capacity - j and k the largest item
    that fits r, a container of j dominates all others of j in these cases:

    * {j}, if nothing fits r;
    * {j, k}, if k fills r, if no two items fit r together, or if no three do and
      k is at least as large as any two that fit;
    * {j, k, b} with b the largest item that fits beside j and k, if no three
      items fit r and no two that are both larger than b: any two that fit are
      then no larger than k and b.

    Items for which none of this can be shown stay in ``counts``.
    """
    out: list[Pattern] = []
    sizes = [int(s) for s in np.flatnonzero(counts)]  # ascending, those with items
    for j in reversed(list(sizes)):
        while counts[j]:
            chosen = _dominating(sizes, counts, j, capacity - j)
            if chosen is None:
                break
            need = Counter(chosen)
            m = min(int(counts[s]) // n for s, n in need.items())
            out.append(Pattern(tuple(need.items()), m, True))
            for s, n in need.items():
                counts[s] -= m * n
                if not counts[s]:
                    sizes.remove(s)
    return out


def _dominating(sizes: list[int], counts: np.ndarray, j: int, r: int) -> list[int] | None:
    """The items of a container of j that dominates all others of j, if there is a proof."""
    counts[j] -= 1  # the item itself
    try:
        alive = sizes if counts[j] else [s for s in sizes if s != j]
        at = bisect.bisect_right(alive, r) - 1
        if at < 0:
            return [j]
        k = alive[at]
        small = _smallest(alive, counts, 3)
        if k == r or len(small) < 2 or small[0] + small[1] > r:
            return [j, k]
        if len(small) == 3 and sum(small) <= r:
            return None
        if k >= _best_pair(alive, r):
            return [j, k]
        at = bisect.bisect_right(alive, r - k) - 1
        if at >= 0 and alive[at] == k and counts[k] < 2:
            at -= 1
        if at < 0:
            return None
        larger = _smallest(alive[at + 1 :], counts, 2)
        return [j, k, alive[at]] if len(larger) < 2 or sum(larger) > r else None
    finally:
        counts[j] += 1


def _smallest(sizes: list[int], counts: np.ndarray, n: int) -> list[int]:
    out: list[int] = []
    for s in sizes[:n]:
        out += [s] * min(n - len(out), int(counts[s]))
        if len(out) == n:
            break
    return out


def _best_pair(sizes: list[int], r: int) -> int:
    """The largest sum of two items within r; one item of a size may count twice, which only makes the test stricter."""
    best, hi = 0, len(sizes) - 1
    for lo in range(len(sizes)):
        while hi >= lo and sizes[lo] + sizes[hi] > r:
            hi -= 1
        if hi < lo:
            break
        best = max(best, sizes[lo] + sizes[hi])
    return best


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram; equal containers are filled together."""
    open_at: dict[int, list[Pattern]] = {}
    frees: list[int] = []

    def add(p: Pattern, free: int) -> None:
        if p.count:
            if free not in open_at:
                open_at[free] = []
                bisect.insort(frees, free)
            open_at[free].append(p)

    for s in np.flatnonzero(counts)[::-1]:
        s, left = int(s), int(counts[s])
        while left:
            at = bisect.bisect_left(frees, s)
            if at == len(frees):
                each = capacity // s
                full, rest = divmod(left, each)
                add(Pattern(((s, each),), full, False), capacity - s * each)
                if rest:
                    add(Pattern(((s, rest),), 1, False), capacity - s * rest)
                break
            free = frees[at]
            p = open_at[free].pop()
            if not open_at[free]:
                del open_at[free], frees[at]
            each = min(free // s, left)
            m = min(p.count, left // each)
            add(Pattern((*p.sizes, (s, each)), m, False), free - s * each)
            add(Pattern(p.sizes, p.count - m, False), free)
            left -= m * each
        counts[s] = 0
    return [p for ps in open_at.values() for p in ps]


def pack_histogram(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns for a histogram (``counts[s]`` items of size s, 0 < s <= capacity)."""
    left = counts.astype(np.int64).copy()
    return reduce_by_dominance(left, capacity) + best_fit_decreasing(left, capacity)


def _segments(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Which ranks of a size go where: rows (size, from rank, first container, how many in each)."""
    rows, used, first = [], {}, 0
    for p in patterns:
        for s, each in p.sizes:
            rows.append((s, used.get(s, 0), first, each))
            used[s] = used.get(s, 0) + each * p.count
        first += p.count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"size": table[:, 0], "at": table[:, 1], "first": table[:, 2], "each": table[:, 3]}


def _placer(container: str, segments: dict[str, np.ndarray]):
    order = segments["size"] * (1 << 40) + segments["at"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key = pdf["tokens"].to_numpy(np.int64) * (1 << 40) + pdf["run_rank"].to_numpy(np.int64)
            k = np.searchsorted(order, key, side="right") - 1
            box = segments["first"][k] + (pdf["run_rank"].to_numpy(np.int64) - segments["at"][k]) // segments["each"][k]
            yield pd.DataFrame({"container": container, "box": box, "doc_id": pdf["doc_id"], "piece": pdf["piece"], "start_token": pdf["start_token"], "tokens": pdf["tokens"]})

    return run


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """Items of at most ``capacity``: ``doc_id``, ``piece``, ``start_token``, ``tokens``; only larger texts are cut."""
    n = F.ceil(F.col("tokens") / F.lit(capacity)).cast("int")
    cut = sized.select("doc_id", F.col("tokens").alias("all"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select("doc_id", "piece", start.alias("start_token"), F.least(F.col("all") - start, F.lit(capacity).cast("long")).alias("tokens"))


def packed(spark: SparkSession, documents: DataFrame, containers: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every text, or piece of one, in a container of each kind.

    Columns ``container``, ``box`` (0-based number of the container), ``doc_id``,
    ``piece``, ``start_token``, ``tokens``. ``documents`` needs ``doc_id``
    (unique), ``source`` and ``text``; ``containers`` is a small table
    (``container``, ``capacity_tokens``) whose rows are cases of their own; rows
    with a null name or without a positive capacity are skipped. Documents without
    tokens need no container and have no row. The histogram that reaches the
    driver has at most ``capacity_tokens`` rows.
    """
    sized = stash(token_sizes(documents, tokenizer).select("doc_id", "tokens"))
    schema = "container string, box long, doc_id long, piece int, start_token long, tokens long"
    out = None
    for name, capacity in sorted((r[0], r[1]) for r in containers.select("container", "capacity_tokens").collect() if r[0] is not None and (r[1] or 0) > 0):
        items = pieces(sized, capacity)
        counts = np.zeros(capacity + 1, np.int64)
        for r in items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r["tokens"]] = r["n"]
        segments = _segments(pack_histogram(counts, capacity))
        buckets = max(RANK_BUCKETS, -(-int(counts.max()) // RANKED))
        ranked = hashed_running(items, ["tokens"], ["doc_id", "piece"], buckets=buckets)
        part = ranked.mapInPandas(_placer(name, segments), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def fill_report(spark: SparkSession, documents: DataFrame, containers: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per container kind: ``boxes``, ``items``, ``tokens``, ``least_boxes`` (tokens / capacity, rounded up), ``fill``."""
    rows = packed(spark, documents, containers, tokenizer)
    per_box = rows.groupBy("container", "box").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    agg = per_box.groupBy("container").agg(F.count(F.lit(1)).alias("boxes"), F.sum("n").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return agg.join(containers, "container").select("container", "capacity_tokens", "boxes", "items", "tokens", "fullest", least.alias("least_boxes"), F.round(F.col("tokens") / (F.col("boxes") * F.col("capacity_tokens")), 6).alias("fill"))
