"""Container packing: validity, dominance against exhaustive search, and quality."""

import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.llm import packing


def used(patterns, capacity):
    got = np.zeros(capacity + 1, int)
    for p in patterns:
        assert p.count > 0 and 0 < sum(s * k for s, k in p.sizes) <= capacity
        for s, k in p.sizes:
            got[s] += k * p.count
    return got


def fewest(items, capacity):
    """Least number of containers, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(k, boxes):
        if len(boxes) >= best[0]:
            return
        if k == len(items):
            best[0] = len(boxes)
            return
        for i in range(len(boxes)):
            if boxes[i] + items[k] <= capacity and boxes[i] not in boxes[:i]:
                boxes[i] += items[k]
                place(k + 1, boxes)
                boxes[i] -= items[k]
        boxes.append(items[k])
        place(k + 1, boxes)
        boxes.pop()

    place(0, [])
    return best[0] if items else 0


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 20), st.data())
def test_reduction_keeps_the_optimum(capacity, data):
    items = data.draw(st.lists(st.integers(1, capacity), max_size=9))
    counts = np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, int)
    left = counts.copy()
    fixed = packing.reduce_by_dominance(left, capacity)
    assert (used(fixed, capacity) + left == counts).all()
    rest = list(itertools.chain.from_iterable([s] * int(n) for s, n in enumerate(left)))
    assert sum(p.count for p in fixed) + fewest(rest, capacity) == fewest(items, capacity)


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 60), st.data())
def test_packing_is_valid_and_tight(capacity, data):
    items = data.draw(st.lists(st.integers(1, capacity), max_size=60))
    counts = np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, int)
    patterns = packing.pack_histogram(counts, capacity)
    assert (used(patterns, capacity) == counts).all()
    assert sum(p.count for p in patterns) <= max(1, -(-11 * sum(items) // (9 * capacity)) + len([x for x in items if 2 * x > capacity]) + 1)


def test_documents(spark):
    words = ["alpha beta gamma delta " * k for k in (0, 1, 5, 40, 300)] + [None, " ", "x"]
    df = spark.createDataFrame([(i, words[i % len(words)], "s", 9) for i in range(80)] + [(None, "a", "s", 9)], "doc_id long, text string, source string, tokens int")
    containers = spark.createDataFrame([("small", 64), ("big", 512), (None, 5), ("none", None), ("zero", 0)], "container string, capacity_tokens int")
    out = packing.packed(spark, df, containers)
    sizes = {r["doc_id"]: r["tokens"] for r in packing.token_sizes(df).collect()}
    for name, cap in (("small", 64), ("big", 512)):
        rows = out.filter(F.col("container") == name).collect()
        boxes = {}
        for r in rows:
            boxes[r["box"]] = boxes.get(r["box"], 0) + r["tokens"]
        assert max(boxes.values()) <= cap and sorted(boxes) == list(range(len(boxes)))
        docs = {}
        for r in rows:
            docs.setdefault(r["doc_id"], []).append((r["start_token"], r["tokens"]))
        assert docs.keys() == sizes.keys()
        for d, parts in docs.items():
            assert sum(n for _, n in parts) == sizes[d] and len(parts) == -(-sizes[d] // cap)
    fill = {r["container"]: r for r in packing.fill_report(spark, df, containers).collect()}
    assert fill["big"]["boxes"] <= fill["big"]["least_boxes"] + 2
    assert packing.packed(spark, df.limit(0), containers).count() == 0
    assert packing.packed(spark, df, containers.limit(0)).count() == 0


def test_three_items_are_fixed():
    """{6, 3, 1} dominates in a container of 10: no two items larger than 1 fit beside the 6, and no three do."""
    counts = np.bincount([6, 3, 1, 3], minlength=11)
    fixed = packing.reduce_by_dominance(counts, 10)
    assert [dict(p.sizes) for p in fixed][0] == {6: 1, 3: 1, 1: 1} and fixed[0].count == 1
