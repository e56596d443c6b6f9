"""Joins by blocks give what plain joins give."""

import random

from voxloom.plans import blocks


def test_meet_equals_a_plain_join(spark):
    rng = random.Random(1)
    x = [(0 if rng.random() < 0.5 else rng.randrange(9), i) for i in range(300)]
    y = [(1 if rng.random() < 0.5 else rng.randrange(9), i) for i in range(200)]
    pairs = [(0, 1), (0, 0), (3, 1), (5, 6), (99, 1)]
    links = spark.createDataFrame(pairs, "t long, e long")
    left, right = spark.createDataFrame(x, "t long, x long"), spark.createDataFrame(y, "e long, y long")
    got = sorted(tuple(r) for r in blocks.meet(links, left, right, ["t"], ["e"], size=20).select("t", "e", "x", "y").collect())
    assert got == sorted((t, e, i, j) for t, e in pairs for a, i in x if a == t for b, j in y if b == e)
    hot = {r["t"]: r["__k"] for r in blocks.hot_keys(left, ["t"], 20).collect()}
    assert hot[0] == -(-sum(a == 0 for a, _ in x) // 20)


def test_hot_rows_are_spread(spark):
    left = spark.createDataFrame([(7, i) for i in range(1000)] + [(8, 1)], "t long, x long")
    hot = blocks.hot_keys(left, ["t"], 100)
    sizes = {(r["t"], r["b"]): r["count"] for r in blocks.dealt(left, ["t"], ["x"], hot, "b").groupBy("t", "b").count().collect()}
    assert len(sizes) == 11 and max(sizes.values()) < 200 and sizes[8, 0] == 1
    assert blocks.hot_keys(left.limit(0), ["t"]).count() == 0
