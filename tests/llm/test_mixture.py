"""Source mixture: shares, caps and order."""

import numpy as np
from pyspark.sql import functions as F

from voxloom.llm import mixture
from voxloom.llm.mixture import Mixture


def test_mixture(spark):
    n = {"a": 3000, "b": 400, "c": 900, "other": 50}
    rows = [(k * 10_000 + i, f"word{i} " * (1 + i % 9), s, 1) for k, s in enumerate(n) for i in range(n[s])] + [(7, "x", None, 1), (8, None, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, None), ("nothing", 0.1, 5), (None, 1.0, 1)], "source string, target_share double, max_repeat int")
    m = Mixture(spark, df, weights)
    out = m.rows().cache()
    got = {r["source"]: r for r in m.report().filter("source IS NOT NULL").collect()}
    for s, share in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9), ("nothing", 0)):
        assert abs(got[s]["actual_share"] - share) < 0.01
    reps = {r["source"]: r["m"] for r in out.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("m")).collect()}
    assert reps["a"] == 1 and 1 < reps["b"] <= 4 and reps["c"] == 1 and "other" not in reps
    assert out.groupBy("source", "doc_id", "repetition").count().filter("count > 1").count() == 0
    # every tenth of the mixture has the shares, nearly
    k = m.slots // 10
    for r in out.groupBy((F.col("slot") / k).cast("int").alias("part")).agg((F.sum(F.when(F.col("source") == "a", F.col("tokens"))) / F.sum("tokens")).alias("s")).filter("part < 10").collect():
        assert abs(r["s"] - 0.5 / 0.9) < 0.05
    plan = m.schedule().collect()
    for s in "abc":
        assert sorted(r["block"] for r in plan if r["source"] == s) == list(range(sum(r["source"] == s for r in plan)))


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeat int")
    assert Mixture(spark, df, weights).rows().count() == 0
    assert Mixture(spark, df, weights).report().first()["tokens"] == 0
    assert Mixture(spark, df, weights.limit(0)).report().count() == 0


def test_slots_are_counted_at_every_size(spark):
    weights = spark.createDataFrame([("a", 0.99, 1), ("b", 0.01, 1)], "source string, target_share double, max_repeat int")
    df = spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], "doc_id long, text string, source string")
    m = Mixture(spark, df, weights)
    for n, blocks in ((2_500_000, [2_480_000, 25_000]), (2_500_000, [2_475_000, 26_000]), (2_000, [1_990, 20])):
        golden = int((5**0.5 - 1) / 2 * 2**40) | 1  # whole multiples of it, modulo 2^40
        points = (np.arange(2 * n, dtype=np.uint64) * np.uint64(golden) + np.uint64(golden // 2)) % np.uint64(2**40)
        b = points / 2**40 >= m.share["a"]
        want = min(int(np.flatnonzero(~b)[blocks[0]]), int(np.flatnonzero(b)[blocks[1]]))
        assert m._affordable(n, blocks) == want


def test_points_are_exact(spark):
    """Columns and arrays give the points of whole-number arithmetic, for large slot numbers too."""
    ids = [0, 1, 2, 65535, 1 << 20, (1 << 33) + 12345, (1 << 40) - 1, (1 << 40) + 7]
    want = [(i * mixture._GOLDEN + mixture._GOLDEN // 2) % (1 << 40) for i in ids]
    df = spark.createDataFrame([(i,) for i in ids], "i long").select("i", mixture._point(mixture.F.col("i")).alias("p"))
    assert {r["i"]: r["p"] for r in df.collect()} == dict(zip(ids, want))
    assert mixture._point(mixture.np.array(ids)).tolist() == want
