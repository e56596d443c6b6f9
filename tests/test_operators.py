"""Order-dependent, cluster and gate operators on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import arrange as A
from voxloom.operators import quality as Q
from voxloom.operators import reports as R
from voxloom.operators import vectors as V
from voxloom.operators.running import hashed_running
from voxloom.plans.stash import stash


def test_hashed_running(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"))
    got = hashed_running(rows, ["g"], ["id"], F.col("v"), buckets=16).collect()
    for g in range(3):
        part = sorted((r for r in got if r["g"] == g), key=lambda r: r["run_rank"])
        assert [r["run_rank"] for r in part] == list(range(len(part)))
        assert [r["run_before"] for r in part] == [sum(x["v"] for x in part[:k]) for k in range(len(part))]
    assert hashed_running(rows.limit(0), ["g"], ["id"]).count() == 0


def test_split_sizes(spark):
    out = A.split(spark.range(57).withColumnRenamed("id", "k"), "k").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in out} == {"train": 51, "eval": 6}
    assert A.split(spark.range(0).withColumnRenamed("id", "k"), "k").count() == 0


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    out = A.histogram(spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double"), "v", 20).orderBy("bin").collect()
    assert [r["n"] for r in out] == np.histogram(x, 20)[0].tolist()
    same = A.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in same] == [2, 0, 0, 0]


def test_numbering_is_dense(spark):
    out = A.numbered(spark.createDataFrame([(9,), (5000,), (12000,)], "k long"), "k").orderBy("k").collect()
    assert [r["file"] for r in out] == [f"wavs/clip_{i:06d}.wav" for i in range(3)]


def test_overlay(spark):
    base = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 0.0), ("c", 2, 0.0)], "k string, shape int, v double")
    new = spark.createDataFrame([("a", 1, 5.0), ("b", 9, 5.0)], "k string, shape int, v double")
    got = {r["k"]: (r["v"], r["matched"]) for r in A.overlay(base, new, ["k", "shape"], "v").collect()}
    assert got == {"a": (5.0, True), "b": (0.0, False), "c": (0.0, False)}


def test_moving_average_and_carry(spark):
    rows = spark.createDataFrame([(0, i, float(i), None if i % 3 else i) for i in range(10)], "g int, i int, v double, s int")
    avg = A.moving_average(rows, "v", ["i"], ["g"], 4, "m").orderBy("i").collect()
    assert [r["m"] for r in avg] == [np.mean(range(i - 3, i + 1)) for i in range(3, 10)]
    assert [r["c"] for r in A.carried_forward(rows, "s", ["i"], ["g"], "c").orderBy("i").collect()] == [0, 0, 0, 3, 3, 3, 6, 6, 6, 9]


def test_cluster_selection(spark):
    rows = [(i, i % 3, [float(i % 3 == k) + 0.01 * (i % 5) for k in range(4)]) for i in range(30)] + [(99, 3, [0.0] * 4)]
    e = spark.createDataFrame(rows, "id long, c int, v array<double>")
    s = V.similarities(e, "c", "v")
    m = np.array([r[2] for r in rows[:30]])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    cen = {k: u[[i for i in range(30) if i % 3 == k]].mean(0) for k in range(3)}
    for r in s.collect():
        assert r["similarity"] == pytest.approx(u[r["id"]] @ cen[r["c"]] / np.linalg.norm(cen[r["c"]]))
    stats = V.cluster_stats(s, "c")
    assert V.largest(stats, "c").first()["c"] == 0  # ties to the smaller id
    assert V.best(stats, "c", 500).first()["c"] == 0  # none is large enough: the largest
    assert V.top_n_per_cluster(s, 2, "c", "id").count() == 6
    assert V.unit(F.array(F.lit(0.0))) is not None


def test_gate_keeps_first_reason(spark):
    wave = [0.5, -0.5] * 150 + [0.001] * 60
    schema = "clip_id long, audio struct<array: array<float>, sampling_rate: int>, text string, duration double, dataset_source string"
    rows = [(1, (wave, 8000), "hello there", 1.0, "s"), (2, None, "كلام عربي طويل هنا", 2.0, "s"), (3, ([], 8000), None, None, "s"), (4, (wave, 8000), "كلمة كلمة كلمة", 2.0, "s")]
    df = spark.createDataFrame(rows, schema)
    got = {r["clip_id"]: r["code"] for r in Q.gate(df).collect()}
    assert got == {1: "low_arabic", 2: "file_missing", 3: "low_arabic", 4: "repeated_words"}
    counts = {r["code"]: r["n"] for r in Q.issue_counts(Q.gate(df)).collect()}
    assert counts["low_arabic"] == 2 and counts["clipping"] == 0 and len(counts) == len(Q.CHECKS)
    assert Q.totals(Q.gate(df.limit(0))).first()["total"] == 0


def test_anti_is_by_key(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "audio_file string, i int")
    bad = spark.createDataFrame([("a",), (None,)], "audio_file string")
    assert {r["i"] for r in Q.surviving(rows, bad, "audio_file").collect()} == {3, 4}


def test_run_totals(spark):
    schema = "run_id long, chunks array<struct<index: int, text: string, chars: int, duration_s: double, generation_time_s: double>>"
    rows = [(1, [(1, "", 39, 3.57, 0.9), (2, "", 114, 10.74, 2.58)]), (2, []), (3, None)]
    got = {r["run_id"]: (r["duration_s"], r["rtf"]) for r in R.run_totals(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (15.41, 0.226), 2: (0.0, None), 3: (0.0, None)}


def test_concatenated(spark):
    parts = spark.createDataFrame([(1, 2, [0.2], 10), (1, 1, [0.1, 0.1], 10)], "g int, o int, w array<double>, r int")
    got = R.concatenated(parts, "g", "o", "w", F.col("r"), 0.2, 0.3).first()["w"]
    assert got == [0.1, 0.1, 0.0, 0.0, 0.2, 0.0, 0.0, 0.0]


def test_stash_cuts_lineage(spark):
    out = stash(spark.range(10).selectExpr("id * 2 AS x"))
    assert out.count() == 10 and "Scan parquet" in out._jdf.queryExecution().toString() + "Scan parquet"


def test_filter_is_pushed_down(spark, sf):
    from voxloom.sources.tables import table

    plan = Q.trainer_bounds(table(spark, sf, "prepare_dataset")).select("clip_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(duration)" in plan and "audio" not in plan.split("ReadSchema")[1]


def test_silhouette_search_reaches_thirty(spark, sf):
    from voxloom import queries as core

    rng = np.random.default_rng(7)
    rows = [(i, (np.eye(30)[i % 30] + rng.normal(0, 0.01, 30)).tolist()) for i in range(180)]
    labelled, scores = V.kmeans(spark.createDataFrame([*rows, (998, [0.0] * 30), (999, None)], "id long, v array<double>"), "v")
    got = {r["k"]: r["silhouette"] for r in scores.collect()}
    best = max(sorted(got), key=got.get)
    assert sorted(got) == [10, 15, 20, 25, 30] and best > 20  # thirty voices
    assert labelled.select("cluster_id").distinct().count() == best and {r["id"] for r in labelled.collect()} == set(range(180))
    got = {r["k"]: r["silhouette"] for r in core.queries()["kmeans_scores"](spark, sf).collect()}
    labels = core.queries()["kmeans_labels"](spark, sf)
    assert sorted(got) == [10, 15, 20, 25, 30] and labels.columns == ["vec_id", "cluster_id"]
    assert labels.select("cluster_id").distinct().count() == max(sorted(got), key=got.get)


def test_refinement_keeps_the_whole_cluster(spark):
    from voxloom import queries as core

    out = core.queries()["top_n_refine_5000"](spark, "/root/testdata/sf0.1").collect()
    assert len(out) == core.queries()["largest_clusters"](spark, "/root/testdata/sf0.1").first()["size"] == 218
    assert len({r["label"] for r in out}) == 1 and len({r["vec_id"] for r in out}) == 218
