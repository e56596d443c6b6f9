"""The pipelines end to end on small inputs."""

from pyspark.sql import functions as F

from voxloom import pipelines as P
from voxloom.sources import files
from voxloom.sources.tables import table


def test_corpus_build(spark, sf, tmp_path):
    clips = table(spark, sf, "prepare_dataset")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("clip_id"), "embedding", F.col("label").alias("cluster"))
    c = P.build_corpus(clips, vectors)
    n = c.report.first()["clips"]
    assert n == c.export.count() > 0 and c.report.first()["valid_after_filtering"] >= n
    parts = {r["part"]: r["count"] for r in c.export.groupBy("part").count().collect()}
    assert parts.get("train", 0) == int(n * 0.9) and sum(parts.values()) == n
    c.write(str(tmp_path))
    assert files.read_metadata(spark, f"{tmp_path}/metadata_train").count() == parts.get("train", 0)
    top = P.build_corpus(clips, vectors, top_n=2)
    assert top.export.count() == 2


def _mostly_without_vectors(spark, sf):
    """The clips, three times as many in three partitions of which two have no vector, and the vectors."""
    clips = table(spark, sf, "prepare_dataset")
    more = [clips.withColumn("clip_id", F.col("clip_id") + k * 10**6) for k in (1, 2)]
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("clip_id"), "embedding", F.col("label").alias("cluster"))
    return clips, clips.unionByName(more[0]).unionByName(more[1]).repartitionByRange(3, "clip_id"), F.broadcast(vectors)


def test_report_of_partitions_without_vectors(spark, sf):
    """Larger tables have partitions of clips of which none has a vector; they add to the valid clips only."""
    clips, own, vectors = _mostly_without_vectors(spark, sf)
    want, got = (P.build_corpus(c, vectors).report.first().asDict() for c in (clips, own))
    assert got == want | {"valid_after_filtering": 3 * want["valid_after_filtering"]} and got["clips"] > 0


def test_selection_of_partitions_without_vectors(spark, sf):
    """The same members, similarities, files and parts, also where a partition has zero vectors only, in a cluster of their own."""
    clips, own, vectors = _mostly_without_vectors(spark, sf)
    zero = vectors.select(F.col("clip_id") + 10**6, F.transform("embedding", lambda x: x * F.lit(0).cast("float")), F.lit(-1)).toDF(*vectors.columns)
    want, got = (sorted(map(tuple, P.build_corpus(*x).export.collect())) for x in ((clips, vectors), (own, F.broadcast(vectors.unionByName(zero)))))
    assert got == want and want


def test_gate(spark):
    wave = [0.5, -0.5] * 4000 + [0.001] * 2000 + [0.3] * 6000
    meta = "audio_file string, text string, speaker_name string"
    train = spark.createDataFrame([("a", "كلام عربي سليم وطويل", "s"), ("b", "latin text only", "s"), ("b", "كلام عربي سليم وطويل", "s"), ("c", "كلام عربي سليم وطويل", "s")], meta)
    evaluation = spark.createDataFrame([("d", "كلام عربي سليم وطويل", "s"), ("e", "كلام عربي سليم وطويل", "s")], meta)
    waves = spark.createDataFrame([(x, wave, 8000) for x in "abde"], "audio_file string, samples array<double>, rate int")
    reviews = spark.createDataFrame([("d", "x", "y", 0.1), ("a", "x", "x", 0.9), ("e", "x", None, None)], "audio_file string, original_text string, whisper_text string, similarity double")
    g = P.quality_gate(train, evaluation, waves, reviews)
    assert {r["audio_file"]: (r["layer"], r["code"]) for r in g.rejected.collect()} == {"b": (1, "low_arabic"), "c": (2, "file_missing"), "d": (3, "low_similarity"), "e": (3, "low_similarity")}  # the original counts both under one code
    assert [r["audio_file"] for r in g.kept.collect()] == ["a"]
    assert g.totals.first()["total"] == 6 and {r["code"]: r["n"] for r in g.issues.collect()}["low_similarity"] == 2


def test_chunks_and_evaluation(spark):
    docs = spark.createDataFrame([(1, "اكثر من 70% من الشركات. " * 12), (2, ""), (3, None)], "doc_id long, text string")
    rows = P.text_to_chunks(docs).orderBy("pos").collect()
    assert {r["doc_id"] for r in rows} == {1} and all("سبعون بالمئة" in r["chunk"] and r["chunk"].startswith("أكثر") for r in rows)
    assert [r["chunk_seed"] for r in rows] == [12345 + k for k in range(len(rows))]
    waves = spark.createDataFrame([("base", [0.5] * 900, 8000), ("tuned", [0.25] * 900, 8000), ("none", None, 8000)], "stage string, samples array<double>, rate int")
    got = P.evaluation(waves).first()["metrics"]
    assert set(got) == {"base", "tuned"} and got["tuned"]["rms"] == 0.25


def test_gate_layers_are_worded_and_cheap_first(spark, monkeypatch):
    """Reasons of all layers, both units of the totals, repeated waves, and no wave of a clip that its text rejects is measured."""
    good = "كلام عربي سليم وطويل"
    meta = "audio_file string, text string"
    train = spark.createDataFrame([("a", good), ("b", "latin"), ("b", good), ("c", good), (None, "latin")], meta)
    reviews = spark.createDataFrame([("c", good, "شيء", None), ("a", good, good, None), ("b", "x", "y", 0.0)], "audio_file string, original_text string, whisper_text string, similarity double")
    g = P.quality_gate(train, train.limit(0), None, reviews, computed=True)
    got = {r["audio_file"]: r["reason"] for r in g.rejected.collect()}
    assert got.keys() == {"b", "c"} and got["b"].startswith("Layer 1: Low Arabic ratio (0.00)") and got["c"].startswith("Layer 3: Low alignment (0.") and got["c"].endswith("| Whisper: شيء")
    assert g.totals.first().asDict() == {"total": 5, "rejected": 3, "kept": 2, "rejected_share": 0.6}
    assert g.clip_totals.first().asDict() == {"total": 3, "rejected": 2, "kept": 1, "rejected_share": 0.666667}
    waves = spark.createDataFrame([("a", [0.5, -0.5] * 8000, 8000), ("a", [0.5, -0.5] * 8000, 8000), ("b", [0.5], -1)], "audio_file string, samples array<double>, rate int")
    g = P.quality_gate(train, train.limit(0), waves, reviews.limit(0))
    assert {r["audio_file"]: r["code"] for r in g.rejected.collect()}["c"] == "file_missing" and g.kept.count() == 2 - (1 if g.rejected.filter("audio_file = 'a'").count() else 0)
    assert [r["audio_file"] for r in P.Q.listed(g.rejected).collect()] == sorted(r["audio_file"] for r in g.rejected.collect())
