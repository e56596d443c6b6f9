"""The stateless gates give the same rows on a stream as on the table."""

from voxloom.sources.tables import table
from voxloom.streaming import gates


def test_stream_equals_batch(spark, sf, tmp_path):
    clips = table(spark, sf, "prepare_dataset")
    clips.repartition(3).write.parquet(str(tmp_path / "in"))
    src = gates.stream(spark, str(tmp_path / "in"), clips.schema)
    for fn, name in ((gates.range_filtered, "ranged"), (gates.text_gated, "gated")):
        q = fn(src).select("clip_id").writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r[0] for r in spark.table(name).collect()) == sorted(r[0] for r in fn(clips).select("clip_id").collect())


def test_windowed_counts(spark, sf, tmp_path):
    clips = table(spark, sf, "prepare_dataset").select("ingested_at", "dataset_source")
    clips.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = gates.counts(gates.stream(spark, str(tmp_path / "in"), clips.schema), "ingested_at").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, gates.counts(clips, "ingested_at").collect()))
