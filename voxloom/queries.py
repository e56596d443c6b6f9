"""Queries over the test tables for the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom import pipelines, queries_files
from voxloom.functions import signal as S
from voxloom.functions import text as T
from voxloom.operators import arrange as A
from voxloom.operators import quality as Q
from voxloom.operators import reports as R
from voxloom.operators import vectors as V
from voxloom.sources import files
from voxloom.sources.tables import table
from voxloom.streaming import gates

Query = Callable[[SparkSession, str], DataFrame]


def _of(name: str):
    return lambda s, d: table(s, d, name)


metadata, clips, reviews, runs, documents, embeddings, events = map(_of, ("metadata_eval", "prepare_dataset", "sanity_review", "generation_stats", "documents", "embeddings", "events"))


def _texts(s: SparkSession, d: str) -> DataFrame:
    return metadata(s, d).select("row_id", F.coalesce("text", F.lit("")).alias("text"))


def _text_query(fn) -> Query:
    return lambda s, d: metadata(s, d).select("row_id", fn(F.col("text")).alias("out"))


def range_filter(s, d):
    return Q.in_range(Q.with_defaults(clips(s, d))).select("clip_id", F.round("duration", 6).alias("duration"), F.length("text").alias("n_chars"))


def script_profile(s, d):
    t = F.col("text")
    return _texts(s, d).select("row_id", F.round(T.arabic_ratio(t), 6).alias("arabic_ratio"), T.latin_count(t).alias("latin_count"), F.length(t).alias("n_chars"))


def char_rate(s, d):
    rate = F.length("text") / F.greatest("duration", F.lit(0.1))
    return clips(s, d).filter("text IS NOT NULL AND duration IS NOT NULL").select("clip_id", F.round(rate, 4).alias("rate"), (~rate.between(*Q.RATE)).alias("rejected"))


def text_gate(s, d):
    t = _texts(s, d).withColumns(Q.text_metrics(F.col("text")))
    return t.select("row_id", Q.text_code(None).alias("code"))


def metrics(s, d):
    m = clips(s, d).select("clip_id", S.wave_metrics("audio.array", "audio.sampling_rate").alias("m")).filter("m.samples IS NOT NULL")
    names = ("duration_s", "rms", "peak", "snr_gate", "snr_eval", "snr_base", "silence_ratio", "clipping_ratio", "speaking_s")
    return m.select("clip_id", F.col("m.samples").alias("samples"), F.col("m.frames").alias("frames"), *[F.round(f"m.{n}", 4).alias(n) for n in names])


def stage_metrics(s, d):
    m = clips(s, d).select("dataset_source", S.wave_metrics("audio.array", "audio.sampling_rate").alias("m")).filter("m.samples IS NOT NULL")
    return m.groupBy("dataset_source").agg(F.count(F.lit(1)).alias("clips"), *[F.round(F.avg(f"m.{n}"), 4).alias(n) for n in ("duration_s", "rms", "peak", "silence_ratio", "speaking_s")])


def scored(s, d):
    return V.similarities(embeddings(s, d), "label", "embedding")


def _stats(s, d):
    return V.cluster_stats(scored(s, d), "label")


def top_n_refine(s, d, n: int = 100):
    e = scored(s, d)
    top = V.largest(e.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label").select("label")
    return V.top_n(e.join(top, "label", "left_semi"), n, "vec_id").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


def top_per_cluster(s, d):
    return V.top_n_per_cluster(scored(s, d), 5, "label", "vec_id").select("label", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def centroid_values(s, d):
    return V.centroids(embeddings(s, d), "label", "embedding").select(F.col("cluster").alias("label"), F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


def cluster_share(s, d):
    sizes = embeddings(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("t"))
    return sizes.join(F.broadcast(total)).select("label", "size", F.round(F.col("size") / F.col("t") * 100, 1).alias("percentage"))  # one row


def split_counts(s, d):
    return A.split(documents(s, d).select("doc_id"), "doc_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def split_union(s, d):
    m = metadata(s, d).select("row_id", "split", "dataset_source")
    both = m.filter("split = 'train'").withColumn("origin", F.lit("train")).unionByName(m.filter("split = 'eval'").withColumn("origin", F.lit("eval")))
    return both.groupBy("origin", "dataset_source").agg(F.count(F.lit(1)).alias("n"))


def anti_rejected(s, d):
    return Q.surviving(metadata(s, d), Q.alignment(reviews(s, d)).filter("code IS NOT NULL"), "audio_file").select("row_id")


def key_overlay(s, d):
    base = metadata(s, d).select("row_id", "audio_file", "text", F.lit(None).cast("double").alias("similarity"))
    new = reviews(s, d).select("audio_file", F.col("original_text").alias("text"), "similarity")
    return A.overlay(base, new, ["audio_file", "text"], "similarity").select("row_id", "similarity", "matched")


def derived_paths(s, d):
    p = F.col("audio_file")
    return metadata(s, d).filter("audio_file IS NOT NULL").select("row_id", files.stem_suffix(p, "_48kHz").alias("upsampled"), files.stats_name(p).alias("stats"), T.strip_prefix(p, "wavs/").alias("short"))


def flagged_sample(s, d):
    low = Q.alignment(reviews(s, d)).select("audio_file", "code")
    return A.flagged_union(low.filter("code IS NOT NULL").select("audio_file"), low.filter("code IS NULL").select("audio_file")).groupBy("selected").agg(F.count(F.lit(1)).alias("n"))


def length_capped(s, d):
    return A.capped(documents(s, d), "text").select("doc_id", "code")


def clamped(s, d):
    a = F.transform("audio.array", lambda x: F.greatest(F.least(x.cast("double"), F.lit(0.5)), F.lit(-0.5)))
    return clips(s, d).filter("size(audio.array) > 0").select("clip_id", F.round(F.array_max(a), 6).alias("hi"), F.round(F.array_min(a), 6).alias("lo"))


def concatenated(s, d):
    parts = clips(s, d).filter("audio.array IS NOT NULL AND audio.sampling_rate IS NOT NULL").select("clip_id", F.floor(F.col("clip_id") / 4).alias("grp"), F.col("audio.array").alias("wave"), F.col("audio.sampling_rate").alias("rate"))
    out = R.concatenated(parts, "grp", "clip_id", "wave", F.col("rate"), 0.004, 0.007)
    total = F.aggregate("wave", F.lit(0.0), lambda a, x: a + F.abs(x))
    return out.select("grp", F.size("wave").alias("samples"), F.round(total, 4).alias("level"))


def _edited(fn, **kw) -> Query:
    edit = S.edit(fn, **kw)

    def query(s, d):
        out = clips(s, d).filter("size(audio.array) > 0").select("clip_id", edit("audio.array", "audio.sampling_rate").alias("w"))
        return out.select("clip_id", F.size("w").alias("kept"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + F.abs(x)), 4).alias("level"))

    return query


def seq_similarity(s, d):
    return reviews(s, d).select("audio_file", F.round(T.similarity(F.col("original_text"), F.col("whisper_text")), 4).alias("similarity"))


def chunk_rows(s, d):
    return documents(s, d).filter("text IS NOT NULL").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("pos", "chunk"))


def chunk_rows_lite(s, d):
    return documents(s, d).filter("text IS NOT NULL").select("doc_id", F.posexplode(T.chunks(F.col("text"), lite=True)).alias("pos", "chunk"))


def resampled(s, d):
    @F.pandas_udf("array<double>")
    def to_16k(a, r):
        import pandas as pd

        return pd.Series([None if x is None or pd.isna(q) else S.resample(S.samples(x), int(q), 16000) for x, q in zip(a, r)])

    return clips(s, d).select("clip_id", to_16k("audio.array", "audio.sampling_rate").alias("w")).filter("w IS NOT NULL").select("clip_id", F.size("w").alias("samples"))


def embedded(s, d):
    """An injected encoder over waveforms: here, four level statistics."""

    def encode(waves, rates):
        return [[float(w.mean()), float(w.std()), float(abs(w).max()), float(r)] if len(w) else None for w, r in zip(waves, rates)]

    base = clips(s, d).select("clip_id", F.col("audio.array").alias("w"), F.col("audio.sampling_rate").alias("r"))
    found = R.with_model(base, encode, "w", "r", "clip_id", "embedding array<double>")
    return found.filter("embedding IS NOT NULL").select("clip_id", *[F.round(F.col("embedding")[k], 5).alias(n) for k, n in enumerate(("mean", "deviation", "peak", "rate"))])


def corpus_report(s, d):
    """The one-row report of the corpus build."""
    vectors = embeddings(s, d).select(F.col("vec_id").alias("clip_id"), "embedding", F.col("label").alias("cluster"))
    return pipelines.build_corpus(clips(s, d), vectors).report


def distinct_counts(s, d):
    """Distinct clips, texts and speakers per source."""
    names = {"clips": "audio_file", "texts": "text", "speakers": "speaker_name"}
    return metadata(s, d).groupBy("dataset_source").agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(k) for k, c in names.items()])


def stage_report(s, d):
    """The metrics of every source as one map, listed."""
    m = clips(s, d).select("dataset_source", S.wave_metrics("audio.array", "audio.sampling_rate").alias("m")).filter("m.samples IS NOT NULL")
    names = ["duration_s", "rms", "peak", "silence_ratio", "speaking_s"]
    one = R.stage_map(m.select("dataset_source", *[F.col(f"m.{n}").alias(n) for n in names]), "dataset_source", names)
    return one.select(F.explode("metrics").alias("dataset_source", "v")).select("dataset_source", *[F.round(f"v.{n}", 4).alias(n) for n in names])


def _judged(s, d) -> pipelines.Gated:
    """The gate over metadata and reviews, which have no waves."""
    m = metadata(s, d).select("audio_file", "text", "split")
    return pipelines.quality_gate(m.filter("split = 'train'").drop("split"), m.filter("split = 'eval'").drop("split"), None, reviews(s, d))


def speaker_runs(s, d):
    """Synthesis settings looked up by seed; runs whose seed no other table knows say so."""
    known = events(s, d).select(F.col("user_id").alias("seed"), F.col("value").alias("weight"))
    return A.looked_up(runs(s, d).select("run_id", F.col("params.seed").cast("long").alias("seed")), "seed", known, ["weight"]).select("run_id", "seed", "weight", "error")


def pace_labels(s, d):
    label = A.scale_label(F.col("rtf"), [(0.25, "fast"), (1.0, "real time")], "slow")
    return runs(s, d).select("run_id", label.alias("label"))


def frame_levels(s, d):
    """RMS of every overlapping 25 ms frame."""
    levels = S.edit(lambda x, r: S.frame_rms(x, int(r * 0.025), int(r * 0.025) // 2))
    return clips(s, d).filter("size(audio.array) > 0").select("clip_id", F.posexplode(levels("audio.array", "audio.sampling_rate")).alias("frame", "rms")).withColumn("rms", F.round("rms", 6))


def unit_vectors(s, d):
    return embeddings(s, d).select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("i", "x")).withColumn("x", F.round("x", 6))


def corpus_selection(s, d):
    """The corpus build with stored vectors: the members of the chosen cluster."""
    vectors = embeddings(s, d).select(F.col("vec_id").alias("clip_id"), "embedding", F.col("label").alias("cluster"))
    return pipelines.build_corpus(clips(s, d), vectors).export.select("clip_id", "file", F.round("similarity", 6).alias("similarity"), "part")


def corpus_flagship(s, d):
    """Range filter, text gate and first reason per source: counts."""
    kept = Q.in_range(Q.with_defaults(clips(s, d)))
    coded = kept.withColumns(Q.text_metrics(F.col("text"))).withColumn("code", F.coalesce(Q.text_code(F.col("duration")), F.lit("kept")))
    return coded.groupBy("dataset_source", "code").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return {
        "corpus_flagship": corpus_flagship,
        "range_filter": range_filter,
        "trainer_bounds": lambda s, d: Q.trainer_bounds(Q.with_defaults(clips(s, d))).select("clip_id"),
        "script_profile": script_profile,
        "repeated_words": lambda s, d: _texts(s, d).filter(T.repeats_words(F.col("text"))).select("row_id"),
        "repeated_words_documents": lambda s, d: documents(s, d).filter(T.repeats_words(F.col("text"))).select("doc_id"),
        "char_rate": char_rate,
        "text_gate": text_gate,
        "gate": lambda s, d: Q.gate(clips(s, d)),
        "issue_counts": lambda s, d: Q.issue_counts(Q.gate(clips(s, d))),
        "gate_totals": lambda s, d: Q.totals(Q.gate(clips(s, d))),
        "alignment": lambda s, d: Q.alignment(reviews(s, d)).select("audio_file", "similarity", "reviewed_at", "layer", "code"),
        "review_rows": lambda s, d: Q.review_rows(reviews(s, d)),
        "anti_rejected": anti_rejected,
        "semi_exists": lambda s, d: Q.existing(metadata(s, d), reviews(s, d), "audio_file").select("row_id"),
        "anti_missing": lambda s, d: metadata(s, d).filter("audio_file IS NOT NULL").join(R.kept_paths(reviews(s, d)), "audio_file", "left_anti").select("row_id"),
        "split_union": split_union,
        "flagged_sample": flagged_sample,
        "nfc": _text_query(T.nfc),
        "clean_text": _text_query(T.clean),
        "corrected_words": _text_query(T.correct_words),
        "expanded_symbols": _text_query(T.expand_symbols),
        "comparable_text": _text_query(T.comparable),
        "stripped_text": _text_query(T.strip),
        "word_counts": _text_query(lambda c: F.size(T.words(c))),
        "sentences": lambda s, d: documents(s, d).filter("text IS NOT NULL").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")),
        "length_capped": length_capped,
        "derived_paths": derived_paths,
        "label_tails": lambda s, d: metadata(s, d).filter("text IS NOT NULL").select("row_id", T.label_tail(F.col("text")).alias("tail")),
        "emotion_counts": lambda s, d: files.with_emotion(metadata(s, d)).groupBy("emotion_name").agg(F.count(F.lit(1)).alias("n")),
        "key_overlay": key_overlay,
        "normalized_text": _text_query(T.normalize),
        "number_words": _text_query(T.expand_numbers),
        "seq_similarity": seq_similarity,
        "chunks": chunk_rows,
        "chunks_lite": chunk_rows_lite,
        "centroid_values": centroid_values,
        "cluster_scores": _stats,
        "cluster_share": cluster_share,
        "largest_clusters": lambda s, d: V.largest(cluster_share(s, d), "label", 5),
        "best_cluster": lambda s, d: V.best(_stats(s, d), "label"),
        "best_cluster_of_50": lambda s, d: V.best(_stats(s, d), "label", 50),
        "top_n_refine": top_n_refine,
        "top_n_refine_5000": lambda s, d: top_n_refine(s, d, V.REFINED),
        "top_per_cluster": top_per_cluster,
        "similarity_histogram": lambda s, d: A.histogram(scored(s, d), "similarity", 80),
        "kmeans_scores": lambda s, d: V.kmeans(embeddings(s, d), "embedding")[1],
        "kmeans_labels": lambda s, d: V.kmeans(embeddings(s, d), "embedding")[0].select("vec_id", "cluster_id"),
        "projection": lambda s, d: V.projected(embeddings(s, d), "embedding").select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")),
        "duration_histogram": lambda s, d: A.histogram(clips(s, d), "duration", 50),
        "split_rows": lambda s, d: A.split(documents(s, d).select("doc_id"), "doc_id").select("doc_id", "pos", "part"),
        "split_counts": split_counts,
        "sample_n": lambda s, d: A.sample(documents(s, d).select("doc_id", "source"), "doc_id", 100),
        "numbered_files": lambda s, d: A.numbered(range_filter(s, d).select("clip_id"), "clip_id"),
        "carried_forward": lambda s, d: A.carried_forward(events(s, d).withColumn("click", F.when(F.col("event_type") == "click", F.col("value"))), "click", ["ts", "event_id"], ["user_id"], "last_click").select("event_id", "last_click"),
        "moving_average": lambda s, d: A.moving_average(events(s, d), "value", ["ts", "event_id"], ["user_id"], 5, "average").select("event_id", F.round("average", 6).alias("average")),
        "wave_metrics": metrics,
        "frame_levels": frame_levels,
        "unit_vectors": unit_vectors,
        "corpus_selection": corpus_selection,
        "text_to_chunks": lambda s, d: pipelines.text_to_chunks(documents(s, d)),
        "formatted_dates": lambda s, d: metadata(s, d).select("row_id", F.date_format("recorded_at", "yyyy-MM-dd HH:mm").alias("day")),
        "stage_metrics": stage_metrics,
        "pauses_compressed": _edited(S.compress_pauses, most_ms=2, threshold=0.05),
        "tail_trimmed": _edited(S.trim_tail, keep_ms=1, threshold=0.05),
        "post_processed": _edited(S.post_process),
        "tapered": _edited(S.taper, ms=10),
        "overrun_trimmed": _edited(S.trim_overrun, expected_s=0.01),
        "clamped": clamped,
        "concatenated_waves": concatenated,
        **queries_files.queries(),
        "corpus_report": corpus_report,
        "distinct_counts": distinct_counts,
        "stage_report": stage_report,
        "rejection_listing": lambda s, d: Q.listed(_judged(s, d).rejected),
        "layer_counts": lambda s, d: _judged(s, d).issues,
        "clip_totals": lambda s, d: _judged(s, d).clip_totals,
        "kept_metadata": lambda s, d: _judged(s, d).kept.groupBy("origin").agg(F.count(F.lit(1)).alias("n")),
        "speaker_runs": speaker_runs,
        "pace_labels": pace_labels,
        "resampled": resampled,
        "embedded": embedded,
        "run_totals": lambda s, d: R.run_totals(runs(s, d)),
        "totals_by_setting": lambda s, d: R.totals_by_setting(runs(s, d)),
        "chunk_seeds": lambda s, d: R.chunk_rows(runs(s, d)),
        "daily_counts": lambda s, d: gates.counts(clips(s, d), "ingested_at"),
    }
