"""The stages put together: corpus build, quality gate, text to chunks, evaluation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.functions.signal import wave_metrics
from voxloom.operators import arrange as A
from voxloom.operators import quality as Q
from voxloom.operators import reports as R
from voxloom.operators import vectors as V
from voxloom.plans.stash import stash
from voxloom.sources import files


@dataclass
class Corpus:
    """What the corpus build selects: scored members, cluster statistics, the numbered and split export, a one-row report."""

    scored: DataFrame
    stats: DataFrame
    export: DataFrame
    report: DataFrame

    def write(self, folder: str) -> None:
        """One pipe-separated file set per part, and the report."""
        for part in ("train", "eval"):
            files.write_metadata(self.export.filter(F.col("part") == part).select(F.col("file").alias("audio_file"), "text", "speaker_name"), f"{folder}/metadata_{part}")
        self.report.write.mode("overwrite").json(f"{folder}/report")


def build_corpus(clips: DataFrame, vectors: DataFrame, top_n: int | None = None, least: int = V.MIN_CLUSTER, eval_share: float = 0.1, speaker: str = "spk0") -> Corpus:
    """Range filter, cluster scoring, selection, numbering and split.

    ``vectors`` has ``clip_id``, ``embedding`` and ``cluster``. Without ``top_n``
    the most consistent cluster of at least ``least`` clips is taken (or the
    largest); with it, the ``top_n`` clips nearest the centroid of the largest.
    """
    usable = Q.in_range(Q.with_defaults(clips)).select("clip_id", "text", "duration")
    scored = stash(V.similarities(usable.join(vectors, "clip_id"), "cluster", "embedding").drop("embedding"))
    stats = V.cluster_stats(scored, "cluster")
    chosen = (V.best(stats, "cluster", least) if top_n is None else V.largest(stats, "cluster")).select("cluster")
    members = scored.join(chosen, "cluster", "left_semi")
    if top_n is not None:
        members = V.top_n(members, top_n, "clip_id")
    members = stash(members)
    named = A.numbered(members, "clip_id").withColumns({"text": T.strip(F.col("text")), "speaker_name": F.lit(speaker)})
    export = A.split(named, "clip_id", eval_share)
    sizes = members.agg(
        F.count(F.lit(1)).alias("clips"),
        F.round(F.sum("duration") / 3600, 2).alias("total_hours"),
        F.round(F.avg("duration"), 2).alias("mean_duration_s"),
        *[F.round(f(F.col("similarity")), 4).alias(f"similarity_{n}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
    )
    valid = usable.agg(F.count(F.lit(1)).alias("valid_after_filtering"))
    return Corpus(scored, stats, export, valid.join(F.broadcast(sizes)))  # one row each


@dataclass
class Gated:
    """Rejections (``audio_file``, ``layer``, ``code``, ``reason``), kept rows, counts per check, totals of rows and of clips."""

    rejected: DataFrame
    kept: DataFrame
    issues: DataFrame
    totals: DataFrame
    clip_totals: DataFrame


def quality_gate(train: DataFrame, evaluation: DataFrame, waves: DataFrame | None, reviews: DataFrame, computed: bool = False) -> Gated:
    """Three layers over both splits of metadata, each only on what the layers before it leave.

    ``waves`` (``audio_file``, ``samples``, ``rate``) and ``reviews`` are looked up
    by ``audio_file``; a clip with several waves or reviews fails if one does, a
    clip without a review passes. Without ``waves`` the second layer is left out.
    ``computed`` similarities are worked out from the texts. A clip is rejected by
    its first failing layer; all rows that name it go. Rows without an
    ``audio_file`` are no clip and are kept. Inputs are left as they are.
    """
    rows = train.withColumn("origin", F.lit("train")).unionByName(evaluation.withColumn("origin", F.lit("eval")))
    named = rows.filter(F.col("audio_file").isNotNull())
    text = named.select("audio_file", F.coalesce("text", F.lit("")).alias("text")).withColumns(Q.text_metrics(F.col("text")))
    nothing = [F.lit(None).cast("double").alias(x) for x in ("duration", "snr", "sil", "clip")]
    one = text.select("*", *nothing).withColumn("code", Q.text_code(None)).withColumn("reason", Q.reason())
    failed = [_first(one, 1)]
    clips = stash(Q.surviving(named.select("audio_file").distinct(), failed[0], "audio_file"))
    if waves is not None:
        # the rate check of layer 1 needs a duration, so it comes with the waves, before the signal checks
        texts = text.join(clips, "audio_file", "left_semi")
        heard = waves.join(clips, "audio_file", "left_semi").select("audio_file", wave_metrics("samples", "rate").alias("m"))
        both = texts.join(heard, "audio_file", "left").withColumn("duration", F.col("m.duration_s")).select("*", *Q.measured())
        early = Q.text_code(F.col("duration"))
        judged = both.withColumns({"layer": F.when(early.isNotNull(), 1).otherwise(2), "code": F.coalesce(early, Q.signal_code())}).withColumn("reason", Q.reason())
        failed.append(_first(judged, None))
        clips = stash(Q.surviving(clips, failed[1], "audio_file"))
    heard = Q.alignment(reviews.join(clips, "audio_file", "left_semi"), computed)
    failed.append(_first(heard.withColumn("reason", F.col("reason3")), 3))
    rejected = reduce(DataFrame.unionByName, failed)
    judged = rows.select("audio_file").join(rejected, "audio_file", "left")
    return Gated(rejected, Q.surviving(rows, rejected, "audio_file"), Q.issue_counts(rejected), Q.totals(judged), Q.totals(judged.filter("audio_file IS NOT NULL"), "audio_file"))


def _first(judged: DataFrame, layer: int | None) -> DataFrame:
    """The rejections of a layer, one per clip: the least code, and its least reason."""
    at = F.col("layer") if layer is None else F.lit(layer)
    order = F.struct(at.alias("layer"), F.col("code"), F.col("reason"))
    return stash(judged.filter("code IS NOT NULL").groupBy("audio_file").agg(F.min(order).alias("x")).select("audio_file", "x.layer", "x.code", "x.reason"))


def text_to_chunks(documents: DataFrame, seed: int = 12345, lite: bool = False) -> DataFrame:
    """Normalized texts in bounded chunks, each with its own seed: ``doc_id``, ``pos``, ``chunk``, ``chars``, ``chunk_seed``."""
    rows = documents.filter(F.col("text").isNotNull()).select("doc_id", T.normalize(F.col("text"), lite).alias("text"))
    cut = rows.select("doc_id", F.posexplode(T.chunks(F.col("text"), lite)).alias("pos", "chunk"))
    return cut.withColumns({"chars": F.length("chunk"), "chunk_seed": F.col("pos") + F.lit(seed)})


def evaluation(waves: DataFrame) -> DataFrame:
    """Metrics of each stage's wave (``stage``, ``samples``, ``rate``) as one map; stages without a wave are left out."""
    names = ("duration_s", "rms", "peak", "snr_eval", "silence_ratio", "speaking_s")
    m = waves.select("stage", wave_metrics("samples", "rate").alias("m")).filter("m.samples IS NOT NULL")
    return R.stage_map(m.select("stage", *[F.round(f"m.{n}", 6).alias(n) for n in names]), "stage", list(names))
