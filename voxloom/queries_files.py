"""Queries over files: tables written by the sinks into the session's shared folder and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import signal as S
from voxloom.operators import quality as Q
from voxloom.plans.stash import shared_root
from voxloom.sources import files
from voxloom.sources.tables import table


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/voxloom-files-{uuid.uuid4().hex}"


def _field(name: str):
    """A column without the characters that the format can't hold, null as empty."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"[|\"\r\n\x00]", " ").alias(name)


def metadata_files(s, d):
    """Metadata through the pipe-separated files, the second write over the first."""
    folder = _folder(s)
    rows = table(s, d, "metadata_eval").select(F.col("row_id").cast("string").alias("row_id"), _field("audio_file"), _field("text"), _field("speaker_name"))
    for part in (rows.limit(0), rows):
        files.write_metadata(part, folder)
    back = files.read_metadata(s, folder, f"row_id string, {files.METADATA_SCHEMA}")
    return back.select(F.col("row_id").cast("long").alias("row_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("audio_file", "text", "speaker_name")])


def _source_files(s, d) -> str:
    folder = _folder(s)
    rows = table(s, d, "source_weight").filter("source IS NOT NULL").select("source", F.concat(F.lit(" \t"), F.col("max_repeat").cast("string"), F.lit("\n ")).alias("value"))
    rows.write.partitionBy("source").text(folder)
    return folder


def text_files(s, d):
    """Whole text files: one per source, blanks around its text."""
    back = files.read_whole_text(s, f"{_source_files(s, d)}/*/*.txt")
    return back.select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), "text")


def listed_files(s, d):
    """The listing of these files, and whether the newest is among them."""
    found = files.listing(s, _source_files(s, d), "*.txt", recursive=True)
    newest = files.latest(found.limit(0), found)
    return found.select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), "length", F.lit(newest is not None).alias("any"))


def _log(s, d) -> DataFrame:
    """A trainer log of the synthesis runs, one step each: its lines, read back."""
    folder = _folder(s)
    loss = F.coalesce(F.col("rtf").cast("string"), F.lit("n/a"))
    step = F.concat(F.lit("   --> TIME: x -- STEP: "), F.col("run_id").cast("string"), F.lit("/99 -- GLOBAL_STEP: "), F.col("run_id").cast("string"), F.lit("\x1b[0m"))
    lines = F.concat_ws("\n", step, F.lit("     | > loss_text: 0.5 (0.5)"), F.concat(F.lit("     | > loss: "), loss, F.lit("  (1.0)")), F.lit("     | > loss_mel: 0.5 (0.5)"))
    table(s, d, "generation_stats").orderBy("run_id").coalesce(1).select(lines.alias("value")).write.text(folder)
    return files.read_log(s, folder)


def trainer_log(s, d):
    return files.loss_curve(_log(s, d)).select("step", "loss")


def loss_average(s, d):
    return files.smoothed(files.loss_curve(_log(s, d))).select("step", F.round("loss_average", 6).alias("loss_average"))


def _wave_folder(s, d) -> str:
    folder = _folder(s)
    clips = table(s, d, "prepare_dataset").filter("size(audio.array) > 0 AND audio.sampling_rate > 0")
    files.write_wav(clips.select(F.format_string("wavs/clip_%d.wav", "clip_id").alias("file"), "audio.array", "audio.sampling_rate").toDF("file", "samples", "rate"), folder)
    return folder


def _clip(path: str = "path"):
    return F.regexp_extract(path, r"clip_(-?\d+)\.wav", 1).cast("long").alias("clip_id")


def wave_files(s, d):
    """Waves through 16-bit files."""
    back = files.read_wav(s, _wave_folder(s, d))
    level = F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.abs(x))
    return back.select(_clip(), F.size("samples").alias("samples"), "rate", F.round(level, 4).alias("level"))


def wave_file_durations(s, d):
    """Durations from the headers of the same files."""
    return files.wav_durations(s, _wave_folder(s, d)).select(_clip(), F.round("duration", 6).alias("duration"))


def report_file(s, d):
    """The gate's totals as a report file, written twice and read back."""
    path = f"{_folder(s)}/report.json"
    got = Q.totals(Q.gate(table(s, d, "prepare_dataset")))
    for row in (got.limit(0), got):
        files.write_report(row, path)
    return files.read_json(s, path, got.schema.simpleString()[7:-1].replace(":", " "))


def quarantined(s, d):
    """Kept and rejected metadata in folders of their own, counted."""
    folder = _folder(s)
    rows = table(s, d, "metadata_eval").select("row_id", "audio_file")
    files.quarantine(rows, Q.alignment(table(s, d, "sanity_review")).filter("code IS NOT NULL"), "audio_file", folder)
    return s.read.parquet(f"{folder}/kept").select("row_id", F.lit("kept").alias("place")).unionByName(s.read.parquet(f"{folder}/rejected").select("row_id", F.lit("rejected").alias("place")))


def review_file(s, d):
    """The review listing through its file."""
    path = _folder(s)
    rows = Q.review_rows(table(s, d, "sanity_review"))
    files.write_review(rows.select(*[_field(c) for c in rows.columns]), path)
    return files.read_metadata(s, path, "audio_file string, original_text string, whisper_text string, similarity string, status string").fillna("")


def metric_curve(s, d):
    """Chart data: power per frequency of every clip, means over its frames."""

    @F.pandas_udf("array<double>")
    def mean_power(a):
        import pandas as pd

        return pd.Series([None if x is None or len(x) == 0 else S.spectrogram(S.samples(x), 256, 128).mean(axis=0) for x in a])

    power = table(s, d, "prepare_dataset").select("clip_id", F.posexplode(mean_power("audio.array")).alias("bin", "power"))
    return power.select("clip_id", "bin", F.round("power", 5).alias("power"))


def queries() -> dict:
    return {f.__name__: f for f in (metadata_files, text_files, listed_files, trainer_log, loss_average, wave_files, wave_file_durations, report_file, quarantined, review_file)} | {"spectra": metric_curve}
