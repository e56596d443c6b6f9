"""File sources and sinks: pipe-separated metadata, JSON, text, logs, waveforms, listings."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def file_system(path: str):
    """The Arrow file system of a path or URI (local, HDFS, object stores), and the path in it; for the driver and Python workers alike."""
    from pyarrow import fs

    if path.startswith("file:") and "://" not in path:
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


METADATA_SCHEMA = "audio_file string, text string, speaker_name string"


def read_metadata(spark: SparkSession, path: str, schema: str = METADATA_SCHEMA) -> DataFrame:
    """Pipe-separated metadata with a header; quotes are honoured, all fields are strings, missing labels stay null."""
    return spark.read.csv(path, sep="|", header=True, schema=schema, quote='"', escape='"', encoding="UTF-8", multiLine=False)


def write_metadata(df: DataFrame, path: str) -> None:
    """Header and unquoted values, byte for byte."""
    df.write.mode("overwrite").csv(path, sep="|", header=True, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")


def with_emotion(df: DataFrame, default: str = "neutral") -> DataFrame:
    """The optional label with its default."""
    return df.withColumn("emotion_name", F.coalesce("emotion_name", F.lit(default)) if "emotion_name" in df.columns else F.lit(default))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document per file; non-standard numbers are allowed."""
    r = spark.read.option("multiLine", True).option("allowNonNumericNumbers", True)
    return (r.schema(schema) if schema else r).json(path)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path``, ``text`` without white space at its ends."""
    from voxloom.functions.text import strip

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files in order: ``path``, ``line_no`` (0-based), ``line``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def loss_curve(lines: DataFrame) -> DataFrame:
    """Losses of a trainer log with the step they belong to: ``path``, ``line_no``, ``step``, ``loss``.

    Step lines are carried forward to the loss lines after them; loss lines
    before any step, at step 0, or with a bad number, are left out.
    """
    step = F.regexp_extract("line", r"GLOBAL_STEP:\s*(\d+)", 1).try_cast("long")
    is_loss = F.contains("line", F.lit("| > loss:")) & ~F.contains("line", F.lit("loss_text")) & ~F.contains("line", F.lit("loss_mel"))
    loss = F.regexp_extract("line", r"loss:\s*([-+0-9.eE]+)", 1).try_cast("double")
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"step": step, "loss": F.when(is_loss, loss)})
    return rows.withColumn("step", F.last("step", ignorenulls=True).over(w)).filter("loss IS NOT NULL AND step > 0").select("path", "line_no", "step", "loss")


def smoothed(curve: DataFrame) -> DataFrame:
    """Moving average of each curve of more than 20 points: width min(50, n div 5), full windows only."""
    w = Window.partitionBy("path").orderBy("line_no")
    n = F.count(F.lit(1)).over(Window.partitionBy("path"))
    rows = curve.withColumns({"n": n, "r": F.row_number().over(w)}).withColumn("width", F.least(F.lit(50), F.floor(F.col("n") / 5)).cast("int")).filter("n > 20")
    upto = F.sum("loss").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("all_upto", F.collect_list("upto").over(w.rowsBetween(-50, 0)))
    before = F.coalesce(F.try_element_at("all_upto", -(F.col("width") + 1)), F.lit(0.0))
    return rows.filter("r >= width").select("path", "step", ((F.col("upto") - before) / F.col("width")).alias("loss_average"))


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Files that match: ``path``, ``modified``, ``length``; contents aren't read."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return r.load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def latest(*listings: DataFrame) -> str | None:
    """The newest file of the first listing that has any (ties to the greatest path)."""
    for x in listings:
        top = x.agg(F.max_by("path", F.struct("modified", "path"))).first()[0]
        if top is not None:
            return top
    return None


def stem_suffix(path: Column, suffix: str) -> Column:
    """``a/b.wav`` to ``a/b<suffix>.wav``."""
    return F.regexp_replace(path, r"^(.*?)(\.[^./\\]+)?$", "$1" + suffix + "$2")


def stats_name(path: Column) -> Column:
    return F.regexp_replace(path, r"\.wav", "_stats.json")


def _decode(raw: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(raw)) as w:
        n, width, channels, rate = w.getnframes(), w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(n)
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / float(1 << 23)
    else:
        x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """Mono samples and rate of every WAV file: ``path``, ``samples``, ``rate``; unreadable files have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                try:
                    out.append(_decode(raw))
                except (wave.Error, EOFError, KeyError):
                    out.append((None, None))
            yield pd.DataFrame({"path": pdf["path"], "samples": [x for x, _ in out], "rate": pd.array([r for _, r in out], "Int32")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, samples array<double>, rate int")


def wav_durations(spark: SparkSession, path: str) -> DataFrame:
    """Seconds of every WAV file: ``path``, ``duration``. Only the chunk headers before the data are read; unreadable files have null."""

    def seconds(name: str) -> float | None:
        try:
            system, place = file_system(name)
            with system.open_input_file(place) as f, wave.open(f) as w:
                return w.getnframes() / w.getframerate()
        except (wave.Error, EOFError, OSError, ZeroDivisionError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(duration=pd.array([seconds(x) for x in pdf["path"]], "Float64"))

    return listing(spark, path, "*.wav", recursive=True).select("path").mapInPandas(run, "path string, duration double")


def write_wav(rows: DataFrame, folder: str, width: int = 2) -> None:
    """Writes ``file``, ``samples``, ``rate`` as mono PCM below a shared ``folder`` (path or URI), on the executors; null samples or rates are skipped."""
    scale = float((1 << (8 * width - 1)) - 1)

    def run(part) -> None:
        for r in part:
            x = np.clip(np.asarray(r["samples"], np.float64), -1, 1)
            ints = np.rint(x * scale).astype("<i4")
            body = io.BytesIO()
            with wave.open(body, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(width)
                w.setframerate(int(r["rate"]))
                w.writeframes(ints.view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
            _write(f"{folder}/{r['file']}", body.getvalue())

    rows.select("file", "samples", "rate").dropna().foreachPartition(run)


def _write(path: str, body: bytes) -> None:
    system, place = file_system(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as f:
        f.write(body)


def write_report(row: DataFrame, path: str) -> None:
    """The one row of a report as indented JSON below a path or URI, non-ASCII kept."""
    first = row.first()
    _write(path, json.dumps(first.asDict(recursive=True) if first else {}, indent=2, ensure_ascii=False, default=str).encode())


def write_review(rows: DataFrame, path: str) -> None:
    """The review listing, pipe-separated and sorted by clip."""
    write_metadata(rows.orderBy("audio_file", *[c for c in rows.columns if c != "audio_file"]), path)


def quarantine(rows: DataFrame, rejected: DataFrame, key: str, folder: str) -> None:
    """Writes kept and rejected rows to folders of their own; inputs are never changed."""
    keys = rejected.select(key).filter(F.col(key).isNotNull()).distinct()
    rows.join(keys, key, "left_anti").write.mode("overwrite").parquet(f"{folder}/kept")
    rows.join(keys, key, "left_semi").write.mode("overwrite").parquet(f"{folder}/rejected")
