"""Totals over nested run records, and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.signal import samples

PAUSE_S, END_PAUSE_S = 0.4, 0.7


def run_totals(runs: DataFrame, pause: float = PAUSE_S, end_pause: float = END_PAUSE_S) -> DataFrame:
    """Totals of each run recomputed from its chunks: count, seconds with pauses, generation seconds and real-time factor."""
    chunks = F.coalesce("chunks", F.array().cast(dict(runs.dtypes)["chunks"]))
    total = lambda f: F.aggregate(chunks, F.lit(0.0), lambda s, c: s + F.coalesce(c[f], F.lit(0.0)))
    n = F.size(chunks)
    length = total("duration_s") + F.greatest(n - 1, F.lit(0)) * pause + F.when(n > 0, end_pause).otherwise(0.0)
    out = runs.select("run_id", n.alias("n_chunks"), length.alias("duration"), total("generation_time_s").alias("generation"))
    return out.select("run_id", "n_chunks", F.round("duration", 2).alias("duration_s"), F.round("generation", 2).alias("generation_s"), F.round(F.try_divide("generation", "duration"), 3).alias("rtf"))


def totals_by_setting(runs: DataFrame) -> DataFrame:
    """Runs, chunks, seconds and real-time factor per sampling setting, zero divisors guarded."""
    flat = runs.select(F.col("params.temperature").alias("temperature"), F.col("params.top_p").alias("top_p"), "num_chunks", "total_duration_s", "total_generation_time")
    return flat.groupBy("temperature", "top_p").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("num_chunks").alias("chunks"),
        F.round(F.sum("total_duration_s"), 2).alias("duration_s"),
        F.round(F.try_divide(F.sum("total_generation_time"), F.sum("total_duration_s")), 3).alias("rtf"),
    )


def chunk_rows(runs: DataFrame) -> DataFrame:
    """One row per chunk of every run with its seed: ``run_id``, ``index``, ``chars``, ``duration_s``, ``chunk_seed``."""
    c = runs.select("run_id", F.col("params.seed").alias("seed"), F.posexplode("chunks").alias("pos", "c"))
    return c.select("run_id", F.col("c.index").alias("index"), F.col("c.chars").alias("chars"), F.col("c.duration_s").alias("duration_s"), (F.col("seed") + F.col("pos")).alias("chunk_seed"))


#: The fields of the reports on upsampled files and on training runs.
UPSAMPLING_SCHEMA = "date string, results array<struct<input string, output string, input_sr int, output_sr int, bit_depth int, duration_s double, processing_time_s double>>"
TRAINING_SCHEMA = "date string, dataset string, train_clips int, eval_clips int, epochs int, batch_size int, grad_accum int, learning_rate double, training_hours double, output_path string, base_model string"


def stage_map(rows: DataFrame, stage: str, metrics: list[str]) -> DataFrame:
    """Rows of metrics per stage as one map: ``metrics``; a stage with several rows has their means, so the map grows with the stages only."""
    one = rows.filter(F.col(stage).isNotNull()).groupBy(stage).agg(*[F.avg(m).alias(m) for m in metrics])
    return one.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(stage), F.struct(*metrics))))).alias("metrics"))


def concatenated(parts: DataFrame, group: str, order: str, wave: str, rate: Column, pause: float = PAUSE_S, end_pause: float = END_PAUSE_S) -> DataFrame:
    """The parts of each group in order, pauses of silence between them and a longer one at the end: ``group``, ``wave``."""
    rows = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(wave).cast("array<double>").alias("w")))).alias("ws"), F.max(rate).alias("r"))
    gap = F.array_repeat(F.lit(0.0), F.floor(F.col("r") * pause).cast("int"))
    end = F.array_repeat(F.lit(0.0), F.floor(F.col("r") * end_pause).cast("int"))
    n = F.size("ws")
    joined = F.flatten(F.transform("ws", lambda x, i: F.concat(x["w"], F.when(i < n - 1, gap).otherwise(end))))
    return rows.select(group, joined.alias(wave))


def kept_paths(checked: DataFrame) -> DataFrame:
    """Distinct clips of a table, for existence probes."""
    return checked.select("audio_file").filter("audio_file IS NOT NULL").distinct()


def with_model(rows: DataFrame, fn: Callable[[list[np.ndarray], list[int]], list], wave: str, rate: str, key: str, schema: str) -> DataFrame:
    """Runs an injected batch model over waveforms: ``fn(samples, rates)`` gives one value per row, null waves none."""
    name = schema.split()[0]
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = pdf[pdf["w"].notna() & pdf["r"].notna()]
            values = fn([samples(w) for w in ok["w"]], ok["r"].astype(int).tolist())
            yield pd.DataFrame({key: ok[key], name: values})

    return rows.select(key, F.col(wave).alias("w"), F.col(rate).alias("r")).mapInPandas(run, f"{key} {kind}, {schema}")
