"""Range filters and the layered quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.functions.signal import wave_metrics

DURATION, CHARS = (2.0, 11.0), (10, 200)
MIN_ARABIC, MAX_LATIN, RATE = 0.60, 3, (3.0, 25.0)
MIN_SNR, MAX_SILENT, MAX_CLIPPED, MIN_SIMILARITY = 10.0, 0.50, 0.01, 0.40

# Layer and code of every check, in the order in which the first failure counts.
CHECKS = [
    (1, "low_arabic"),
    (1, "latin_chars"),
    (1, "repeated_words"),
    (1, "bad_char_rate"),
    (2, "file_missing"),
    (2, "low_snr"),
    (2, "excess_silence"),
    (2, "clipping"),
    (3, "low_similarity"),
]


def with_defaults(clips: DataFrame) -> DataFrame:
    """Missing durations become samples / rate, missing texts the empty text."""
    computed = F.try_divide(F.size("audio.array").cast("double"), F.col("audio.sampling_rate").cast("double"))
    return clips.withColumns({"duration": F.coalesce("duration", F.when(F.col("audio.array").isNotNull(), computed)), "text": F.coalesce("text", F.lit(""))})


def in_range(clips: DataFrame, duration: tuple[float, float] = DURATION, chars: tuple[int, int] = CHARS) -> DataFrame:
    """Keeps usable durations and text lengths, bounds included; a null duration is dropped."""
    return clips.filter(F.col("duration").between(*duration) & F.length("text").between(*chars))


def trainer_bounds(clips: DataFrame, rate: int = 22050, most_samples: int = 255_995, chars: int = 200, least_s: float = 0.5) -> DataFrame:
    """The second profile: what a trainer accepts at its own sample rate."""
    return clips.filter((F.col("duration") >= least_s) & (F.col("duration") * rate <= most_samples) & (F.length("text") <= chars))


def _bad_rate(text: Column, duration: Column) -> Column:
    rate = F.length(text) / F.greatest(duration, F.lit(0.1))
    return (rate < RATE[0]) | (rate > RATE[1])


def text_metrics(text: Column) -> dict[str, Column]:
    return {"arabic_ratio": T.arabic_ratio(text), "latin_count": T.latin_count(text), "repeated": T.repeats_words(text)}


def text_code(duration: Column | None) -> Column:
    """The first failing check of layer 1 from the columns of ``text_metrics``; a null duration skips the rate."""
    code = F.when(F.col("arabic_ratio") < MIN_ARABIC, "low_arabic").when(F.col("latin_count") > MAX_LATIN, "latin_chars").when(F.col("repeated"), "repeated_words")
    return code if duration is None else code.when(duration.isNotNull() & _bad_rate(F.col("text"), duration), "bad_char_rate")


def signal_code() -> Column:
    """The first failing check of layer 2 from the column ``m`` (``wave_metrics``)."""
    m = F.col("m")
    return (
        F.when(m["samples"].isNull(), "file_missing")
        .when(m["snr_gate"] < MIN_SNR, "low_snr")
        .when(m["silence_ratio"] > MAX_SILENT, "excess_silence")
        .when(m["clipping_ratio"] > MAX_CLIPPED, "clipping")
    )


def gate(clips: DataFrame) -> DataFrame:
    """Every clip with its first rejection, cheap checks first: ``clip_id``, ``layer``, ``code``, ``reason`` (null if kept).

    One scan: layer 1 runs on columns, and rows that fail it hand a null array to
    the waveform metrics, so only its survivors are measured.
    """
    base = clips.withColumn("text", F.coalesce("text", F.lit("")))
    one = base.withColumns(text_metrics(F.col("text"))).withColumn("code1", text_code(F.col("duration")))
    two = one.withColumn("m", wave_metrics(F.when(F.col("code1").isNull(), F.col("audio.array")), F.col("audio.sampling_rate")))
    code = F.coalesce("code1", signal_code())
    judged = two.select("clip_id", "text", "duration", "arabic_ratio", "latin_count", code.alias("code"), F.when(F.col("code1").isNotNull(), 1).when(code.isNotNull(), 2).alias("layer"), *measured())
    return judged.select("clip_id", "layer", "code", reason().alias("reason"))


def measured() -> list[Column]:
    """The columns of ``m`` that reasons quote."""
    return [F.col(f"m.{a}").alias(b) for a, b in (("snr_gate", "snr"), ("silence_ratio", "sil"), ("clipping_ratio", "clip"))]


def _fixed(value: Column, places: int) -> Column:
    """A number with fixed places, rounded by its exact value (``format_string`` rounds its shortest decimal form)."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places if places else "0"))


def reason() -> Column:
    """The worded reason of a code, from the metric columns beside it."""
    c = F.col("code")
    rate = F.length("text") / F.greatest("duration", F.lit(0.1))

    def worded(before: str, value: Column, after: str) -> Column:
        return F.concat(F.lit(before), value, F.lit(after))

    return (
        F.when(c == "low_arabic", worded("Layer 1: Low Arabic ratio (", _fixed(F.col("arabic_ratio"), 2), ")"))
        .when(c == "latin_chars", worded("Layer 1: Latin characters (", F.col("latin_count").cast("string"), ")"))
        .when(c == "repeated_words", F.lit("Layer 1: Repeated words"))
        .when(c == "bad_char_rate", worded("Layer 1: Abnormal char rate (", _fixed(rate, 1), " c/s)"))
        .when(c == "file_missing", F.lit("Layer 2: File missing"))
        .when(c == "low_snr", worded("Layer 2: Low SNR (", _fixed(F.col("snr"), 1), " dB)"))
        .when(c == "excess_silence", worded("Layer 2: Excessive silence (", _fixed(F.col("sil") * 100, 0), "%)"))
        .when(c == "clipping", worded("Layer 2: Clipping (", _fixed(F.col("clip") * 100, 1), "%)"))
    )


def issue_counts(rejections: DataFrame) -> DataFrame:
    """Rejections per check, zero for checks that rejected nothing: ``layer``, ``code``, ``n``."""
    codes = rejections.sparkSession.createDataFrame(CHECKS, "layer int, code string")
    got = rejections.filter("code IS NOT NULL").groupBy("layer", "code").agg(F.count(F.lit(1)).alias("n"))
    return codes.join(got, ["layer", "code"], "left").select("layer", "code", F.coalesce("n", F.lit(0)).alias("n"))


def totals(rejections: DataFrame, unit: str | None = None) -> DataFrame:
    """Rows, rejected and kept, as counts and shares: one row. With ``unit``, its distinct values count, rejected if any of their rows is."""
    rejections = rejections if unit is None else rejections.groupBy(unit).agg(F.max("code").alias("code"))
    n, bad = F.count(F.lit(1)), F.count("code")
    return rejections.agg(n.alias("total"), bad.alias("rejected"), (n - bad).alias("kept"), F.round(F.try_divide(bad, n), 6).alias("rejected_share"))


def alignment(reviews: DataFrame, computed: bool = False) -> DataFrame:
    """Layer 3 over reviewed clips: adds ``code``, ``layer`` and the worded ``reason3``.

    A low similarity and a missing transcript are rejections of one code, told
    apart by their reasons. With ``computed``, ``similarity`` is worked out from
    the two texts instead of taken as stored.
    """
    rows = reviews.withColumn("similarity", F.round(T.similarity(F.col("original_text"), F.col("whisper_text")), 4)) if computed else reviews
    error = F.col("whisper_text").isNull() | F.col("similarity").isNull()
    code = F.when(error | (F.col("similarity") < MIN_SIMILARITY), "low_similarity")
    cut = [F.substring(F.coalesce(c, F.lit("")), 1, 50) for c in ("original_text", "whisper_text")]
    worded = F.when(error, F.lit("Layer 3: Whisper error (no transcript)")).otherwise(F.concat(F.lit("Layer 3: Low alignment ("), _fixed(F.col("similarity"), 2), F.lit(") | Original: "), cut[0], F.lit(" | Whisper: "), cut[1]))
    return rows.withColumns({"code": code, "layer": F.when(code.isNotNull(), 3), "reason3": F.when(code.isNotNull(), worded)})


def review_rows(reviews: DataFrame, computed: bool = False) -> DataFrame:
    """The listing of low alignments: texts cut to 50 characters, the similarity to two places; errors are left out."""
    low = alignment(reviews, computed).filter("code = 'low_similarity' AND whisper_text IS NOT NULL AND similarity IS NOT NULL")
    cut = [F.substring(c, 1, 50).alias(c) for c in ("original_text", "whisper_text")]
    return low.select("audio_file", *cut, _fixed(F.col("similarity"), 2).alias("similarity"), F.lit("REJECTED").alias("status"))


def listed(rejected: DataFrame) -> DataFrame:
    """The rejections sorted by clip."""
    return rejected.orderBy("audio_file")


def surviving(rows: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't rejected; a rejected key removes all its rows."""
    return rows.join(rejected.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def existing(rows: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return rows.join(listing.select(key).distinct(), key, "left_semi")
