"""Queries over the test tables for the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import fold, looks, mixture, overlap, packing, splits, stuffing, voices
from voxloom.sources.tables import table


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metadata_eval")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _voices(spark: SparkSession, d: str) -> voices.Voices:
    return voices.Voices(table(spark, d, "prepare_dataset"))


def _mixture(spark: SparkSession, d: str) -> mixture.Mixture:
    return mixture.Mixture(spark, _documents(spark, d), table(spark, d, "source_weight"))


def p3_checked(s: SparkSession, d: str) -> DataFrame:
    """What must hold of the splits: every record has one, no group is torn, and the shares miss by 2 % of all records at most."""
    rows = splits.split_records(s, _metadata(s, d), table(s, d, "split_target"))
    torn = rows.groupBy("first_row_id").agg(F.min("assigned_split").alias("a"), F.max("assigned_split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("torn_groups"))
    got = rows.groupBy(F.col("assigned_split").alias("split")).agg(F.count(F.lit(1)).alias("n"))
    total = got.agg(F.sum("n").alias("records"))
    met = table(s, d, "split_target").join(got, "split", "left").join(F.broadcast(total)).agg(F.max(F.abs(F.coalesce("n", F.lit(0)) / F.col("records") - F.col("target_share"))).alias("miss"))
    return total.join(F.broadcast(torn)).join(F.broadcast(met)).select("records", "torn_groups", (F.col("miss") < 0.02).alias("shares_met"))  # one row each


def p6_checked(s: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing: every text is in it once and whole, no container is overfull, only longer texts are cut, and the containers are within 1 % (and one) of the least."""
    sizes = table(s, d, "container_size")
    rows = packing.packed(s, _documents(s, d), sizes)
    parts = rows.groupBy("container", "doc_id").agg(F.sum("tokens").alias("t"), F.max(F.col("start_token") + F.col("tokens")).alias("end"), F.count(F.lit(1)).alias("pieces")).join(F.broadcast(sizes), "container")  # three rows
    whole = parts.groupBy("container").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("t") != F.col("end")).alias("gaps"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("needless_cuts"))
    boxes = rows.groupBy("container", "box").agg(F.sum("tokens").alias("t")).join(F.broadcast(sizes), "container")
    least = F.ceil(F.sum("t") / F.first("capacity_tokens"))
    full = boxes.groupBy("container").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"), (F.count(F.lit(1)) <= least * 1.01 + 1).alias("tight"))
    return whole.join(full, "container").select("container", "documents", "overfull", "gaps", "needless_cuts", "tight")


def p7_checked(s: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture: no text more often than its source allows or from elsewhere, and shares as near the targets as whole texts allow.

    A source ends within half a text of its goal, and the total within the sum of these; three slots are left to the schedule.
    """
    m = _mixture(s, d)
    weights = table(s, d, "source_weight").filter("target_share > 0")
    used = m.rows().groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("tokens").alias("t"))
    used = used.join(_documents(s, d).select("doc_id", F.col("source").alias("own")), "doc_id").join(F.broadcast(weights), "source")  # a listed source a row
    got = used.groupBy("source").agg(F.count_if(F.col("k") > F.coalesce("max_repeat", F.lit(1))).alias("repeated_too_often"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("foreign_documents"), F.sum("t").alias("t"))
    half = m.sized.groupBy("source").agg((F.max("tokens") / 2).alias("half"))
    goal = s.createDataFrame(sorted(m.share.items()), "source string, goal double")
    each = got.join(half, "source").join(F.broadcast(goal), "source")  # a listed source a row
    sums = each.agg(F.sum("t").alias("all"), F.sum("half").alias("halves"))
    bound = (F.col("half") + F.col("goal") * F.col("halves") + 3 * m.slot) / F.col("all")
    met = F.abs(F.col("t") / F.col("all") - F.col("goal")) <= bound
    return each.join(F.broadcast(sums)).select("source", "repeated_too_often", "foreign_documents", met.alias("share_met"))  # one row


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: fold.copies_found(_metadata(s, d)),
        "p1_collapsed": lambda s, d: fold.collapsed(_metadata(s, d)),
        "p2_found": lambda s, d: _voices(s, d).found(),
        "p2_described": lambda s, d: _voices(s, d).described().withColumn("typical_clip_ids", F.array_join(F.col("typical_clip_ids").cast("array<string>"), ",")),
        "p3_found": lambda s, d: splits.Related(_metadata(s, d)).firsts(),
        "p3_split": lambda s, d: splits.split_records(s, _metadata(s, d), table(s, d, "split_target")),
        "p3_shares": lambda s, d: splits.split_shares(s, _metadata(s, d), table(s, d, "split_target")),
        "p3_checked": p3_checked,
        "p4_found": lambda s, d: looks.alike_found(_metadata(s, d)),
        "p4_normalized": lambda s, d: looks.normalized(_metadata(s, d)).select("row_id", "norm"),
        "p5_found": lambda s, d: overlap.Overlaps(_metadata(s, d)).found(),
        "p5_links": lambda s, d: overlap.Overlaps(_metadata(s, d)).records(),
        "p5_matches": lambda s, d: overlap.Overlaps(_metadata(s, d)).matches(),
        "p5_report": lambda s, d: overlap.Overlaps(_metadata(s, d)).report(),
        "p6_packed": lambda s, d: packing.packed(s, _documents(s, d), table(s, d, "container_size")),
        "p6_fill": lambda s, d: packing.fill_report(s, _documents(s, d), table(s, d, "container_size")),
        "p6_checked": p6_checked,
        "p7_mixture": lambda s, d: _mixture(s, d).rows(),
        "p7_shares": lambda s, d: _mixture(s, d).report(),
        "p7_checked": p7_checked,
        "p8_found": lambda s, d: stuffing.flagged(_documents(s, d)),
        "p8_shapes": lambda s, d: stuffing.shape_report(_documents(s, d)).withColumn("top_shapes", F.array_join("top_shapes", "; ")),
    }


def oracle_sql() -> dict[str, str]:
    from voxloom.llm.sql import statements

    return statements()
