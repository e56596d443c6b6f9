"""Splits that keep related records together (problem 3).

Vertices are the entities that relate records (episode and speaker numbers), an
edge is a distinct pair of them that some record names, so a hot episode or
speaker is one vertex, not a group of rows. ``contract.components`` finds the
groups; ``assign_splits`` gives whole groups to the splits by cumulative weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.contract import components
from voxloom.operators.running import hashed_running, position
from voxloom.plans.blocks import dealt, hot_keys, repeated
from voxloom.plans.stash import stash, stash_measured

# The decimal digits of the three scripts that occur in names.
_DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９"
_DIGITS_TO = "0123456789" * 3
#: Default of ``big_share``, from which on a group is placed by itself.
BIG_SHARE = 0.001


def nth_number(col: Column, n: int) -> Column:
    """The n-th (0-based) run of digits of a name as a number, null where there is none.

    Runs too long for 60 bits are replaced by a hash of their digits without
    leading zeros, so equal numbers stay equal.
    """
    digits = F.try_element_at(F.regexp_extract_all(F.translate(col, _DIGITS_FROM, _DIGITS_TO), F.lit(r"([0-9]+)"), 1), F.lit(n + 1))
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    short = F.length(plain) <= 17
    return F.when(short, F.when(short, plain).cast("long")).when(
        plain.isNotNull(), F.lit(1 << 58) + position(plain) % F.lit(1 << 58)
    )


def _entities(records: DataFrame) -> DataFrame:
    """Adds ``ep`` and ``spk`` vertices (number * 4 + kind); speaker number 0 stands for nobody."""
    spk = nth_number(F.col("speaker_name"), 0)
    return records.select(
        "row_id",
        (nth_number(F.col("audio_file"), 0) * 4).alias("ep"),
        F.when(spk != 0, spk * 4 + 1).alias("spk"),
    )


class Related:
    """Groups of related records of a table with ``row_id``, ``audio_file`` and ``speaker_name``.

    Records are related through the same episode number (the first number of
    ``audio_file``) or the same speaker number, in any spelling, directly or
    through other records. Null, blank and number-free names, and speaker 0,
    relate nothing: such a record is a group of its own. Records with a null
    ``row_id`` relate others but have no row of their own; repeated rows count
    once, and a ``row_id`` with several names has the place of the smallest
    (all of them relate others). Other columns are ignored; an empty table gives
    empty results. A ``root`` is (0, entity) or, of a record by itself, (2, row_id).
    """

    def __init__(self, records: DataFrame):
        ent = stash(_entities(records.select("row_id", "audio_file", "speaker_name")))
        edges = ent.filter(F.col("ep").isNotNull() & F.col("spk").isNotNull()).select(F.col("ep").alias("a"), F.col("spk").alias("b"))
        roots = components(edges)
        self.rows = stash(ent.filter(F.col("row_id").isNotNull()).groupBy("row_id").agg(F.min(F.coalesce("ep", "spk")).alias("v")))
        entities = self.rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n"))
        root = F.struct(F.lit(0).alias("kind"), F.coalesce("root", "v").alias("id"))
        self.entities, seen = stash_measured(entities.join(roots, "v", "left").select("v", "first", "n", root.alias("root")), most=F.max("n"))
        single = self.rows.filter("v IS NULL").select(F.struct(F.lit(2).alias("kind"), F.col("row_id").alias("id")).alias("root"), F.col("row_id").alias("first_row_id"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("entities"))
        groups = self.entities.groupBy("root").agg(F.min("first").alias("first_row_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("entities")).unionByName(single)
        self.groups, widest = stash_measured(groups, most=F.max("entities"))
        self._hot_roots = hot_keys(self.groups, ["root"], count=F.col("entities"), most=widest["most"] or 0)
        self._hot_entities = hot_keys(self.entities, ["v"], count=F.col("n"), most=seen["most"] or 0)

    def labelled(self, values: DataFrame) -> DataFrame:
        """Every record (``row_id``) with the other columns of its group's row in ``values`` (by ``root``); hot groups and entities are dealt to blocks."""
        names = [c for c in values.columns if c != "root"]
        roots, entities = self._hot_roots, self._hot_entities
        of_entity = dealt(self.entities, ["root"], ["v"], roots, "block").join(repeated(values, ["root"], roots, "block"), ["root", "block"])
        named = dealt(self.rows.filter("v IS NOT NULL"), ["v"], ["row_id"], entities, "block").join(repeated(of_entity.select("v", *names), ["v"], entities, "block"), ["v", "block"])
        alone = values.filter("root.kind = 2").select(F.col("root.id").alias("row_id"), *names)
        return named.select("row_id", *names).unionByName(alone)

    def firsts(self) -> DataFrame:
        """One row for each record but the first of its group: ``first_row_id``, ``row_id``."""
        return self.labelled(self.groups.filter("n > 1").select("root", "first_row_id")).filter("row_id <> first_row_id").select("first_row_id", "row_id")


def assign_splits(spark: SparkSession, groups: DataFrame, targets: DataFrame, seed: int = 42, big_share: float = BIG_SHARE) -> DataFrame:
    """Gives every group a split: ``groups`` (``root``, ``n``, and more) with ``split``.

    ``targets`` (``split``, ``target_share``) is a table of a few rows; null or
    non-positive shares get nothing, the rest is scaled to 1. Groups of at least
    ``big_share`` of the records, at most 1/big_share of them whatever the size of
    the input, are placed largest first where most room is left: they would miss a
    cut by their whole weight. All others are laid out in a hash order, and their
    cumulative weight is cut at what the splits still lack, which misses a target
    by less than ``big_share`` per cut. With ``big_share`` above 1 all are laid out.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    shares = [(r[0], float(r[1])) for r in targets.select("split", "target_share").orderBy("split").collect() if r[0] is not None and r[1] and r[1] > 0]
    if not shares:
        raise ValueError("no split has a positive target share")
    scale = sum(s for _, s in shares)
    room = {k: s / scale * total for k, s in shares}
    limit = max(1, int(total * big_share))
    big = groups.filter(F.col("n") > limit).select("root", "n").orderBy(F.desc("n"), "root").collect()  # at most 1 / big_share rows
    placed = {}
    for r in big:
        best = max(room, key=lambda k: (room[k], k))
        room[best] -= r["n"]
        placed[tuple(r["root"])] = best
    laid = hashed_running(groups.filter(F.col("n") <= limit), [], ["root"], F.col("n"), seed)
    laid_total = total - sum(r["n"] for r in big)
    lacking = {k: max(0.0, v) for k, v in room.items()}
    scale = sum(lacking.values()) or 1.0
    cut, pick = 0.0, F.lit(shares[-1][0])
    bounds = []
    for k, _ in shares:
        cut += lacking[k] / scale * laid_total
        bounds.append((k, cut))
    mid = F.col("run_before") + F.col("n") / 2
    for k, at in reversed(bounds[:-1]):
        pick = F.when(mid < at, F.lit(k)).otherwise(pick)
    out = laid.select(*groups.columns, pick.alias("split"))
    if placed:
        kind = dict(groups.dtypes)["root"]
        table = spark.createDataFrame([(k, v) for k, v in placed.items()], f"root {kind}, split string")
        out = out.unionByName(groups.join(F.broadcast(table), "root").select(*groups.columns, "split"))  # at most 1 / big_share rows
    return out


def split_records(spark: SparkSession, records: DataFrame, targets: DataFrame, big_share: float = BIG_SHARE) -> DataFrame:
    """Every record with its new split: ``row_id``, ``first_row_id`` (smallest of its group), ``group_size``, ``assigned_split``."""
    related = Related(records)
    splits = assign_splits(spark, related.groups.drop("entities"), targets, big_share=big_share)
    return related.labelled(splits.withColumnsRenamed({"n": "group_size", "split": "assigned_split"})).select("row_id", "first_row_id", "group_size", "assigned_split")


def split_shares(spark: SparkSession, records: DataFrame, targets: DataFrame, big_share: float = BIG_SHARE) -> DataFrame:
    """Target and actual share per split: ``split``, ``target_share``, ``records``, ``groups``, ``actual_share``."""
    got = assign_splits(spark, Related(records).groups, targets, big_share=big_share).groupBy("split").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("groups"))
    total = got.agg(F.sum("records").alias("total"))
    return (
        targets.select("split", "target_share")
        .join(got, "split", "left")
        .join(F.broadcast(total))  # one row
        .select(
            "split",
            "target_share",
            F.coalesce("records", F.lit(0)).alias("records"),
            F.coalesce("groups", F.lit(0)).alias("groups"),
            F.round(F.coalesce("records", F.lit(0)) / F.col("total"), 6).alias("actual_share"),
        )
    )
