"""Related records, against union-find."""

import re

from pyspark.sql import functions as F

from voxloom.llm import contract, splits

ROWS = [
    (1, "wavs/ep001_0001.wav", "spk001"), (2, "EP1-2.flac", None), (3, "x/ep002_1.wav", "Speaker 1"), (4, "ep٣_1", "ｓｐｋ0"), (5, "ep4_1", "spk0"), (6, "ep5_1", "SPK٥"),
    (7, "ep000005_2", ""), (8, None, None), (9, None, "spk5 "), (10, "", "   "), (11, "no number", "spk"), (12, "ep3_9", "spk0000"), (13, "ep99999999999999999999_1", None), (14, "ep099999999999999999999_2", None),
]


def digits(x):
    return [int(n) for n in re.findall(r"\d+", x or "")]


def related(rows):
    keys = {}
    for i, a, s in rows:
        if digits(a):
            keys.setdefault(("e", digits(a)[0]), []).append(i)
        if digits(s) and digits(s)[0]:
            keys.setdefault(("s", digits(s)[0]), []).append(i)
    return [(v[0], x) for v in keys.values() for x in v[1:]]


def test_small_fixture(spark, brute_groups):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS] + [(None, "ep1_1", "spk7", "c"), (*ROWS[0], "clash")], "row_id long, audio_file string, speaker_name string, root string")
    want = {(f, i) for i, f in brute_groups([r[0] for r in ROWS], related(ROWS)).items() if f != i}
    assert {tuple(r) for r in splits.Related(df).firsts().collect()} == want
    assert splits.Related(df.limit(0)).firsts().count() == 0


def test_components_of_a_path_and_a_star(spark, brute_groups):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (3000, 3001), (3001, 3000)]
    got = contract.components(spark.createDataFrame([*pairs, (None, 7)], "a long, b long")).collect()
    rows = {x for p in pairs for x in p}
    root = {r["v"]: r["root"] for r in got}
    want = brute_groups(rows, pairs)
    assert len({(root.get(x, x), want[x]) for x in rows}) == len(set(want.values()))
    assert contract.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_keeps_groups_and_shares(spark):
    rows = spark.range(20000).select(F.col("id").alias("row_id"), F.format_string("ep%d_%d", (F.col("id") / 7).cast("int"), F.col("id")).alias("audio_file"), F.lit(None).cast("string").alias("speaker_name"))
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.5), ("none", 0.0)], "split string, target_share double")
    out = splits.split_records(spark, rows, targets)
    assert out.count() == 20000
    assert out.groupBy("first_row_id").agg(F.countDistinct("assigned_split").alias("k")).filter("k > 1").count() == 0
    share = {r["assigned_split"]: r["count"] / 20000 for r in out.groupBy("assigned_split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.002 and abs(share["test"] - 0.1) < 0.002 and set(share) == {"train", "validation", "test"}


def test_records_by_themselves_stay_apart(spark):
    """Unnamed records are told apart by their ids, not by a hash of them; a repeated row counts once."""
    rows = [(i * (1 << 40) - (1 << 62), None, "spk0") for i in range(300)]
    df = spark.createDataFrame(rows + rows[:5], "row_id long, audio_file string, speaker_name string")
    related = splits.Related(df)
    assert related.groups.count() == 300 and related.firsts().count() == 0


def test_hot_entities_are_dealt(spark, monkeypatch):
    from voxloom.plans import blocks

    monkeypatch.setattr(blocks, "BLOCK", 40)
    rows = [(i, f"ep{i % 7 if i % 3 else 1}_{i}", f"spk{i % 11 + 1}" if i % 2 else "spk1") for i in range(900)] + [(1000 + i, f"ep{100 + i}", f"spk{100 + i % 60}") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, audio_file string, speaker_name string")
    first = {r["row_id"]: r["first_row_id"] for r in splits.Related(df).firsts().collect()}
    assert all(first[i] == 0 for i in range(1, 900)) and all(first[1060 + i] == 1000 + i % 60 for i in range(140)) and len(first) == 899 + 140


def test_big_share_is_a_parameter(spark):
    groups = spark.createDataFrame([((0, i), 50 if i < 4 else 1) for i in range(804)], "root struct<kind:int,id:long>, n long")
    targets = spark.createDataFrame([("a", 0.7), ("b", 0.3)], "split string, target_share double")
    for big_share in (0.01, 2.0):
        out = splits.assign_splits(spark, groups, targets, big_share=big_share)
        share = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.sum("n").alias("n")).collect()}
        assert sum(share.values()) == 1000 and abs(share["a"] - 700) <= (2 if big_share < 1 else 50)
