"""Copies hidden by formatting, against a parser that does build canonical texts."""

import re
import unicodedata
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import fold

KEYS = "tone|pace|take|mic|room|style"


def canonical(text):
    fields = frozenset()
    m = re.match(rf"\W*?((?:\[(?:{KEYS}): ?\w+\] ?)+|(?:(?:{KEYS})=\w+; ?)*(?:{KEYS})=\w+ ?::)", text, re.I)
    if m:
        text = text[m.end() :]
    else:
        m = re.search(rf"\|\|((?: ?(?:{KEYS})=\w+ ?\|?)+)$", text, re.I)
        if m:
            text = text[: m.start()]
    if m:
        fields = frozenset((a.lower(), b.lower()) for a, b in re.findall(rf"({KEYS})[:=] ?(\w+)", m[1], re.I))
    kept = "".join(c.lower() if unicodedata.category(c)[0] in "LNM" or unicodedata.category(c) == "Cf" else " " for c in text)
    return tuple(kept.split()), fields


TEXTS = [
    "سلام يا عالم", " سلام،  يا — عالم! ", "سلام يا​ عالم", "سَلام يا عالم", "سلام ياعالم",
    "[tone: warm] [mic: far] سلام يا عالم", "mic=far; tone=warm :: سلام يا عالم.", "سلام يا عالم || tone=WARM | mic=far", "سلام يا عالم || tone=warm",
    "tone mic far warm سلام", "", "...", "12", "Ab, aB", "AB AB", "ab ab ab", "[tone: warm]", "tone=warm ::", None, None, "é", "é",
]


def test_small_fixture(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1), (None, "Ab aB", "x", 1)]
    df = spark.createDataFrame(rows, "row_id long, text string, key string, h1 int")  # clashing names, a repeated row, a null id
    want = defaultdict(list)
    for i, t in enumerate(TEXTS):
        if t and any(unicodedata.category(c)[0] in "LN" for c in t):
            want[canonical(t)].append(i)
    got = {(r["first_row_id"], r["row_id"]) for r in fold.copy_groups(df).collect()}
    assert got == {(min(v), x) for v in want.values() for x in v}
    assert sorted(r["copies"] for r in fold.collapsed(df).collect()) == sorted(map(len, want.values()))
    assert fold.copies_found(df.limit(0)).count() == 0


def test_collision_is_resolved(spark, monkeypatch):
    """With a hash that always collides, the comparison alone still gives the groups."""
    from voxloom.llm import fold as module

    def collide(keys):
        def run(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.DataFrame({"row_id": pdf["row_id"], "h1": 1, "h2": 2})

        return run

    monkeypatch.setattr(module, "_hashed", collide)
    df = spark.createDataFrame([(1, "a b"), (2, "A, b"), (3, "c"), (4, "C!"), (5, "d")], "row_id long, text string")
    assert {tuple(r) for r in module.copies_found(df).collect()} == {(1, 2), (3, 4)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB ،.​é", max_size=12), st.text(alphabet="Ab ,!​É", max_size=12))
def test_hash_agrees_with_pointers(a, b):
    h1, h2, _ = fold.signatures([a, b])
    assert fold.same_words([a], [b])[0] == (canonical(a)[0] == canonical(b)[0]) == (h1[0] == h1[1] and h2[0] == h2[1])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aB ,é", max_size=5), st.text(alphabet="Ab ,É", max_size=5)), max_size=8))
def test_comparison_of_a_batch(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert fold.same_words(a, b).tolist() == [canonical(x)[0] == canonical(y)[0] for x, y in pairs]


def test_repeated_rows_count_once(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "A, b!"), (2, "A, b!"), (3, "c"), (4, "a B"), (4, "other")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    found = [tuple(r) for r in fold.copies_found(df).collect()]
    assert sorted(x for x in found if x[1] != 4) == [(1, 2)] and len(found) == len(set(found)) <= 2
    copies = {r["row_id"]: r["copies"] for r in fold.collapsed(df).collect()}
    assert sum(copies.values()) == 4 and copies[3] == 1


def test_field_keys_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "[who: x] a"), (2, "who=X :: A"), (3, "who x a"), (4, "[mic: x] a")], "row_id long, text string")
    assert {tuple(r) for r in fold.copies_found(df, ("who",)).collect()} == {(1, 2)}
    assert {tuple(r) for r in fold.copies_found(df, ()).collect()} == {(1, 2), (1, 3)}


def test_very_long_text():
    long = "word " * 200_000
    h1, _, _ = fold.signatures([long, long.upper() + "!", long + "x"])
    assert h1[0] == h1[1] != h1[2]


def test_hot_group(spark, monkeypatch):
    from pyspark.sql import functions as F

    from voxloom.plans import blocks

    monkeypatch.setattr(blocks, "BLOCK", 50)

    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("hot text"), F.repeat(F.lit("!"), (F.col("id") % 5).cast("int")))).otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    assert fold.copies_found(df).count() == 999
