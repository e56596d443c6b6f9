"""Look-alike pairs, against comparing every pair of forms."""

import itertools

import pytest

from voxloom.llm import looks

SAME = [
    ("café", "café"), ("file", "ﬁle"), ("abc 12", "ａｂｃ　１２"), ("co", "сο"), ("كتاب", "ﻛﺘﺎب"), ("سلام", "سﻻم"), ("أهلا", "أهلا"), ("بَّ", "بَّ"),
    ("a b", "a b"), ("xy", "x​y"), ("١٢", "۱۲"), ("يكون", "یکون"), ("éa", "еа́".replace("е", "é").replace("а́", "a")),
]
DIFFERENT = [("a b", "a  b"), ("a", "A"), ("a", "a."), ("كتب", "كَتب"), ("4", "٤"), ("a b", "ab"), ("ه", "ة"), ("a\tb", "a b"), ("ى", "ي")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    one = looks.rewriter({})
    assert one(a) == one(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    one = looks.rewriter({})
    assert one(a) != one(b)


def test_classes_are_transitive():
    members = [m for c in looks.alike_classes() for m in c]
    assert len(members) == len(set(members))
    assert any({"o", "о", "ο", "ｏ"} <= set(c) for c in looks.alike_classes())


def test_frequent_member_represents(spark):
    df = spark.createDataFrame([("ооооо o",), (None,)], "text string")
    reps = looks.representatives(df)
    one = looks.rewriter(reps)
    assert one("o") == "о" and one("ooｏ") == "ооо"
    assert one("ﬁ") == one("fi")


def test_found(spark):
    texts = [t for p in SAME + DIFFERENT for t in p] + ["", None, "...", "​", "café", "café"]
    rows = [(i, t, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0], (None, "cafe", "c")], "row_id long, text string, form string")
    one = looks.rewriter(looks.representatives(df))
    ok = [(i, t) for i, t, _ in rows if t and any(map(str.isalnum, t))]
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(ok, 2) if a != b and one(a) == one(b)}
    got = [tuple(r) for r in looks.alike_found(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert looks.alike_found(df.limit(0)).count() == 0
    assert looks.normalized(df).filter("text IS NULL AND norm IS NULL").count() == 1


@pytest.mark.parametrize("a,b", [("vv", "νѵ"), ("Bold 1", "\U0001d401\U0001d428\U0001d425\U0001d41d \U0001d7cf"), ("script", "\U0001d4c8\U0001d4b8\U0001d4c7\U0001d4be\U0001d4c5\U0001d4c9"), ("ABC", "\u13aa\u13f4\u13df"), ("So", "Տօ"), ("xl", "ⅹⅼ"), ("VIII", "Ⅷ"), ("go", "ɡо"), ("ij", "ĳ"), ("FTW", "ꓝꓔꓪ")])
def test_all_planes_and_kinds(a, b):
    one = looks.rewriter({})
    assert one(a) == one(b)


@pytest.mark.parametrize("a,b", [("a", "ⓐ"), ("2", "²"), ("s", "ſ"), ("1", "①"), ("θ", "ϑ")])
def test_visibly_different_forms(a, b):
    one = looks.rewriter({})
    assert one(a) != one(b)


def test_frequent_member_that_is_not_the_first(spark):
    """The class of o: the Cyrillic letter is the most frequent, so all others become it, and pairs are found all the same."""
    df = spark.createDataFrame([(1, "хоро"), (2, "xopo"), (3, "оооо"), (4, "ｏ"), (5, "о")], "row_id long, text string")
    assert looks.representatives(df)["O".lower()] == "о"
    forms = {r["row_id"]: r["norm"] for r in looks.normalized(df).collect()}
    assert forms[1] == forms[2] and forms[4] == forms[5] == "о"
    assert {tuple(r) for r in looks.alike_found(df).collect()} == {(1, 2), (4, 5)}


def test_frequent_texts_are_dealt(spark, monkeypatch):
    from voxloom.plans import blocks

    monkeypatch.setattr(blocks, "BLOCK", 20)
    rows = [(i, "co" if i % 3 else "cо") for i in range(120)]
    got = {tuple(r) for r in looks.alike_found(spark.createDataFrame(rows, "row_id long, text string")).collect()}
    assert got == {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if a != b}


def test_identical_texts_never_meet(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") == 7, "hоt").otherwise("hot").alias("text"))
    assert looks.alike_found(df).count() == 4999


def test_long_text():
    assert len(looks.rewriter({})("سﻻم " * 100_000)) == 500_000
