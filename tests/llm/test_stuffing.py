"""Stuffed pages: kinds of stuffing among plain pages, and the hand labels."""

import duckdb
import pytest

from voxloom.llm import stuffing

PROSE = "The narrator read the chapter twice because the first take sounded rushed. We moved the microphone away from the wall and it stopped ringing. "
SPAM = [
    "#cheap_mic_a #buy_now_b #sale_c #cheap_mic_d #voice_over_e",
    "cheap mic best price " * 30,
    "\n".join(f"* [cheap mic {k}](https://x{k}.example/p/{k})" for k in range(9)),
    "\n".join(f"https://x{k}.test/p-{k}.html" for k in range(9)),
    ", ".join(["cheap mic", "headset", "best price", "buy now"] * 6),
    "\n".join(f"- headset ({k})" for k in range(12)),
    "\n".join(f"Brand{k} cheap set XLR {k}" for k in range(8)),
    " ; ".join(f"Brand{k} cheap set XLR {k}" for k in range(8)),
    "★ cheap mic cheap mic >>> CHEAP MIC!!! ★ cheap mic >>> ✔headset " * 4,
    PROSE + "\n" + "studio kit buy now buy now voice maker " * 20 + ".",
]
PLAIN = [PROSE, PROSE * 20, PROSE + "\n* https://a.example/p\n* https://b.example/q", PROSE + "\n#tag #mic", "\n".join(f"{k}. The narrator read the {w} chapter twice because it sounded rushed." for k, w in enumerate("abcdef")), "00:02 " + PROSE, "Title of a page\n" + PROSE]


@pytest.fixture(scope="module")
def crawl(spark):
    """The pages above among plain ones, as in any crawl."""
    rest = [(1000 + i, PROSE.replace("narrator", f"reader{i}"), "c") for i in range(20)]
    odd = [(100, None, "c"), (101, "", "c"), (102, "  \n ", "c"), (None, SPAM[0], "c"), (103, SPAM[0], "c"), (103, SPAM[0], "c"), (104, "12 ... 5", "c"), (105, "cheap mic, " * 100_000, "c")]
    return spark.createDataFrame([*((i, t, "c") for i, t in enumerate(SPAM + PLAIN)), *rest, *odd], "doc_id long, text string, words string")


def test_flagged(crawl):
    got = [r[0] for r in stuffing.flagged(crawl).collect()]
    assert sorted(got) == [*range(len(SPAM)), 103, 105]
    assert sum(r["pages"] for r in stuffing.shape_report(crawl).collect()) == len(got)
    assert stuffing.flagged(crawl.limit(0)).count() == 0


def test_shapes_are_grouped_over_all_pages(crawl):
    """What a shape is depends on the whole crawl: pieces that close like sentences everywhere make their shape a sentence's."""
    counts = stuffing.shape_counts(stuffing.page_shapes(crawl)).collect()
    assert 0 < len(counts) <= stuffing.SHAPES and any(r["sentence"] for r in counts) and not all(r["sentence"] for r in counts)
    one = "Read it once"
    alone = crawl.sparkSession.createDataFrame([(1, one)], "doc_id long, text string")
    among = alone.union(crawl.sparkSession.createDataFrame([(i, f"{one}.") for i in range(2, 5)], "doc_id long, text string"))
    assert stuffing.flagged(alone).count() == 1 and stuffing.flagged(among).count() == 0


def test_shape_names(spark):
    sizes = [len(b) + 1 for b in stuffing.CLASSES.values()]
    total = 1
    for n in sizes:
        total *= n
    names = [r[0] for r in spark.range(total).select(stuffing.shape_name(stuffing.F.col("id"))).collect()]
    assert total == stuffing.SHAPES == len(set(names)) and names[0].startswith("words0 capitals0")


def test_labels(spark):
    """Recall and precision against the hand labels that aren't contradicted; a few of the labels are wrong."""
    d = "/root/testdata/sf0.1"
    q = f"SELECT doc_id, max(is_spam) FROM '{d}/page_label.parquet' JOIN '{d}/documents.parquet' USING (doc_id) WHERE text IS NOT NULL AND is_spam IS NOT NULL GROUP BY doc_id HAVING min(is_spam) = max(is_spam)"
    labels = dict(duckdb.connect().execute(q).fetchall())
    got = {r[0] for r in stuffing.flagged(spark.read.parquet(f"{d}/documents.parquet")).collect()} & labels.keys()
    spam = {k for k, v in labels.items() if v}
    assert len(got & spam) / len(spam) > 0.9 and len(got & spam) / len(got) > 0.9  # 58 of 63 and of 59: the other labels are plainly wrong
    assert sum((k in got) == bool(v) for k, v in labels.items()) / len(labels) > 0.97
