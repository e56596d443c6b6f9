"""Keyword-stuffed and link-list pages (problem 8).

Every page is cut into lines, and these at sentence ends and at separators that
stand by themselves; each piece is reduced to a shape: classes of its word count,
of its share of capitalized words, of its separators and links per word, and of
the share of its words that repeat earlier ones. Nothing in a shape says whether
it is a sentence's: the shapes are grouped over the whole crawl, and the counts
tell. A shape is a sentence's if at least half of its pieces, wherever they stand,
close like one, and less than a third of their words are repetitions. A page is
flagged when more than half of its words stand in the few leading shapes that are
no sentences.

All of it is built-in expressions; there are at most ``SHAPES`` shapes, so their
table is small whatever the crawl.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.plans.stash import stash

#: Where the classes of a shape begin: words; capitalized, separators, links and repeated words per word.
CLASSES = {"words": (2, 5, 8, 16, 32, 64), "capitals": (0.01, 0.5), "separators": (0.2, 0.4), "links": (0.01, 0.25), "repeats": (0.15, 0.3)}
SHAPES = 7 * 3**4
#: Leading shapes of a page that count.
LEADING = 5
#: Least share of closed pieces, and the share of repeated words below which a sentence's shape stays.
CLOSED, REPEATED = 0.5, 0.33

_ENDS = ".!?؟。！？…"
_QUOTES = "\"'”»)"
#: A sentence end (not one of several exclamation marks) and the blanks after it, or a separator between blanks; both become line ends.
_CUT = rf"((?:[.?؟。？…]|(?<!!)!)[{_QUOTES}]{{0,2}})\s+|\s[;؛|/>»•·]\s+"
#: One closing mark, or three full stops; several exclamation marks are decoration.
_IS_CLOSED = rf"(?:(?<![{_ENDS}])[{_ENDS}]|(?<!\.)\.\.\.)[{_QUOTES}]{{0,2}}$"
#: A word with a scheme, a leading www, or a dot between a name and a lower-case ending; and what every such word holds.
_LINK = r"(?<!\S)(?=\S*?(?:://|www\.|[\p{L}\p{N}]\.\p{Ll}{2,}(?![\p{L}\p{N}])))\S+"
_MAY_LINK = r"[./][\p{Ll}/]"
#: Marks that part entries or decorate, rather than belong to sentences.
_SEPARATOR = r"[\p{P}\p{S}&&[^.!?؟。！？…:\"'’”“«»\-]]|!{2,}|\s[-–—]\s"
_WORD = r"([\p{L}\p{M}\p{N}'’]+|\x00)"


def _class(value: Column, name: str) -> Column:
    """How many of the class bounds the value reaches."""
    return sum((value >= bound).cast("int") for bound in CLASSES[name])


def shape_name(shape: Column) -> Column:
    """A shape spelled out, e.g. ``words2 capitals0 separators1 links2 repeats0`` (numbers of the classes)."""
    parts, rest = [], shape
    for name, bounds in reversed(CLASSES.items()):
        parts.insert(0, F.concat(F.lit(name), (rest % (len(bounds) + 1)).cast("string")))
        rest = F.floor(rest / (len(bounds) + 1))
    return F.concat_ws(" ", *parts)


def page_shapes(documents: DataFrame) -> DataFrame:
    """The shapes of every page: ``doc_id``, ``shape``, ``words``, ``pieces``, ``closed``, ``counted`` and ``repeated`` words.

    Null ids, null texts and texts without any letter have no row; pieces without
    any are left out. Repeated rows of a page count as one page.
    """
    rows = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.regexp_like("text", F.lit(r"\p{L}")))
    lines = F.split(F.regexp_replace("text", _CUT, "$1\n"), r"\n+")
    pieces = rows.select("doc_id", F.explode(lines).alias("piece")).select("doc_id", F.trim("piece").alias("piece")).filter(F.regexp_like("piece", F.lit(r"\p{L}")))
    # a link becomes one null character
    plain = pieces.withColumn("plain", F.when(F.regexp_like("piece", F.lit(_MAY_LINK)), F.regexp_replace("piece", _LINK, "\0")).otherwise(F.col("piece")))
    words = plain.withColumn("every", F.regexp_extract_all(F.lower("plain"), F.lit(_WORD), 1)).withColumn("w", F.array_remove("every", "\0"))
    size, counted = F.size("every"), F.size("w")
    counted = words.select("doc_id", "piece", "plain", size.alias("n"), counted.alias("counted"), (size - counted).alias("links"), (counted - F.size(F.array_distinct("w"))).alias("repeated"))
    n = F.col("n")
    ratios = {
        "words": n,
        "capitals": F.regexp_count("piece", F.lit(r"(?<!\S)\p{Lu}")) / n,
        "separators": F.regexp_count("plain", F.lit(_SEPARATOR)) / n,
        "links": F.col("links") / n,
        "repeats": F.when(F.col("counted") > 0, F.col("repeated") / F.col("counted")).otherwise(0.0),
    }
    measured = counted.select("doc_id", "n", "counted", "repeated", F.regexp_like(F.right("piece", F.lit(6)), F.lit(_IS_CLOSED)).alias("closed"), *[v.alias(k) for k, v in ratios.items()])
    shape = F.lit(0)
    for name, bounds in CLASSES.items():
        shape = shape * (len(bounds) + 1) + _class(F.col(name), name)
    return measured.groupBy("doc_id", shape.cast("int").alias("shape")).agg(
        F.sum("n").alias("words"), F.count(F.lit(1)).alias("pieces"), F.count_if("closed").alias("closed"), F.sum("counted").alias("counted"), F.sum("repeated").alias("repeated")
    )


def shape_counts(shapes: DataFrame) -> DataFrame:
    """The shapes of the crawl: ``shape``, ``pages``, ``pieces``, ``words``, ``closed`` and ``repeated`` (shares), ``sentence``; at most ``SHAPES`` rows."""
    counts = shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(c).alias(c) for c in ("pieces", "words", "closed", "counted", "repeated")])
    closed, repeated = F.col("closed") / F.col("pieces"), F.coalesce(F.try_divide("repeated", "counted"), F.lit(0.0))
    sentence = (closed >= CLOSED) & (repeated < REPEATED)
    return counts.select("shape", "pages", "pieces", "words", F.round(closed, 6).alias("closed"), F.round(repeated, 6).alias("repeated"), sentence.alias("sentence"))


def profiles(documents: DataFrame) -> DataFrame:
    """Shape profile of every page: ``doc_id``, ``words``, ``top_words`` (in its leading shapes that are no sentences), ``top_shapes``."""
    shapes = stash(page_shapes(documents))
    kinds = shape_counts(shapes).select("shape", "sentence")
    other = F.when(~F.col("sentence"), F.struct((-F.col("words")).alias("w"), F.col("shape").alias("shape")))
    pages = shapes.join(F.broadcast(kinds), "shape").groupBy("doc_id").agg(F.sum("words").alias("words"), F.slice(F.array_sort(F.collect_list(other)), 1, LEADING).alias("top"))  # at most SHAPES rows, here and in a page
    top = F.aggregate("top", F.lit(0).cast("long"), lambda a, s: a - s["w"])
    return pages.select("doc_id", "words", top.alias("top_words"), F.transform("top", lambda s: shape_name(s["shape"])).alias("top_shapes"))


def flagged(documents: DataFrame) -> DataFrame:
    """The pages dominated by few shapes that are no sentences: ``doc_id``; repeated pages count each."""
    return profiles(documents).filter("top_words * 2 > words").select("doc_id")


def shape_report(documents: DataFrame) -> DataFrame:
    """Flagged pages by their leading shapes: ``top_shapes``, ``pages``, ``words``."""
    hit = profiles(documents).filter("top_words * 2 > words")
    return hit.groupBy("top_shapes").agg(F.count(F.lit(1)).alias("pages"), F.sum("words").alias("words"))
