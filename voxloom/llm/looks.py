"""Visually identical text with different characters (problem 4).

Look-alikes are given as pairs of strings: rule-made ones (full-width, mathematical,
presentation and ligature forms of all planes, taken from the Unicode
decompositions) and a list of letters that different scripts draw alike. Union-find over these
strings and code points makes the pairs transitive; in each class the member that
the corpus uses most stands for all. A multi-pattern automaton then rewrites every
text greedily, longest member first, between a decomposition before and a
composition after it that settle the order of marks. Blanks become the plain
space one for one, and invisible characters go.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.fold import categories
from voxloom.plans.blocks import meet
from voxloom.plans.stash import stash

# Letters that are drawn alike, one group per line of the string.
ALIKE = """
A Α А Ꭺ ꓮ
B Β В Ᏼ ꓐ
C Ϲ С Ꮯ ꓚ
D Ꭰ ꓓ
E Ε Е Ꭼ ꓰ
F Ϝ ꓝ
G Ꮐ ꓖ
H Η Н Ꮋ ꓧ
I Ι І ꓲ
J Ϳ Ј Ꭻ ꓙ
K Κ К Ꮶ ꓗ
L Ꮮ ꓡ
M Μ М Ꮇ ꓟ
N Ν ꓠ
O Ο О Օ ꓳ
P Ρ Р Ꮲ ꓑ
R Ꭱ ꓣ
S Ѕ Տ Ꮪ ꓢ
T Τ Т Ꭲ ꓔ
U Ս ꓴ
V Ѵ Ꮩ ꓦ
W Ԝ Ꮃ ꓪ
X Χ Х ꓫ
Y Υ Ү Ꮍ ꓬ
Z Ζ Ꮓ ꓜ
a а
c с ϲ
d ԁ
e е
g ɡ ց
h һ հ
i і
j ј ϳ
n ո
o ο о օ
p р
q ԛ
s ѕ
u ս
v ν ѵ
w ԝ
x х
y у ү
ك ک
ي ی
ه ہ
٠ ۰
١ ۱
٢ ۲
٣ ۳
٧ ۷
٨ ۸
٩ ۹
"""
#: Kinds of Unicode decomposition that change the drawing form only. Circled, raised, lowered, squared and fraction forms look different.
_FORMS = ("<font>", "<wide>", "<narrow>", "<small>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>")
#: Where such forms may be: beyond are ideographs, Hangul syllables and private use, which have none.
_WITH_FORMS = (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000))
#: Letters whose compatibility form is drawn otherwise: long s, Greek symbols.
_OTHERWISE = {0x17F, 0x1E9B, *range(0x3D0, 0x3FA)}


def _nfd(s: str) -> str:
    return unicodedata.normalize("NFD", s)


@lru_cache(maxsize=1)
def alike_pairs() -> list[tuple[str, str]]:
    """All given pairs of look-alike strings, decomposed."""
    pairs = []
    for line in ALIKE.split("\n"):
        first, *rest = line.split() or [""]
        pairs += [(first, x) for x in rest]
    for c in (x for r in _WITH_FORMS for x in r):
        ch = chr(c)
        kind, _, points = unicodedata.decomposition(ch).partition(" ")
        if not kind.startswith("<") or unicodedata.category(ch) == "Zs":
            continue
        target = unicodedata.normalize("NFKD", "".join(chr(int(p, 16)) for p in points.split()))
        # ligatures, digraphs, Roman numerals: letters that are drawn as the letters they consist of
        spelled = kind == "<compat>" and target.isalpha() and unicodedata.category(ch) in ("Ll", "Lu", "Lt", "Lo", "Nl") and c not in _OTHERWISE
        if (kind in _FORMS or spelled) and not target[0].isspace():
            pairs.append((_nfd(target), ch))
    return pairs


@lru_cache(maxsize=1)
def alike_classes() -> list[list[str]]:
    """The transitive look-alike classes, by union-find over strings and code points."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in alike_pairs():
        parent[find(b)] = find(a)
    classes: dict[str, list[str]] = {}
    for x in sorted(parent):
        classes.setdefault(find(x), []).append(x)
    return sorted(classes.values())


_SKIP = 0xFFFFFFFF


@lru_cache(maxsize=1)
def _base_table() -> np.ndarray:
    """For each code point: itself, the plain space for any other single blank, or ``_SKIP`` for what draws nothing.

    Format characters and variation selectors draw nothing, a few format characters excepted.
    """
    cat = categories()
    out = np.arange(0x110000, dtype=np.uint32)
    out[cat == "Zs"] = 32
    out[cat == "Cf"] = _SKIP
    drawn = [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD]
    out[drawn] = drawn
    for lo, hi in ((0x34F, 0x350), (0x115F, 0x1161), (0x3164, 0x3165), (0xFFA0, 0xFFA1), (0x180B, 0x1810), (0xFE00, 0xFE10), (0xE0100, 0xE01F0)):
        out[lo:hi] = _SKIP
    return out


def _mapped(joined: str, table: np.ndarray) -> np.ndarray:
    raw = table[np.frombuffer(_nfd(joined).encode("utf-32-le", "surrogatepass"), np.uint32)]
    return raw[raw != _SKIP]


class Rewriter:
    """Brings texts to one form with a given representative per class.

    Classes of single code points are rewritten first, so that the longer
    members, spelled in representatives themselves, match whatever their letters
    were stored as; the automaton then takes the longest member at each place. A
    batch of texts is one string, cut again at its null characters.
    """

    def __init__(self, representatives: dict[str, str]):
        import ahocorasick

        single: dict[int, str] = {}
        several = []
        for members in alike_classes():
            rep = representatives.get(members[0], members[0])
            if all(len(m) == 1 for m in members):
                single |= {ord(m): rep for m in members if m != rep}
            else:
                several.append((rep, members))
        self._table = _base_table().copy()
        for c, rep in single.items():
            self._table[c] = ord(rep)
        self._automaton = ahocorasick.Automaton()
        for rep, members in several:
            target = rep.translate(single)
            for m in {m.translate(single) for m in members} - {target}:
                self._automaton.add_word(m, (len(m), target))
        self._automaton.make_automaton()
        self._starts = re.compile("[" + "".join(re.escape(x) for x in sorted({k[0] for k in self._automaton.keys()})) + "]")

    def __call__(self, text: str) -> str:
        return self._forms(text)

    def many(self, texts: list[str]) -> list[str]:
        """The forms of a batch of texts."""
        if any("\0" in t for t in texts):
            return [self._forms(t) for t in texts]
        return self._forms("\0".join(texts)).split("\0") if texts else []

    def _forms(self, joined: str) -> str:
        out = _mapped(joined, self._table).tobytes().decode("utf-32-le", "surrogatepass")
        if self._starts.search(out):
            out = "\0".join(self._rewrite(x) if self._starts.search(x) else x for x in out.split("\0"))
        return unicodedata.normalize("NFC", out)

    def _rewrite(self, text: str) -> str:
        parts, at = [], 0
        for end, (size, rep) in self._automaton.iter_long(text):
            parts += (text[at : end - size + 1], rep)
            at = end + 1
        return "".join([*parts, text[at:]])


def _count_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts = np.bincount(_mapped("\0".join(pdf["text"]), _base_table()), minlength=1)
        points = np.flatnonzero(counts)
        points = points[points > 0]
        yield pd.DataFrame({"member": [chr(p) for p in points], "n": counts[points]})


def _count_strings(members: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            joined = _mapped("\0".join(pdf["text"]), _base_table()).tobytes().decode("utf-32-le", "surrogatepass")
            yield pd.DataFrame({"member": members, "n": [joined.count(m) for m in members]})

    return run


def representatives(texts: DataFrame, column: str = "text") -> dict[str, str]:
    """The most frequent member of each look-alike class over all texts, keyed by the class's first member.

    Only counts of code points, at most as many as Unicode has, and of the
    multi-character members whose ligature occurs reach the driver. Ties go to
    the smaller string; a class that does not occur keeps its first member.
    """
    t = texts.select(F.col(column).alias("text")).filter(F.col("text").isNotNull())
    single = t.mapInPandas(_count_points, "member string, n long")
    counts = {r["member"]: r["n"] for r in single.groupBy("member").agg(F.sum("n").alias("n")).collect()}
    strings = sorted({m for c in alike_classes() if any(len(x) == 1 and counts.get(x) for x in c) for m in c if len(m) > 1})
    if strings:
        more = t.mapInPandas(_count_strings(strings), "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))
        counts |= {r["member"]: r["n"] for r in more.collect()}
    out = {}
    for members in alike_classes():
        best = min(members, key=lambda m: (-counts.get(m, 0), m))
        if counts.get(best, 0) and best != members[0]:
            out[members[0]] = best
    return out


_REWRITERS: dict[tuple, Rewriter] = {}


def rewriter(reps: dict[str, str]) -> Rewriter:
    """One rewriter per process and set of representatives."""
    key = tuple(sorted(reps.items()))
    if key not in _REWRITERS:
        _REWRITERS[key] = Rewriter(reps)
    return _REWRITERS[key]


def _normalizer(reps: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = rewriter(reps)
        for pdf in batches:
            yield pdf.assign(norm=one.many(pdf["text"].tolist()))

    return run


def normalized(records: DataFrame, reps: dict[str, str] | None = None) -> DataFrame:
    """Every record in one consistent form: ``row_id``, ``text``, ``norm``; a null text has a null form.

    Equal-looking texts get equal forms; number and place of blanks, punctuation,
    letter case and visible vowel marks are kept. Empty texts stay empty.
    """
    rows = records.select("row_id", "text")
    if reps is None:
        reps = representatives(rows)
    full = rows.filter(F.col("text").isNotNull()).mapInPandas(_normalizer(reps), "row_id long, text string, norm string")
    return full.unionByName(rows.filter(F.col("text").isNull()).withColumn("norm", F.lit(None).cast("string")))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _keys(reps: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = rewriter(reps)
        for pdf in batches:
            pdf = pdf[[any(map(str.isalnum, t)) for t in pdf["text"]]]
            texts = pdf["text"].tolist()
            yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy(), "form": [_digest(t) for t in one.many(texts)], "stored": [_digest(t) for t in texts]})

    return run


def alike_found(records: DataFrame) -> DataFrame:
    """Every pair of records that look the same but are stored differently: ``row_id_a`` < ``row_id_b``.

    Null texts and texts without any letter or digit are left out, null ids too.
    Rows are compared by 128-bit digests of their form and of their stored text.
    Forms that occur with two or more stored texts give pairs of stored texts, and
    only such a pair brings its rows together, so every row pair that the join
    makes is a result: identical texts, however many, never meet each other. The
    rows of a frequent text are dealt to blocks.
    """
    rows = records.select("row_id", "text").filter(F.col("row_id").isNotNull() & F.col("text").isNotNull())
    reps = representatives(rows)
    keys = stash(rows.mapInPandas(_keys(reps), "row_id long, form binary, stored binary").distinct())
    kinds = keys.select("form", "stored").distinct()
    several = stash(kinds.join(kinds.groupBy("form").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "form").select("form", "stored"))
    a, b = (several.select("form", F.col("stored").alias(f"stored_{x}")) for x in "ab")
    pairs = a.join(b, "form").filter("stored_a < stored_b")
    side_a, side_b = (keys.select("form", F.col("stored").alias(f"stored_{x}"), F.col("row_id").alias(x)) for x in "ab")
    met = meet(pairs, side_a, side_b, ["form", "stored_a"], ["form", "stored_b"])
    return met.filter("a <> b").select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"))
