"""Duplicates hidden by formatting differences (problem 1).

A text is reduced to two 64-bit hashes without building its canonical string:
its code points stream through one lookup table that folds letter case and skips
white space, punctuation and symbols, into two rolling polynomial hashes modulo
2^64. A word start leaves a gap in the exponents, so words keep their bounds.
The field block enters as a sum of field hashes, which no order can change.
Rows whose hashes collide are compared with the first row of their group by two
pointers that skip and fold as they go; a row that differs after all starts over
among the other differing rows, so the result never rests on the hash.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.plans.blocks import dealt, hot_keys, repeated
from voxloom.plans.stash import stash, stash_measured

# The keys of the field block in the clip texts; the default of the operators' parameter.
FIELD_KEYS = ("tone", "pace", "take", "mic", "room", "style")

_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers


@lru_cache(maxsize=8)
def _patterns(keys: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Patterns of a field block before the text, of one after it, and of a field."""
    key = "(?:" + "|".join(map(re.escape, keys)) + r")\s*[:=]"
    plain = rf"{key}[^\[\]|;:=]*"
    head = rf"[\W_]*?((?:\[\s*{key}[^\[\]|;]*\]\s*)+|(?:{plain};\s*)*{plain}::)"
    tail = rf"\|\|\s*((?:{plain}\|\s*)*{plain})$"
    field = rf"({'|'.join(map(re.escape, keys))})\s*[:=]\s*([^\[\]|;:=]*)"
    return re.compile(head, re.I), re.compile(tail, re.I), re.compile(field, re.I)


@lru_cache(maxsize=1)
def categories() -> np.ndarray:
    """The Unicode category of every code point; one pass that all tables share."""
    return np.array([unicodedata.category(chr(c)) for c in range(0x110000)])


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """For each code point: 0 to skip it (and end a word), else the folded code point.

    Letters, digits, marks and format characters (invisible ones too) are kept,
    as is private use; blanks, punctuation, symbols and control characters are
    skipped. Folding is one code point to one, so that no look-alike ligature is
    resolved by it.
    """
    cat = categories()
    first = cat.astype("U1")
    out = np.where((first == "L") | (first == "N") | (first == "M") | (cat == "Cf") | (cat == "Co"), np.arange(0x110000), 0).astype(np.uint32)
    for c in np.flatnonzero((cat == "Lu") | (cat == "Lt") | (cat == "Nl") | (cat == "So")):
        low = chr(c).lower()
        if out[c] and len(low) == 1:
            out[c] = ord(low)
    return out


@lru_cache(maxsize=1)
def _alnum_table() -> np.ndarray:
    first = categories().astype("U1")
    return (first == "L") | (first == "N")


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    z = x.astype(np.uint64) + np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def field_block(text: str, keys: tuple[str, ...] = FIELD_KEYS) -> tuple[int, int, frozenset[str]]:
    """The span of the text without its field block, and the block's raw ``key=value`` strings."""
    if keys and ("[" in text or "=" in text or ":" in text):
        head, tail, field = _patterns(keys)
        if m := head.match(text):
            return m.end(), len(text), frozenset(f"{k}={v}" for k, v in field.findall(m[1]))
        if m := tail.search(text):
            return 0, m.start(), frozenset(f"{k}={v}" for k, v in field.findall(m[1]))
    return 0, len(text), frozenset()


@lru_cache(maxsize=65536)
def _field_hash(raw: str) -> tuple[int, int, int]:
    key, _, value = raw.partition("=")
    a = _poly([key], False)
    b = _poly([value], False)
    one = (int(a[0][0]) * 3 + int(b[0][0]) * 0xD6E8FEB86659FD93 + 1) & _MASK
    two = (int(a[1][0]) * 5 + int(b[1][0]) * 0xA0761D6478BD642F + 1) & _MASK
    return one, two, hash((one, two))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return raw, np.fromiter(map(len, texts), np.int64, len(texts))


def _poly(bodies: list[str], _alnum: bool = True) -> tuple[np.ndarray, np.ndarray]:
    raw, lens = _codes(bodies)
    n = len(bodies)
    if not len(raw):
        return np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    sym = fold_table()[raw]
    kept = sym != 0
    ends = np.cumsum(lens)
    starts = ends - lens
    first = np.ones(len(raw), bool)
    first[1:] = ~kept[:-1]
    first[starts[lens > 0]] = True
    steps = np.cumsum(kept.astype(np.int64) + (kept & first))
    row = np.repeat(np.arange(n), lens)
    base = np.where(starts > 0, steps[np.maximum(starts - 1, 0)], 0)
    power = (steps - base[row])[kept]
    sym, row = sym[kept], row[kept]
    out = []
    for k, b in enumerate(_BASES):
        pw = np.full(int(power.max(initial=0)) + 1, b, np.uint64)
        pw[0] = 1
        pw = np.multiply.accumulate(pw)
        sums = np.zeros(n, np.uint64)
        if len(row):
            cut = np.flatnonzero(np.diff(row, prepend=-1))
            sums[row[cut]] = np.add.reduceat(_mix(sym, k * 7919 + 1) * pw[power], cut)
        out.append(sums)
    return out[0], out[1]


def signatures(texts: list[str], keys: tuple[str, ...] = FIELD_KEYS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every text, and whether it has a letter or digit at all."""
    spans = [field_block(t, keys) for t in texts]
    h1, h2 = _poly([t[a:b] if f else t for t, (a, b, f) in zip(texts, spans)])
    for i, (_, _, fields) in enumerate(spans):
        if fields:
            one, two = 0, 0
            for x in {_field_hash(r) for r in fields}:
                one, two = one + x[0], two + x[1]
            h1[i] = (int(h1[i]) + one) & _MASK
            h2[i] = (int(h2[i]) + two) & _MASK
    raw, lens = _codes(texts)
    seen = np.concatenate([[0], np.cumsum(_alnum_table()[raw])])
    ends = np.cumsum(lens)
    return h1.view(np.int64), h2.view(np.int64), seen[ends] > seen[ends - lens]


def _skipped(bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What two pointers stop at, text after text: folded symbols, those at a word start marked, and their numbers."""
    raw, lens = _codes(bodies)
    sym = fold_table()[raw]
    row = np.repeat(np.arange(len(bodies)), lens)
    kept = sym != 0
    first = kept.copy()
    first[1:] &= ~kept[:-1] | (row[1:] != row[:-1])
    return (sym | first.astype(np.uint32) << np.uint32(31))[kept], np.bincount(row[kept], minlength=len(bodies))


def same_words(a: list[str], b: list[str]) -> np.ndarray:
    """Whether the texts of a and b have the same words in the same order, by pointers that skip and fold in both at once."""
    (x, n), (y, m) = _skipped(a), _skipped(b)
    ok = n == m  # then both run side by side
    differ = x[np.repeat(ok, n)] != y[np.repeat(ok, m)]
    bad = np.bincount(np.repeat(np.arange(len(a))[ok], n[ok])[differ], minlength=len(a))
    return ok & (bad == 0)


def same_records(a: list[str], b: list[str], keys: tuple[str, ...] = FIELD_KEYS) -> np.ndarray:
    """Whether the texts of a and b are copies: same words in order, same set of fields."""
    spans = [[field_block(t, keys) for t in x] for x in (a, b)]
    fields = [[{_field_hash(f) for f in s[2]} for s in x] for x in spans]
    same = same_words(*([t[s[0] : s[1]] for t, s in zip(x, y)] for x, y in zip((a, b), spans)))
    return same & np.fromiter((x == y for x, y in zip(*fields)), bool, len(a))


def _hashed(keys: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h1, h2, alnum = signatures(pdf["text"].tolist(), keys)
            yield pd.DataFrame({"row_id": pdf["row_id"], "h1": h1, "h2": h2})[alnum]

    return run


def _compared(keys: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["row_id", "h1", "h2", "first_row_id"]].assign(eq=same_records(pdf["text"].tolist(), pdf["first_text"].tolist(), keys))

    return run


def copy_groups(records: DataFrame, keys: tuple[str, ...] = FIELD_KEYS) -> DataFrame:
    """The first record of the group of every text: columns ``row_id``, ``first_row_id``, one row per ``row_id``.

    ``records`` needs ``row_id`` LONG and ``text``; ``keys`` are the names that may
    stand in a field block (none: there are no blocks). Null ids, null texts and
    texts without any letter or digit are in no group. Repeated rows count once; a
    ``row_id`` with several texts counts with one of them, repeatably. A text
    without a copy is its own first record. Texts may be empty or very long; other
    columns are ignored. A group of any size is compared in blocks.
    """
    texts = records.select("row_id", "text").filter(F.col("row_id").isNotNull() & F.col("text").isNotNull())
    sig = texts.mapInPandas(_hashed(keys), "row_id long, h1 long, h2 long").groupBy("row_id").agg(F.min(F.struct("h1", "h2")).alias("h"))
    open_rows = stash(sig.select("row_id", "h.h1", "h.h2"))
    done: DataFrame | None = None
    on = ["h1", "h2"]
    while True:  # every round settles the first record of each open group
        heads, seen = stash_measured(open_rows.groupBy(*on).agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("n")), most=F.max("n"))
        several = heads.filter("n > 1")
        hot = hot_keys(several, on, count=F.col("n"), most=seen["most"] or 0)
        pairs = dealt(open_rows, on, ["row_id"], hot, "block").join(repeated(several.drop("n"), on, hot, "block"), [*on, "block"]).filter("row_id <> first_row_id")
        # each head's text is fetched once, before it meets the members of its group block by block
        head_text = several.drop("n").join(texts.select(F.col("row_id").alias("first_row_id"), F.col("text").alias("first_text")), "first_row_id")
        met = pairs.join(texts, "row_id").join(repeated(head_text, on, hot, "block").select("first_row_id", "block", "first_text"), ["first_row_id", "block"])
        both = met.select("row_id", *on, "first_row_id", "text", "first_text")
        equal = both.mapInPandas(_compared(keys), "row_id long, h1 long, h2 long, first_row_id long, eq boolean")
        # of a row_id's several texts one has the hashes; repeated rows collapse
        compared, seen = stash_measured(equal.groupBy("row_id", *on, "first_row_id").agg(F.max("eq").alias("eq")), differ=F.count_if(~F.col("eq")))
        part = compared.filter("eq").select("row_id", "first_row_id").unionByName(heads.select(F.col("first_row_id").alias("row_id"), "first_row_id"))
        done = part if done is None else done.unionByName(part)
        if not seen["differ"]:
            return done
        open_rows = compared.filter("NOT eq").select("row_id", *on)


def copies_found(records: DataFrame, keys: tuple[str, ...] = FIELD_KEYS) -> DataFrame:
    """One row for each record but the first of its group: ``first_row_id``, ``row_id``."""
    return copy_groups(records, keys).filter("row_id <> first_row_id").select("first_row_id", "row_id")


def collapsed(records: DataFrame, keys: tuple[str, ...] = FIELD_KEYS) -> DataFrame:
    """One record per group with its number of copies: ``row_id`` (the first), ``copies``."""
    return copy_groups(records, keys).groupBy(F.col("first_row_id").alias("row_id")).agg(F.count(F.lit(1)).alias("copies"))
