"""Text scalars as column functions; Arrow UDFs only where no built-in expression exists."""

from __future__ import annotations

import difflib
import re
import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

# Python's white space: Java's Unicode \s lacks the four information separators.
SPACE = r"(?U)[\s\x{1c}-\x{1f}]"
ZERO_WIDTH = "[​-‏﻿]"
ARABIC_BLOCKS = "؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿"
SENTENCE_ENDS = ".!?؟。！？"
CLAUSE_ENDS = "،؛,;"
MAX_CHUNK, MIN_CHUNK = 160, 30

# Words whose hamza is often dropped, and their spelling.
CORRECTIONS = """
ان أن
انا أنا
انت أنت
انتم أنتم
اكثر أكثر
اقل أقل
اول أول
اي أي
ايضا أيضاً
اذا إذا
امام أمام
اصبح أصبح
اصبحت أصبحت
اخرى أخرى
اخر آخر
اكبر أكبر
اكد أكد
اعلن أعلن
اهم أهم
امر أمر
اساس أساس
اساسي أساسي
امن أمن
امل أمل
اسلام إسلام
ادارة إدارة
انتاج إنتاج
انسان إنسان
اعلام إعلام
الى إلى
اذ إذ
اذن إذن
انما إنما
انه إنه
انها إنها
انهم إنهم
الان الآن
القران القرآن
الالات الآلات
الالة الآلة
اخرون آخرون
مسوول مسؤول
مسوولية مسؤولية
روية رؤية
تاثير تأثير
تاكد تأكد
مساله مسألة
سوال سؤال
"""
CORRECTION_PAIRS = [tuple(x.split()) for x in CORRECTIONS.strip().split("\n")]

# Symbols and the words they are read as, in order of replacement.
SYMBOLS = [("&", " و "), ("@", " على "), ("%", " بالمئة"), ("$", " دولار"), ("£", " جنيه"), ("€", " يورو"), ("°", " درجة"), ("+", " زائد "), ("=", " يساوي ")]
LITE_SYMBOLS = SYMBOLS[:4]


def strip(c: Column) -> Column:
    """Removes white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def words(c: Column) -> Column:
    """Tokens between white space; an empty text has none."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition (null stays null)."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def clean(c: Column) -> Column:
    """Composition, no zero-width characters, plain percent sign, single spaces."""
    return collapse(F.translate(F.regexp_replace(nfc(c), ZERO_WIDTH, ""), "٪", "%"))


def correct_words(c: Column) -> Column:
    """Whole words of the correction list are respelled, in one pass."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(CORRECTION_PAIRS)])
    tokens = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), 1)
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t)), "")


def expand_symbols(c: Column, symbols: list[tuple[str, str]] = SYMBOLS) -> Column:
    """Symbols become words, in list order."""
    for a, b in symbols:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_ONES = "صفر واحد اثنان ثلاثة أربعة خمسة ستة سبعة ثمانية تسعة عشرة".split()
_TENS = ["", "", "عشرون", "ثلاثون", "أربعون", "خمسون", "ستون", "سبعون", "ثمانون", "تسعون"]
_HUNDREDS = ["", "مائة", "مئتان", "ثلاثمائة", "أربعمائة", "خمسمائة", "ستمائة", "سبعمائة", "ثمانمائة", "تسعمائة"]
_SCALES = [("ألف", "ألفان", "آلاف"), ("مليون", "مليونان", "ملايين"), ("مليار", "ملياران", "مليارات"), ("تريليون", "تريليونان", "تريليونات"), ("كوادريليون", "كوادريليونان", "كوادريليونات")]


def _below_thousand(n: int) -> list[str]:
    parts = [_HUNDREDS[n // 100]] if n >= 100 else []
    n %= 100
    if 0 < n <= 10:
        parts.append(_ONES[n])
    elif 10 < n < 20:
        parts.append({11: "أحد", 12: "اثنا"}.get(n, _ONES[n - 10]) + " عشر")
    elif n:
        parts += [_ONES[n % 10]] if n % 10 else []
        parts.append(_TENS[n // 10])
    return parts


def cardinal(n: int) -> str:
    """An Arabic cardinal, parts joined by a spaced ``و``; beyond the named scales, the digits."""
    if n == 0:
        return _ONES[0]
    if n >= 1000 ** (len(_SCALES) + 1):
        return str(n)
    groups, rest = [], n
    while rest:
        groups.append(rest % 1000)
        rest //= 1000
    parts: list[str] = []
    for k in range(len(groups) - 1, 0, -1):
        g, (one, two, many) = groups[k], _SCALES[k - 1]
        if g == 1:
            parts.append(one)
        elif g == 2:
            parts.append(two)
        elif g:
            parts.append(" و ".join(_below_thousand(g)) + " " + (many if 3 <= g % 100 <= 10 else one))
    return " و ".join(parts + _below_thousand(groups[0]))


def number_words(text: str) -> str:
    """A matched number in words; decimals digit by digit after the word for point; what can't be parsed stays."""
    try:
        whole, _, part = text.partition(".")
        out = cardinal(int(whole))
        return out + " فاصلة " + " ".join(_ONES[int(d)] for d in part) if part else out
    except (ValueError, OverflowError):
        return text


_PERCENT = re.compile(r"(\d+(?:\.\d+)?)\s*[%٪]")
_NUMBER = re.compile(r"\d+(?:\.\d+)?")


def expand_numbers_py(text: str) -> str:
    text = _PERCENT.sub(lambda m: number_words(m[1]) + " بالمئة", text)
    return _NUMBER.sub(lambda m: number_words(m[0]), text)


@F.pandas_udf(StringType())
def expand_numbers(texts: pd.Series) -> pd.Series:
    """Percentages, then all other numbers, in words."""
    return texts.map(lambda t: None if t is None else expand_numbers_py(t))


def normalize(c: Column, lite: bool = False, vocalize=None) -> Column:
    """The full pipeline: clean, correct words, numbers, symbols, clean; ``vocalize`` is an optional last column function."""
    out = clean(expand_symbols(expand_numbers(correct_words(clean(c))), LITE_SYMBOLS if lite else SYMBOLS))
    return vocalize(out) if vocalize else out


def comparable(c: Column) -> Column:
    """Text for alignment: no vowel marks, folded alef and taa, no punctuation, single spaces."""
    c = F.regexp_replace(c, "[\u064b-\u065f\u0670]", "")
    c = F.translate(c, "إأآة", "ااا" + "ه")
    return collapse(F.regexp_replace(c, rf"(?U)[^\p{{L}}\p{{N}}_\s\x{{1c}}-\x{{1f}}]", ""))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two prepared texts; 1 for two empty ones, null if either is null."""

    def one(x, y):
        if x is None or y is None:
            return None
        return 1.0 if not x and not y else difflib.SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    return sequence_ratio(comparable(a), comparable(b))


def arabic_ratio(c: Column) -> Column:
    """Share of characters in the Arabic blocks, spaces aside; 0 for an empty text."""
    t = F.replace(c, F.lit(" "), F.lit(""))
    return F.when(F.length(t) == 0, 0.0).otherwise(F.length(F.regexp_replace(t, f"[^{ARABIC_BLOCKS}]", "")) / F.nullif(F.length(t), F.lit(0)))


def latin_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Za-z]", ""))


def repeats_words(c: Column, times: int = 3) -> Column:
    """Whether some word stands ``times`` times in a row."""
    return F.regexp_like(c, F.lit(rf"(?U)(?:^|[\s\x{{1c}}-\x{{1f}}])([^\s\x{{1c}}-\x{{1f}}]+)(?:[\s\x{{1c}}-\x{{1f}}]+\1){{{times - 1}}}(?:[\s\x{{1c}}-\x{{1f}}]|$)"))


def sentences(c: Column) -> Column:
    """Sentences with their own delimiters; blank ones and leading delimiters vanish."""
    ends = re.escape(SENTENCE_ENDS)
    pieces = F.regexp_extract_all(c, F.lit(f"([^{ends}]+[{ends}]*)"), 1)

    def one(p: Column) -> Column:
        body = F.regexp_replace(p, f"[{ends}]+$", "")
        return F.when(strip(body) != "", F.concat(strip(body), F.substring(p, F.length(body) + 1, F.length(p))))

    return F.filter(F.transform(pieces, one), lambda x: x.isNotNull())


_CLAUSES = re.compile(f"[{CLAUSE_ENDS}]+")


def split_long(sentence: str, limit: int = MAX_CHUNK, recursive: bool = True) -> list[str]:
    """Bounded pieces of one sentence: packed clauses, or packed words where no clause mark helps.

    A single word over the limit passes through. With ``recursive=False`` clauses
    are packed once and never cut further.
    """
    if len(sentence) <= limit:
        return [sentence]
    clauses = [x.strip() for x in _CLAUSES.split(sentence)]
    if len(clauses) > 1:
        packed = _pack([x for x in clauses if x], limit, "، ", "، ")
        return [y for x in packed for y in split_long(x, limit)] if recursive else packed
    return _pack(sentence.split(), limit, " ", "") if recursive else [sentence]


def _pack(items: list[str], limit: int, joint: str, edge: str) -> list[str]:
    out: list[str] = []
    for item in items:
        if out and len(out[-1]) + len(item) + len(joint) <= limit:
            out[-1] = (out[-1] + joint + item).strip(edge or None)
        else:
            out.append(item)
    return [x.strip() for x in out if x.strip()]


@F.pandas_udf(ArrayType(StringType()))
def bounded(lists: pd.Series) -> pd.Series:
    """Every sentence of a list in pieces of at most ``MAX_CHUNK`` characters."""
    return lists.map(lambda xs: None if xs is None else [y for x in xs for y in split_long(x)])


@F.pandas_udf(ArrayType(StringType()))
def bounded_once(lists: pd.Series) -> pd.Series:
    """The lite variant: one level of clauses, no cutting of words."""
    return lists.map(lambda xs: None if xs is None else [y for x in xs for y in split_long(x, recursive=False)])


def merge_short(c: Column, least: int = MIN_CHUNK) -> Column:
    """Joins a chunk to the one before it if either is shorter than ``least``."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), x)))
        return F.when((F.length(last) < least) | (F.length(x) < least), joined).otherwise(F.concat(acc, F.array(x)))

    rest = F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    return F.when(F.size(c) <= 1, c).otherwise(F.aggregate(rest, F.slice(c, 1, 1), step))


def chunks(c: Column, lite: bool = False) -> Column:
    """Sentences, bounded, with short ones merged; an empty text has none."""
    return merge_short((bounded_once if lite else bounded)(sentences(c)))


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def label_tail(c: Column) -> Column:
    """What follows the last colon and space."""
    return F.element_at(F.split(c, ": "), -1)
