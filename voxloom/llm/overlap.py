"""Same or near-same records across splits (problem 5).

The normalized texts of the eval and test records are cut into shards, each with a
compressed full-text index (``fmindex``) over their words in text order; clip names
are texts of two symbols. The training texts stream through backward search: every
match is extended until it breaks on both sides, the maximal matches are located,
merged per pair of texts and counted, and the pairs are checked exactly in the end.

A match of frequent words only says nothing, so a maximal match has to hold an
anchor. Let the distinct words of a text be ordered rare first by one global order.
Two texts of n and m words whose common words are at least 0.7 of all share at
least ceil(0.7 n) of the n, so the first common word in that order is among the
first n - ceil(0.7 n) + 1 of either: these are the anchors. It follows that every
such pair has a maximal match through an anchor of both, however its words are
arranged, and that no pair is lost. A text goes to the shards that its anchors are
hashed to, and stands there whole (longer ones in blocks of ``TEXT_BLOCK`` words,
with the anchors of each block), so the data sent grow with the texts and not with
the number of shards. In a shard nothing but the index tells what matches.

Texts of the same distinct words are one class, however many records have them;
links are sought between classes and expanded to records only in the listing of
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import fold, looks
from voxloom.llm.fmindex import TextIndex
from voxloom.llm.splits import nth_number
from voxloom.plans.blocks import dealt, hot_keys, meet, repeated
from voxloom.plans.stash import drop_stash, stash, stash_measured

#: Least share of common words of near-same texts, in tenths.
TENTHS = 7
#: The order of words knows the counts of the words that make up more than this part of all, and of no others; so there are fewer than KNOWN.
KNOWN = 1 << 20
#: An anchor in more texts than this (and in more than 1/MOST of all) is dealt to a grid of shards.
HOT = 20_000
MOST = 1 << 16
#: Training texts aren't sent for anchors that no eval text has; a table of 2^SEEN_BITS buckets of the eval anchors tells (a shared bucket only sends more).
SEEN_BITS = 22
#: Words of a text that go to a shard at a time.
TEXT_BLOCK = 64
#: Words per shard, about: indexed ones, and streamed ones.
INDEXED, STREAMED = 1 << 21, 1 << 25
#: Located matches handled at a time.
AT_ONCE = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MEMBERS = "row_id long, train boolean, kind int, key binary, words binary"
_TEXTS = "shard int, side int, key binary, n int, at int, sig_a long, sig_b long, words binary, anchors binary"
_LINKS = "t binary, e binary, kind int, t_id long, e_id long, common int, spans int, covered int, longest int"
_MATCHES = "t binary, e binary, at_t int, at_e int, size int"


def text_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of normalized texts, end to end, and their numbers; without field blocks (with it, if it is all there is)."""
    spans = [fold.field_block(t) for t in texts]
    flat, sizes = _hashed_words([t[a:b] for t, (a, b, _) in zip(texts, spans)])
    again = [k for k, t in enumerate(texts) if not sizes[k] and spans[k][2]]
    if again:  # rare: put the words of the whole text in
        more, many = _hashed_words([texts[k] for k in again])
        flat = np.insert(flat, np.repeat((np.cumsum(sizes) - sizes)[again], many), more)
        sizes[again] = many
    return flat, sizes


def _hashed_words(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A word's hash is the sum of its mixed symbols times the powers of an odd base, mixed once more."""
    raw = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    symbols = fold.fold_table()[raw]
    row = np.repeat(np.arange(len(parts)), lens)
    kept = symbols != 0
    new = kept.copy()
    new[1:] &= ~kept[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    at = np.flatnonzero(kept)
    word = np.cumsum(new)[at] - 1
    place = at - first[word]
    powers = np.multiply.accumulate(np.full(int(place.max(initial=0)) + 1, _BASE))
    sums = np.add.reduceat(_mixed(symbols[at].astype(np.uint64) + _BASE) * powers[place], np.searchsorted(at, first)) if len(first) else np.zeros(0, np.uint64)
    return _mixed(sums).view(np.int64), np.bincount(row[first], minlength=len(parts))


def set_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of 128 bits of each text's set of distinct words: sums of two mixings of them (n, 2)."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((flat, row))
    word, row = flat[by], row[by]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
    word, row = word[new].astype(np.uint64), row[new]
    out = np.zeros((len(sizes), 2), np.uint64)
    if len(word):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for k, salt in enumerate((_BASE, np.uint64(0xC2B2AE3D27D4EB4F))):
            out[row[first], k] = np.add.reduceat(_mixed(word ^ salt), first)
    return out


def _members(reps: dict[str, str]):
    """Of every record, its text and its clip name as members of classes: rows of ``_MEMBERS``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = looks.rewriter(reps)
        for pdf in batches:
            full = [t if t is not None and any(map(str.isalnum, t)) else "" for t in pdf["text"]]
            flat, sizes = text_words(one.many(full))
            keys, raw, ends = set_keys(flat, sizes).tobytes(), flat.tobytes(), np.cumsum(sizes) * 8
            words = [raw[x:y] for x, y in zip((ends - sizes * 8).tolist(), ends.tolist())]
            texts = pdf[["row_id", "train"]].assign(kind=0, key=[b"\0" + keys[k : k + 16] for k in range(0, len(keys), 16)], words=words)
            yield texts[sizes > 0]
            named = pdf[pdf["ep"].notna() & pdf["clip"].notna()]
            raw = clip_symbols(named["ep"].to_numpy(np.int64), named["clip"].to_numpy(np.int64)).tobytes()
            symbols = [raw[k : k + 16] for k in range(0, len(raw), 16)]
            yield named[["row_id", "train"]].assign(kind=1, key=[b"\1" + x for x in symbols], words=symbols)

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    z = x.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def clip_symbols(ep: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Clip names as texts of two symbols, flat: one that stands for the whole name, and the clip number. Two names are the same if both are."""
    clip = clip.astype(np.uint64)
    name = _mixed(ep.astype(np.uint64) + _mixed(clip))
    return np.column_stack([name.view(np.int64), clip.view(np.int64)]).reshape(-1)


class Numbers:
    """Numbers of chosen words (sorted ``words``), ``default`` for all others."""

    def __init__(self, words: np.ndarray, values: np.ndarray, default: int):
        by = np.argsort(words)
        self.words, self.values, self.default = words[by], values[by], default

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), self.default, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.values[at], self.default)


def text_anchors(flat: np.ndarray, sizes: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts given end to end, with how often each word occurs: their numbers of distinct words, the places and texts of their anchors, and signatures of 128 bits (n, 2)."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((flat, row))  # stable: the first place of a word comes first
    new = np.ones(len(by), bool)
    new[1:] = (flat[by][1:] != flat[by][:-1]) | (row[by][1:] != row[by][:-1])
    at = by[new]
    at = at[np.lexsort((flat[at], often[at], row[at]))]
    row = row[at]
    n = np.bincount(row, minlength=len(sizes))
    start = np.cumsum(n) - n
    signature = np.zeros((len(sizes), 2), np.uint64)
    if len(at):
        z = _mixed(flat[at])
        bit = np.uint64(1) << (z & np.uint64(63))
        for k in (0, 1):
            signature[n > 0, k] = np.bitwise_or.reduceat(np.where((z >> np.uint64(6)) & np.uint64(1) == k, bit, np.uint64(0)), start[n > 0])
    take = np.arange(len(at)) - start[row] < (n + 1 + (-TENTHS * n) // 10)[row]
    return n, at[take], row[take], signature


def enough(n: np.ndarray, m: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether ``common`` of n and of m words are at least the least share of all of them."""
    return (10 + TENTHS) * common >= TENTHS * (n + m)


def possible(n: np.ndarray, sig: np.ndarray, m: np.ndarray, sig_m: np.ndarray) -> np.ndarray:
    """Whether sizes and signatures allow the least share: a bit that only one text has is a word that only it has."""
    only, only_m = (np.bitwise_count(x & ~y).sum(axis=1).astype(np.int64) for x, y in ((sig, sig_m), (sig_m, sig)))
    return enough(n, m, np.minimum(n - only, m - only_m))


def _often(kind: np.ndarray, flat: np.ndarray, sizes: np.ndarray, counts: Numbers) -> np.ndarray:
    """How often the words occur; of a clip name, the symbol of the whole name counts as the rarer one."""
    return np.where(np.repeat(kind == 1, sizes), 1 - (np.arange(len(flat)) == np.repeat(np.cumsum(sizes) - sizes, sizes)), counts(flat))


def _bucket(words: np.ndarray) -> np.ndarray:
    return (_mixed(words) >> np.uint64(64 - SEEN_BITS)).astype(np.int32)


def _eval_anchors(counts: Numbers):
    """The buckets of the anchors of a batch of classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                flat, sizes = _flat(pdf["words"])
                at = text_anchors(flat, sizes, _often(pdf["kind"].to_numpy(), flat, sizes, counts))[1]
                yield pd.DataFrame({"bucket": np.unique(_bucket(flat[at]))})

    return run


def _sent(counts: Numbers, hot: Numbers, seen: np.ndarray, shards: int):
    """Classes (``kind``, ``key``, ``words``, ``n_train``, ``n_eval``) on their way to the shards: rows of ``_TEXTS``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            flat, sizes = _flat(pdf["words"])
            n, at, row, signature = text_anchors(flat, sizes, _often(pdf["kind"].to_numpy(), flat, sizes, counts))
            starts = np.cumsum(sizes) - sizes
            key, raw = pdf["key"].to_numpy(), flat.tobytes()
            own = np.frombuffer(b"".join(x[1:9] for x in key), np.int64)
            for side, has in ((1, "n_eval"), (0, "n_train")):
                use = (pdf[has].to_numpy() > 0)[row]
                if not side:
                    use &= seen[_bucket(flat[at])]
                a, r = at[use], row[use]
                k = hot(flat[a])
                again = np.repeat(np.arange(len(a)), k)  # an anchor of k blocks goes to k cells of its grid
                other = np.arange(len(again)) - np.repeat(np.cumsum(k) - k, k)
                a, r, k = a[again], r[again], k[again]
                shard = shard_of(flat[a], grid_cell(own[r], other, k, side), shards)
                block = (a - starts[r]) // TEXT_BLOCK
                by = np.lexsort((a, shard, block, r))
                a, r, block, shard = a[by], r[by], block[by], shard[by]
                new = np.ones(len(a), bool)
                new[1:] = (r[1:] != r[:-1]) | (block[1:] != block[:-1]) | (shard[1:] != shard[:-1])
                first = np.flatnonzero(new)
                r, lo = r[first], starts[r[first]] + block[first] * TEXT_BLOCK
                hi = np.minimum(lo + TEXT_BLOCK, starts[r] + sizes[r])
                ends = np.append(first[1:], len(a))
                inside = (a - np.repeat(lo, ends - first)).astype(np.uint8).tobytes()
                yield pd.DataFrame({
                    "shard": shard[first], "side": side, "key": key[r], "n": n[r], "at": lo - starts[r], "sig_a": signature[r, 0].view(np.int64), "sig_b": signature[r, 1].view(np.int64),
                    "words": [raw[8 * x : 8 * y] for x, y in zip(lo.tolist(), hi.tolist())], "anchors": [inside[x:y] for x, y in zip(first.tolist(), ends.tolist())],
                })

    return run


def _flat(words: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.int64), np.fromiter(map(len, words), np.int64, len(words)) // 8


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts of a batch each word is."""
    for pdf in batches:
        if len(pdf):
            flat, sizes = _flat(pdf["words"])
            row = np.repeat(np.arange(len(sizes)), sizes)
            by = np.lexsort((row, flat))
            word, row = flat[by], row[by]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
            word, n = np.unique(word[new], return_counts=True)
            yield pd.DataFrame({"word": word, "n": n})


def grid_cell(own: np.ndarray, other: np.ndarray, k: np.ndarray, side: int) -> np.ndarray:
    """The cell of a text in the k * k grid of a hot anchor: its own block on its side's axis, every one on the other's."""
    own = (_mixed(own) % k.astype(np.uint64)).astype(np.int64)
    return own * k + other if side else other * k + own


def shard_of(words: np.ndarray, cell: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(_mixed(words) + cell.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)


def _heavy_anchors(counts: Numbers, heavy: np.ndarray):
    """Of every batch, how many texts have each of the ``heavy`` words as an anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                flat, sizes = _flat(pdf["words"])
                w = flat[text_anchors(flat, sizes, counts(flat))[1]]
                w, n = np.unique(w[np.isin(w, heavy)], return_counts=True)
                yield pd.DataFrame({"word": w, "n": n})

    return run


class Shard:
    """The indexed texts of a shard."""

    def __init__(self, texts: pd.DataFrame):
        flat, sizes, anchors = _texts(texts)
        self.index = TextIndex(flat, sizes, anchors)
        self.key, self.kind = _keys(texts)
        self.n, self.at = (texts[c].to_numpy(np.int64) for c in ("n", "at"))
        self.signature = _signatures(texts)

    def matches(self, texts: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The maximal matches of texts that may be near, through an anchor of both."""
        flat, sizes, anchors = _texts(texts)
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        key, kind = _keys(texts)
        n, at = (texts[c].to_numpy(np.int64) for c in ("n", "at"))
        signature = _signatures(texts)
        ids = self.index.ids(flat)
        lo, hi = self.index.anchored(ids[anchors])
        size = np.cumsum(hi - lo)
        begin = 0
        while begin < len(anchors):
            base = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, base + AT_ONCE, side="right")))
            many = (hi - lo)[begin:end]
            place = np.repeat(anchors[begin:end], many)
            sample = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - lo[begin:end], many)
            begin = end
            e, offset = self.index.located(sample)
            t = row[place]
            ok = kind[t] == self.kind[e]
            ok &= enough(n[t], self.n[e], np.minimum(n[t], self.n[e]))
            t, e, place, offset, sample = (x[ok] for x in (t, e, place, offset, sample))
            ok = possible(n[t], signature[t], self.n[e], self.signature[e])
            t, e, place, offset, sample = (x[ok] for x in (t, e, place, offset, sample))
            left, right = self.index.extended(sample, ids, place, starts[t], starts[t] + sizes[t])
            found = pd.DataFrame({"t": t, "e": e, "at_t": at[t] + place - starts[t] - left, "at_e": self.at[e] + offset - left, "size": left + right + 1}).drop_duplicates()
            yield found.assign(t=key[found["t"]], e=self.key[found["e"]])


def _texts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words end to end, sizes, and places of the anchors."""
    flat, sizes = _flat(pdf["words"])
    many = np.fromiter(map(len, pdf["anchors"]), np.int64, len(pdf))
    inside = np.frombuffer(b"".join(pdf["anchors"]), np.uint8).astype(np.int64)
    return flat, sizes, inside + np.repeat(np.cumsum(sizes) - sizes, many)


def _keys(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class keys, and the kinds that are their first bytes."""
    key = pdf["key"].to_numpy()
    return key, np.fromiter((x[0] for x in key), np.int64, len(key))


def _signatures(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[["sig_a", "sig_b"]].to_numpy(np.int64).view(np.uint64)


def _matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One shard: its eval texts come first and are indexed, then the training texts stream through."""
    held: list[pd.DataFrame] = []
    shard: Shard | None = None
    for pdf in batches:
        held.append(pdf[pdf["side"] == 1])
        train = pdf[pdf["side"] == 0]
        if not len(train):
            continue
        if shard is None:
            shard = Shard(pd.concat(held, ignore_index=True))
            held = []
        if not len(shard.n):
            return
        yield from shard.matches(train.reset_index(drop=True))


class Overlaps:
    """Cross-split overlaps of records with ``row_id``, ``text``, ``audio_file``, ``split`` and ``dataset_source`` (and more).

    Records with a null ``row_id``, or a split other than train, eval and test,
    take no part. A null text, or one without any letter or digit, overlaps no
    text; a clip name without two numbers overlaps no clip. Any table may be
    empty, texts may be of any length.
    """

    def __init__(self, records: DataFrame):
        self.rows = records.filter(F.col("row_id").isNotNull() & F.col("split").isin("train", "eval", "test"))
        reps = looks.representatives(self.rows)
        numbers = [nth_number(F.col("audio_file"), k).alias(n) for k, n in enumerate(("ep", "clip"))]
        base = self.rows.select("row_id", (F.col("split") == "train").alias("train"), "text", *numbers)
        self.members = stash(base.mapInPandas(_members(reps), _MEMBERS))
        totals = [F.min("row_id").alias("cid"), F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_eval")]
        classes = self.members.groupBy("kind", "key").agg(*totals, F.min_by("words", "row_id").alias("words"))
        words = F.length("words") / 8
        sums = {f"words_{c}": F.sum(F.when(F.col(c) > 0, words)) for c in ("n_train", "n_eval")}
        self.classes, seen = stash_measured(classes, n_train=F.max("n_train"), n_eval=F.max("n_eval"), **sums)
        self.seen = {k: v or 0 for k, v in seen.items()}
        found = self._sent().mapInPandas(_matched, _MATCHES)
        merged = found.groupBy("t", "e").agg(F.array_sort(F.collect_set(F.struct("at_t", "at_e", "size"))).alias("matches"))
        self.links = stash(self._checked(merged))

    def _sent(self) -> DataFrame:
        """All texts in their shards, the eval texts first."""
        words = stash(self.classes.filter("kind = 0").select("words").mapInPandas(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), keep=False)
        total = words.agg(F.sum("n").alias("total"))
        known = words.join(F.broadcast(total)).filter((F.col("n") > 1) & (F.col("n") > F.col("total") / KNOWN))  # one row
        table = known.select("word", "n").toArrow()  # fewer than KNOWN rows
        drop_stash(words)
        known_words, n = (table.column(c).to_numpy().astype(np.int64) for c in ("word", "n"))
        counts = Numbers(known_words, n, 0)
        heavy = known_words[n > HOT]  # an anchor in more than HOT texts is such a word
        hot = Numbers(*self._hot(counts, heavy), 1)
        least = self.rows.sparkSession.sparkContext.defaultParallelism
        shards = int(max(least, 4 * self.seen["words_n_eval"] // INDEXED, 4 * self.seen["words_n_train"] // STREAMED)) + 1  # a text goes to some four shards
        met = self.classes.filter("n_eval > 0").select("kind", "words").mapInPandas(_eval_anchors(counts), "bucket int").distinct().toArrow()  # 2^SEEN_BITS rows at most
        seen = np.zeros(1 << SEEN_BITS, bool)
        seen[met.column("bucket").to_numpy()] = True
        sent = self.classes.select("kind", "key", "words", "n_train", "n_eval").mapInPandas(_sent(counts, hot, seen, shards), _TEXTS)
        return sent.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.desc("side"))

    def _hot(self, counts: Numbers, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hot anchors by exact counts, and their numbers of blocks: fewer than ``MOST``."""
        if not len(heavy):
            return heavy, heavy
        found = self.classes.filter("kind = 0").select("words").mapInPandas(_heavy_anchors(counts, heavy), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        total = found.agg(F.sum("n").alias("total"))
        hot = found.join(F.broadcast(total)).filter((F.col("n") > HOT) & (F.col("n") > F.col("total") / MOST)).toArrow()  # one row
        word, n = (hot.column(c).to_numpy().astype(np.int64) for c in ("word", "n"))
        return word, -(-n // HOT)

    def _checked(self, merged: DataFrame) -> DataFrame:
        """Pairs of classes, checked exactly: ``t``, ``e`` (keys), ``kind``, ``t_id``, ``e_id``, ``common`` (words), ``spans``, ``covered`` (words of t in merged spans), ``longest``."""
        merged = merged.select("t", "e", F.size("matches").alias("spans"), _covered(F.col("matches")).alias("covered"), F.array_max(F.transform("matches", lambda m: m["size"])).alias("longest"))
        words = self.classes.select("key", "kind", "cid", "words")
        both = merged.join(words.select(F.col("key").alias("t"), "kind", F.col("cid").alias("t_id"), F.col("words").alias("wt")), "t")
        both = both.join(words.select(F.col("key").alias("e"), F.col("cid").alias("e_id"), F.col("words").alias("we")), "e")
        return both.mapInPandas(_exact, _LINKS)

    def matches(self) -> DataFrame:
        """Every linked pair of classes of texts: ``t``, ``e`` (smallest row ids), ``common``, ``spans``, ``covered``, ``longest``."""
        return self.links.filter("kind = 0").select(F.col("t_id").alias("t"), F.col("e_id").alias("e"), "common", "spans", "covered", "longest")

    def _side(self, train: bool, key: str) -> tuple[DataFrame, DataFrame | None]:
        """Members of one side of the split by class, and the hot classes among them."""
        members = self.members.filter(F.col("train") == train).select(F.col("key").alias(key), "row_id")
        count = "n_train" if train else "n_eval"
        return members, hot_keys(self.classes.withColumnRenamed("key", key), [key], count=F.col(count), most=self.seen[count])

    def found(self) -> DataFrame:
        """Every overlapping pair of records: ``row_id_a`` < ``row_id_b``."""
        (left, hot_t), (right, hot_e) = self._side(True, "t"), self._side(False, "e")
        met = meet(self.links.select("t", "e"), left.withColumnRenamed("row_id", "x"), right.withColumnRenamed("row_id", "y"), ["t"], ["e"], hot=(hot_t, hot_e))
        return met.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).distinct()

    def records(self) -> DataFrame:
        """Every record: ``row_id``, ``split``, ``dataset_source``, ``class_id`` (first record of the same words, null without a text), ``text_links`` and ``clip_links`` (linked classes of the other side)."""
        parts = []
        for train, key in ((True, "t"), (False, "e")):
            links = self.links.groupBy(key).agg(F.count(F.lit(1)).alias("links"))
            info = self.classes.select(F.col("key").alias(key), "kind", "cid").join(links, key, "left")
            members, hot = self._side(train, key)
            parts.append(dealt(members, [key], ["row_id"], hot, "block").join(repeated(info, [key], hot, "block"), [key, "block"]).select("row_id", "kind", "cid", "links"))
        zero = F.lit(0).cast("long")
        links = [F.max(F.when(F.col("kind") == k, F.col("links"))).alias(n) for k, n in enumerate(("text_links", "clip_links"))]
        by_row = parts[0].unionByName(parts[1]).groupBy("row_id").agg(F.max(F.when(F.col("kind") == 0, F.col("cid"))).alias("class_id"), *links)
        full = self.rows.select("row_id", "split", "dataset_source").join(by_row, "row_id", "left")
        return full.select("row_id", "split", "dataset_source", "class_id", F.coalesce("text_links", zero).alias("text_links"), F.coalesce("clip_links", zero).alias("clip_links"))

    def report(self) -> DataFrame:
        """Overlapping records per split and source: records, by text, by clip, by either, and their share."""
        t, c = F.col("text_links") > 0, F.col("clip_links") > 0
        return self.records().groupBy("split", "dataset_source").agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if(t).alias("by_text"),
            F.count_if(c).alias("by_clip"),
            F.count_if(t | c).alias("overlapping"),
            F.round(F.count_if(t | c) / F.count(F.lit(1)), 6).alias("share"),
        )


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose common words are enough: the distinct words of both, counted."""
    names = [x.split()[0] for x in _LINKS.split(", ")]
    for pdf in batches:
        if len(pdf):
            both, rows = [], []
            for c in ("wt", "we"):
                flat, sizes = _flat(pdf[c])
                row = np.repeat(np.arange(len(pdf)), sizes)
                by = np.lexsort((flat, row))
                new = np.ones(len(by), bool)
                new[1:] = (flat[by][1:] != flat[by][:-1]) | (row[by][1:] != row[by][:-1])
                both.append(flat[by][new])
                rows.append(row[by][new])
            n, m = (np.bincount(r, minlength=len(pdf)) for r in rows)
            word, row = np.concatenate(both), np.concatenate(rows)
            by = np.lexsort((word, row))
            twice = (word[by][1:] == word[by][:-1]) & (row[by][1:] == row[by][:-1])
            common = np.bincount(row[by][1:][twice], minlength=len(pdf))
            ok = np.where(pdf["kind"] == 1, common == 2, enough(n, m, common))
            yield pdf.assign(common=common)[ok][names]


def _covered(matches):
    """Words of t in the union of sorted spans."""

    def merge(acc, m):
        end = m["at_t"] + m["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["words"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], m["at_t"]))).alias("words"))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))
    return F.aggregate(matches, zero, merge, lambda acc: acc["words"])
