"""Cross-split overlaps, against comparing every pair; the index, against scanning."""

import itertools
import math
import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import overlap
from voxloom.llm.fmindex import TextIndex

TEXTS = st.lists(st.lists(st.integers(0, 3), max_size=9), max_size=12)


def index_of(texts):
    flat = np.array([x for t in texts for x in t], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    return TextIndex(flat, sizes, np.arange(len(flat))), sizes


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.lists(st.integers(0, 4), min_size=1, max_size=5))
def test_backward_search(texts, pattern):
    index, _ = index_of(texts)
    lo, hi = index.search(pattern)
    assert hi - lo == sum(t[k : k + len(pattern)] == pattern for t in texts for k in range(len(t)))


def extent(t, i, e, j):
    left = right = 0
    while i > left and j > left and t[i - left - 1] == e[j - left - 1]:
        left += 1
    while i + right + 1 < len(t) and j + right + 1 < len(e) and t[i + right + 1] == e[j + right + 1]:
        right += 1
    return left, right


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.lists(st.integers(0, 4), min_size=1, max_size=9))
def test_maximal_matches(texts, query):
    """Every occurrence of every query symbol, with its extent, is what scanning finds; matches end at text ends."""
    index, _ = index_of(texts)
    ids = index.ids(np.array(query, np.int64))
    lo, hi = index.anchored(ids)
    got = set()
    for i, (a, b) in enumerate(zip(lo, hi)):
        s = np.arange(a, b)
        e, j = index.located(s)
        left, right = index.extended(s, ids, np.full(len(s), i), np.zeros(len(s), np.int64), np.full(len(s), len(query)))
        got |= {(i, *map(int, x)) for x in zip(e, j, left, right)}
    assert got == {(i, e, j, *extent(query, i, t, j)) for i, q in enumerate(query) for e, t in enumerate(texts) for j, x in enumerate(t) if x == q}


def test_index_is_smaller_than_the_words():
    rng = np.random.default_rng(1)
    flat = rng.zipf(1.3, 200_000) % 20_000
    index = TextIndex(flat, np.full(20_000, 10), np.arange(0, 200_000, 10))
    assert index.nbytes() < 5.2 * len(flat)  # bytes a word, samples included, where a hash has 8


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10**6))
def test_near_texts_share_an_anchor(n, seed):
    """No two texts whose common words are 0.7 of all are lost by the choice of anchors or by the signatures."""
    rng = random.Random(seed)
    a = rng.sample(range(200), n)
    b = [x for x in a if rng.random() > 0.12] or a[:1]
    b += [rng.randrange(200, 260) for _ in range(rng.randint(0, max(1, n // 5)))]
    rng.shuffle(b)
    b += rng.choices(b, k=3)
    counts = overlap.Numbers(np.arange(260), np.array([rng.randrange(5) for _ in range(260)]), 0)
    flat, sizes = np.array(a + b, np.int64), np.array([len(a), len(b)])
    size, at, row, signature = overlap.text_anchors(flat, sizes, counts(flat))
    assert size.tolist() == [len(set(a)), len(set(b))]
    if 10 * len(set(a) & set(b)) >= 7 * len(set(a) | set(b)):
        assert {*flat[at[row == 0]]} & {*flat[at[row == 1]]}
        assert overlap.possible(size[:1], signature[:1], size[1:], signature[1:])[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB ,.[]=:é\0", max_size=14), max_size=6))
def test_words(texts):
    """Words, in order, are equal exactly if their folded spellings are; keys, if the sets are."""
    texts = [*texts, "[mic: far]", "mic=far :: a b", "a  B", "b A!"]
    flat, sizes = overlap.text_words(texts)
    spelled = []
    for t in texts:
        lo, hi, _ = overlap.fold.field_block(t)
        cut = lambda x: "".join(c.lower() if c.isalnum() else " " for c in x).split()
        spelled.append(cut(t[lo:hi]) or cut(t))
    assert sizes.tolist() == [len(w) for w in spelled]
    names = [x for w in spelled for x in w]
    assert len(set(names)) == len(set(flat.tolist())) == len(set(zip(names, flat.tolist())))
    keys = [k.tobytes() for k in overlap.set_keys(flat, sizes)]
    assert len({frozenset(w) for w in spelled}) == len(set(keys)) == len({(frozenset(w), k) for w, k in zip(spelled, keys)})


NONE = np.zeros(0, np.int64)


def sent(words, train, evaluation, kind=0, shards=1):
    keys = [bytes([kind]) + k.to_bytes(16, "little") for k in range(len(words))]
    pdf = pd.DataFrame({"kind": kind, "key": keys, "words": [np.array(w, np.int64).tobytes() for w in words], "n_train": train, "n_eval": evaluation})
    return pd.concat(overlap._sent(overlap.Numbers(NONE, NONE, 0), overlap.Numbers(NONE, NONE, 1), np.ones(1 << overlap.SEEN_BITS, bool), shards)(iter([pdf])))


def test_one_shard_finds_all_and_no_more_than_the_index_says():
    """With every text in one shard, what matches is the index's work alone: texts that share no anchor never meet."""
    words = [[1, 2, 3, 4, 5], [5, 4, 3, 2, 1], [1, 2, 3, 4, 9], [21, 22, 23], [21, 22, 23, 23]]
    rows = sent(words, [1, 0, 0, 1, 0], [0, 1, 1, 0, 1])
    assert set(rows["shard"]) == {0}
    found = pd.concat(overlap._matched(iter([rows.sort_values("side", ascending=False)])))
    found["t"], found["e"] = found["t"].str[1], found["e"].str[1]
    assert {tuple(x) for x in found[["t", "e"]].to_numpy().tolist()} <= {(0, 1), (0, 2), (3, 4)}
    assert {(3, 4, 0, 0, 3)} == {tuple(x) for x in found[found["t"] == 3][["t", "e", "at_t", "at_e", "size"]].to_numpy().tolist()}
    backwards = found[found["e"] == 1]
    assert len(backwards) and (backwards["size"] == 1).all()  # same words, other order: single words match


def test_training_texts_without_eval_anchors_stay():
    seen = np.zeros(1 << overlap.SEEN_BITS, bool)
    seen[overlap._bucket(np.array([3]))] = True
    pdf = pd.DataFrame({"kind": 0, "key": [b"\0" + bytes([k] * 16) for k in range(2)], "words": [np.array(w, np.int64).tobytes() for w in ([1, 2, 3], [4, 5, 6])], "n_train": 1, "n_eval": 0})
    rows = pd.concat(overlap._sent(overlap.Numbers(np.array([1, 2]), np.array([9, 9]), 0), overlap.Numbers(NONE, NONE, 1), seen, 3)(iter([pdf])))
    assert [k[1] for k in rows["key"]] == [0] and (rows["side"] == 0).all()


def test_clip_names_are_exact():
    ep, clip = np.array([1, 1, 2, 0, (1 << 60) - 1]), np.array([2, 3, 2, 0, 7])
    flat = overlap.clip_symbols(ep, clip)
    assert len({*map(tuple, flat.reshape(-1, 2).tolist())}) == 5 and (flat == overlap.clip_symbols(ep, clip)).all()
    assert set(sent(flat.reshape(-1, 2), 0, 1, kind=1, shards=5)["anchors"]) == {b"\0"}  # the symbol of the whole name


def records(n=250, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            t = rng.choice(rows)[1] or "x"
            w = t.replace("!", "").split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w.append(rng.choice(vocab))
            if rng.random() < 0.3:
                rng.shuffle(w)
            t = " ".join(w).upper() if rng.random() < 0.3 else " ".join(w) + "!"
        else:
            t = " ".join(rng.sample(vocab, rng.choice([1, 2, 3, 4, 6, 9, 12, 20, 30])))
        rows.append((i, t, f"ep{rng.randrange(40)}_{rng.randrange(6)}.wav" if rng.random() < 0.7 else None, rng.choice(["train", "train", "eval", "test", None])))
    return [*rows, (n, None, "ep1_1", "train"), (n + 1, "", None, "eval"), (n + 2, "...", "", "test"), (n + 3, "...", "", "train")]


def wanted(rows):
    words = {i: set((t or "").replace("!", "").lower().split()) - {"..."} for i, t, _, _ in rows}
    clip = {i: tuple(int(x) for x in a[2:].replace(".wav", "").split("_")) if a else None for i, _, a, _ in rows}
    out = set()
    for (i, _, _, s), (j, _, _, r) in itertools.combinations(rows, 2):
        if s and r and (s == "train") != (r == "train"):
            a, b = words[i], words[j]
            if (a and b and 10 * len(a & b) >= 7 * len(a | b)) or (clip[i] and clip[i] == clip[j]):
                out.add((i, j))
    return out


SCHEMA = "row_id long, text string, audio_file string, split string, dataset_source string"


def test_found_equals_all_pairs(spark):
    rows = records()
    df = spark.createDataFrame([(*r, "src", 1) for r in rows] + [(None, "w1 w2 w3", "ep1_1", "train", "src", 1)], f"{SCHEMA}, key int")
    o = overlap.Overlaps(df)
    got = [tuple(r) for r in o.found().collect()]
    assert len(got) == len(set(got)) and set(got) == wanted(rows)
    touched = {x for p in got for x in p}
    assert sum(r["overlapping"] for r in o.report().collect()) == len(touched)
    assert {r["row_id"] for r in o.records().filter("text_links + clip_links > 0").collect()} == touched
    assert all(r["covered"] >= r["longest"] >= 1 for r in o.matches().collect())


def test_hot_anchors_and_classes_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT", 10)
    monkeypatch.setattr(overlap, "AT_ONCE", 50)
    rows = records(seed=9)
    df = spark.createDataFrame([(*r, "src") for r in rows], SCHEMA)
    assert {tuple(r) for r in overlap.Overlaps(df).found().collect()} == wanted(rows)


def test_long_texts_go_in_blocks(spark):
    rng = random.Random(3)
    long = [f"v{k}" for k in range(400)]
    other = long[:150] + ["x"] * 5 + long[170:]
    rng.shuffle(long)
    rows = [(1, " ".join(long), None, "train"), (2, " ".join(other), None, "eval"), (3, " ".join(other[:200]), None, "test"), (4, "v1 " * 5000, None, "eval"), (5, "V1", None, "train")]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    o = overlap.Overlaps(df)
    assert {tuple(r) for r in o.found().collect()} == {(1, 2), (4, 5)} == wanted(rows)
    assert {(r["t"], r["e"]): r["common"] for r in o.matches().collect()} == {(1, 2): 380, (4, 4): 1}


def test_empty(spark):
    o = overlap.Overlaps(spark.createDataFrame([], SCHEMA))
    assert o.found().count() == 0 and o.report().count() == 0


def test_threshold_is_a_ratio():
    assert math.isclose(overlap.TENTHS / 10, 0.7)
