"""Voice groups, against all pairs."""

import itertools
import tracemalloc

import numpy as np

from voxloom.llm import voices


def clip(rng, bins, rate=8000, n=256, noise=0.01):
    t = np.arange(n) / rate
    return sum(np.sin(2 * np.pi * f * t + rng.uniform(0, 6)) for f in bins) / len(bins) + rng.normal(0, noise, n)


def clips(seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for voice in range(12):
        bins = 62.5 + 31.25 * rng.choice(123, 8, replace=False)
        for _ in range(int(rng.integers(1, 9))):
            rate, n = [(8000, 256), (8000, 512), (16000, 512)][int(rng.integers(3))]
            out.append((clip(rng, bins, rate, n, noise=float(rng.choice([0.01, 0.2]))).tolist(), rate))
    out += [(rng.normal(0, 1, 256).tolist(), 8000) for _ in range(6)]
    out += [out[0], out[0], ((np.array(out[3][0]) * 0.5).tolist(), out[3][1]), ([], 8000), ([0.0] * 256, 8000), (None, 8000), ([1.0, None, -0.5], 8000), (out[1][0][:200], 8000), ([1.0] * 256, None)]
    return out


def table(spark, rows):
    schema = "clip_id long, audio struct<array: array<float>, sampling_rate: int>, vec string, key int"
    return spark.createDataFrame([(i, (a, r), "clash", 1) for i, (a, r) in enumerate(rows)] + [(900, None, "clash", 1), (None, rows[0], "clash", 1)], schema)


def test_groups_equal_all_pairs(spark, brute_groups, monkeypatch):
    rows = clips()
    vec = voices.spectra([np.array(a, np.float32) if a is not None and None not in a else a for a, _ in rows], [r for _, r in rows])
    ids = [i for i, v in enumerate(vec) if v is not None]
    pairs = [(i, j) for i, j in itertools.combinations(ids, 2) if vec[i] @ vec[j] >= voices.THRESHOLD]
    want = {(f, i) for i, f in brute_groups(ids, pairs).items() if f != i}
    monkeypatch.setattr(voices, "BLOCK", 16)  # many blocks
    v = voices.Voices(table(spark, rows))
    assert {tuple(r) for r in v.found().collect()} == want
    density = {r["clip_id"]: r["density"] for r in v.members().collect()}
    degree = {i: sum(i in p for p in pairs) for i in ids}
    assert density == degree
    groups = v.described().collect()
    assert sum(g["clips"] for g in groups) == len(ids)
    for g in groups:
        top = max(density[c] for c in density if c in g["typical_clip_ids"])
        assert density[g["typical_clip_ids"][0]] == top


def test_spectra_of_any_length():
    x = np.sin(2 * np.pi * 500 * np.arange(300) / 8000)
    direct = voices.spectra([x], [8000])[0]
    want = np.abs([np.sum(x * np.exp(-2j * np.pi * f * np.arange(300) / 8000)) for f in voices.FREQUENCIES])
    assert np.allclose(direct, want / np.linalg.norm(want), atol=1e-6)


def test_empty(spark):
    v = voices.Voices(table(spark, clips()).limit(0))
    assert v.found().count() == 0 and v.described().count() == 0


def test_radius_of_nearly_equal_clips():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a = np.abs(rng.normal(0, 1, 123))
        b = a + rng.normal(0, 3e-4, 123) * a.mean()
        m = np.stack([x / np.linalg.norm(x) for x in (a, b)]).astype(np.float32)
        cell = voices._cells(voices.pd.DataFrame({"id": [1, 2], "w": [1, 1], "vec": [x.tobytes() for x in m]})).iloc[0]
        u = m.astype(np.longdouble)
        u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
        c = np.frombuffer(cell["vec"], np.float32).astype(np.longdouble)
        c /= np.sqrt((c * c).sum())
        true = 2 * np.arcsin(np.sqrt(((u - c) ** 2).sum(axis=1)) / 2)
        assert abs(cell["radius"] - float(true.max())) < 1e-9


def test_meetings_are_cut_into_tasks_of_bounded_size(spark, monkeypatch):
    """However few the shuffle partitions, a task gets about TASK members: what meets grows faster than the clips."""
    monkeypatch.setattr(voices, "TASK", 16, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        v = voices.Voices(table(spark, clips()))
        weights = v.cells.select("leader", v.cells["ws"].alias("extra"))
        found = v._join(weights, voices._density, voices._pair_density, "id long, n long")
        sent = v.vectors.count() + v.meetings.count()  # at least a member a meeting
        assert sent > 4 * 16
        assert found.rdd.getNumPartitions() >= sent / 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cells_that_only_their_angles_let_meet_are_told_apart():
    """Members spread in directions that the other cell hasn't: the angles allow a meeting, the magnitudes don't."""
    e = np.eye(123)
    far = np.cos(np.deg2rad(55)) * e[0] + np.sin(np.deg2rad(55)) * e[4]
    c, s = np.cos(np.deg2rad(15)), np.sin(np.deg2rad(15))
    m = np.stack([c * e[0] + s * e[1], c * e[0] + s * e[2], c * far + s * e[3], c * far + s * e[5]]).astype(np.float32)
    frame = voices.pd.DataFrame({"id": np.arange(4), "w": 1, "vec": [x.tobytes() for x in m]})
    cells = voices.pd.concat([voices._cells(frame[:2]), voices._cells(frame[2:])]).assign(g=0)
    assert cells["leader"].tolist() == [0, 2]
    one, two = (np.frombuffer(x, np.float32) for x in cells["vec"])
    assert np.arccos(one @ two) < np.arccos(voices.THRESHOLD) + cells["radius"].sum()
    assert (m[:2] @ m[2:].T).max() < voices.THRESHOLD
    assert not sum(len(f) for f in voices._near_leaders([voices._pack_leaders(cells).assign(a=0, b=0)]))


def test_kernels_hold_few_cosines():
    rng = np.random.default_rng(4)
    m = np.abs(rng.normal(0, 1, (4096, 123))).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    side = (np.arange(4096), np.ones(4096, np.int64), m)
    for kernel in (voices._pair_density, voices._pair_denser):
        tracemalloc.start()
        kernel(side, side, np.array([0]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6


def test_batches_to_python_are_small_while_voices_are_found(spark, monkeypatch):
    """A task holds a few MB of Arrow outside the heap, not the session's 64; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    kept = voices.stash
    monkeypatch.setattr(voices, "stash", lambda df, *a: (seen.append(int(spark.conf.get(name))), kept(df, *a))[1])
    v = voices.Voices(table(spark, clips()))
    assert seen and spark.conf.get(name) == before
    v.groups()
    assert max(seen) <= 4 << 20 and spark.conf.get(name) == before
    spark.conf.set(name, "1k")
    try:
        seen.clear()
        assert {(r["id"], r["root"]) for r in voices.Voices(table(spark, clips())).groups().collect()} == {(r["id"], r["root"]) for r in v.groups().collect()}
        assert set(seen) == {1024}
    finally:
        spark.conf.set(name, before)


def test_blocks_of_cells_travel_in_stripes(spark, monkeypatch):
    """Every pair of blocks meets once, and a block is sent once for each stripe of blocks, not once for each block."""
    monkeypatch.setattr(voices, "LEADER_BLOCK", 2)
    v = voices.Voices(table(spark, clips()))
    blocks = -(-v.cells.count() // 2)
    sent = []
    kept = voices._near_blocks
    pairs = {tuple(r) for r in v._cell_pairs().collect()}
    cells = v.cells.toPandas().sort_values("leader")
    cells["g"] = np.arange(len(cells)) // 2
    packed = voices.pd.concat([voices._pack_leaders(x) for _, x in cells.groupby("g")]).assign(stripe=lambda d: d["g"] // 3)
    rows = []
    for a, b in itertools.combinations_with_replacement(sorted(set(packed["stripe"])), 2):
        rows.append(packed[packed["stripe"].isin([a, b])].assign(a=a, b=b))
    monkeypatch.setattr(voices, "_near_blocks", lambda p, q: (sent.append((p.g, q.g)), kept(p, q))[1])
    got = [tuple(x) for f in voices._near_leaders(rows) for x in f.to_numpy().tolist()]
    assert blocks > 8 and len(set(sent)) == len(sent) == len(packed) * (len(packed) + 1) // 2
    assert set(got) == pairs and len(set(got)) == len(got)
