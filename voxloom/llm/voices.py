"""Grouping clips into similarity clusters by density peaks (problem 2).

A clip is the unit vector of its discrete Fourier magnitudes. Its local density is
the number of clips within the likeness threshold; it points to its nearest denser
clip within the threshold, or is a peak. Following the pointers labels every clip
with its peak; peaks whose clusters touch (two alike clips with different labels)
are tied, so the groups are those of the likeness graph, and the peaks and
densities tell which clips are typical.

All neighbour joins are blocked, and none makes a row per pair of clips:

* equal vectors are one weighted vector;
* vectors are laid out by their strongest frequencies into blocks of bounded size;
  in each block a greedy pass gathers vectors around leaders into cells, each with
  its mean direction and true radius;
* cells meet block by block: only cells whose ceilings (the largest magnitude of
  any member at each frequency) have a product of at least the threshold go on, since
  no magnitude is negative, which is a matrix product; of these, only those whose
  centres are no farther apart than threshold angle plus both radii - by the triangle
  inequality no other pair of cells can hold two alike vectors;
* the members of such cells meet in matrix products, once for the densities and
  once for the nearest denser neighbours, both ways at a time, which return one row
  per member. Every member of a cell is alike its leader, so which groups touch is
  known from the cells of which any two members are alike.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.contract import components, follow
from voxloom.plans.stash import stash, stash_measured

#: The frequencies compared, in Hz.
FREQUENCIES = np.arange(62.5, 3875 + 1, 31.25)
#: Least cosine of two alike clips.
THRESHOLD = 0.8
#: Least cosine of a vector and the leader whose cell it joins.
LEAD = 0.93
#: Vectors per block, cells per block of the comparison of cells (4 MB), blocks that a task of it holds at most.
BLOCK = 4096
LEADER_BLOCK = 8192
HELD = 4
#: Bytes that Spark hands to Python at once: it holds some four times as much outside its heap, in every task.
BATCH = 1 << 22
#: Members of cells that a task of meetings gets, about (8 MB); samples transformed at a time; cosines held at a time.
TASK = 1 << 14
SAMPLES = 1 << 20
COSINES = 1 << 20
#: Margin for rounding in the bounds; of cosines of centres in half precision.
SLACK = 1e-4
HALF = 2e-3


def spectra(arrays: list, rates: list) -> list[np.ndarray | None]:
    """Unit magnitude vectors (float32), None where there is none.

    Null, empty, silent or rate-less audio has none; null and non-finite samples
    count as silence. Frequencies that fall on no Fourier bin of the array are
    evaluated directly.
    """
    out: list[np.ndarray | None] = [None] * len(arrays)
    groups: dict[tuple[int, float], list[int]] = {}
    clean = {}
    for k, (a, r) in enumerate(zip(arrays, rates)):
        if a is None or r is None or not r > 0 or len(a) == 0:
            continue
        x = np.asarray(a, np.float64)
        x = np.where(np.isfinite(x), x, 0.0)
        if x.any():
            clean[k] = x
            groups.setdefault((len(x), float(r)), []).append(k)
    for (n, rate), rows in groups.items():
        at = FREQUENCIES * n / rate
        bins = np.rint(at).astype(int)
        x = np.stack([clean[k] for k in rows])
        if np.allclose(at, bins, atol=1e-9) and bins.max() <= n // 2:
            mag = np.abs(np.fft.rfft(x, axis=1)[:, bins])
        else:
            steps = (np.arange(s, min(s + 4096, n)) for s in range(0, n, 4096))
            mag = np.abs(sum(x[:, t] @ np.exp(-2j * np.pi * np.outer(t, FREQUENCIES) / rate) for t in steps))
        norm = np.linalg.norm(mag, axis=1)
        floor = 1e-9 * np.abs(x).sum(axis=1)
        for k, m, z, f in zip(rows, mag, norm, floor):
            if z > f:
                out[k] = (m / z).astype(np.float32)
    return out


def _slices(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows in slices of about ``SAMPLES`` samples."""
    at = np.cumsum([0 if a is None else len(a) for a in pdf["array"]]) // SAMPLES
    for _, part in pdf.groupby(at, sort=False):
        yield part


def _spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in (part for whole in batches for part in _slices(whole)):
        vec = spectra(pdf["array"].tolist(), [None if pd.isna(r) else r for r in pdf["rate"]])
        keep = [k for k, v in enumerate(vec) if v is not None]
        raw = [vec[k].tobytes() for k in keep]
        # the layout key: the first two of the strong frequencies
        cell = []
        for k in keep:
            strong = np.flatnonzero(vec[k] >= 0.5 * vec[k].max())
            cell.append(int(strong[0]) * len(FREQUENCIES) + int(strong[min(1, len(strong) - 1)]))
        yield pd.DataFrame({"clip_id": pdf["clip_id"].to_numpy()[keep], "vec": raw, "cell": cell, "key": [hashlib.blake2b(r, digest_size=16).digest() for r in raw]})


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)


def gather(m: np.ndarray, least: float = LEAD) -> np.ndarray:
    """The leader (row number) of every row: a greedy pass, each free row in turn gathers what is near it."""
    lead = np.full(len(m), -1)
    free = np.arange(len(m))
    while len(free):
        near = m[free] @ m[free[0]] >= least
        near[0] = True
        lead[free[near]] = free[0]
        free = free[~near]
    return lead


def _angles(m: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Angles of the rows to a direction, in float64 by the chord: a cosine in float32 can't tell angles below some 5e-4 from 0."""
    u, c = m.astype(np.float64), center.astype(np.float64)
    chord = np.linalg.norm(u / np.linalg.norm(u, axis=1, keepdims=True) - c / np.linalg.norm(c), axis=1)
    return 2 * np.arcsin(np.minimum(1.0, chord / 2))


def _cells(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block into leader cells: one row per cell, members packed."""
    pdf = pdf.sort_values("id", ignore_index=True)
    m = _matrix(pdf["vec"].tolist())
    lead = gather(m)
    rows = []
    for k, part in pd.Series(range(len(m))).groupby(lead):
        at = part.to_numpy()
        center = m[at].mean(axis=0)
        center = (center / np.linalg.norm(center)).astype(np.float32)
        angle = _angles(m[at], center).max()
        rows.append((int(pdf["id"][k]), center.tobytes(), float(angle) if len(at) > 1 else 0.0, _ceiling(m[at]).tobytes(), pdf["id"].to_numpy()[at].tobytes(), pdf["w"].to_numpy()[at].tobytes(), m[at].tobytes()))
    return pd.DataFrame(rows, columns=["leader", "vec", "radius", "top", "ids", "ws", "mat"])


def _ceiling(m: np.ndarray) -> np.ndarray:
    """The largest magnitude at each frequency in 65535ths, rounded up."""
    return np.minimum(65535, np.ceil(m.max(axis=0).astype(np.float64) * 65535)).astype(np.uint16)


def _near_leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed blocks of the stripes a and b, those of a first: the leader pairs whose cells may hold alike members.

    The blocks of a are held, those of b pass; where a is b, a block meets itself and those before it.
    """
    held: list = []
    at = None
    for pdf in batches:
        for r in pdf.itertuples():
            if at != (r.a, r.b):
                held, at = [], (r.a, r.b)
            if r.a == r.b:
                yield from _near_blocks(r, r)
            if r.a == r.b or r.stripe == r.b:
                for p in held:
                    yield from _near_blocks(p, r)
            if r.a == r.b or r.stripe == r.a:
                held.append(r)


def _near_blocks(p, q) -> Iterator[pd.DataFrame]:
    """The leader pairs of two packed blocks that neither the ceilings nor the triangle inequality rule out."""
    reach = math.acos(THRESHOLD) + SLACK
    (a, ra, ca, ta), (b, rb, cb, tb) = ([np.frombuffer(x, t).reshape(len(r.ids) // 8, -1) for x, t in ((r.ids, np.int64), (r.radii, np.float64), (r.mat, np.float16), (r.tops, np.uint16))] for r in (p, q))
    a, ra, b, rb = a[:, 0], ra[:, 0], b[:, 0], rb[:, 0]
    tb = tb.T.astype(np.float32)
    for s in range(0, len(a), 256):
        x, y = np.nonzero(ta[s : s + 256].astype(np.float32) @ tb >= np.float32((THRESHOLD - SLACK) * 65535**2))
        x += s
        if p.g == q.g:
            x, y = x[a[x] < b[y]], y[a[x] < b[y]]
        for t in range(0, len(x), BLOCK):
            i, j = x[t : t + BLOCK], y[t : t + BLOCK]
            dots = np.einsum("ij,ij->i", ca[i].astype(np.float32), cb[j].astype(np.float32))
            ok = dots >= np.cos(np.minimum(np.pi, reach + ra[i] + rb[j])) - HALF
            yield pd.DataFrame({"la": np.minimum(a[i], b[j])[ok], "lb": np.maximum(a[i], b[j])[ok]})


def _pack_leaders(pdf: pd.DataFrame) -> pd.DataFrame:
    columns = {"ids": pdf["leader"].to_numpy(np.int64), "radii": pdf["radius"].to_numpy(np.float64), "mat": _matrix(pdf["vec"].tolist()).astype(np.float16)}
    return pd.DataFrame({"g": [int(pdf["g"].iloc[0])], **{k: [v.tobytes()] for k, v in columns.items()}, "tops": [b"".join(pdf["top"])]})


#: One side of a meeting: ids, a number per member, and the matrix of vectors.
Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def _side(ids: list[bytes], extra: list[bytes], mat: list[bytes]) -> Side:
    at = np.frombuffer(b"".join(ids), np.int64)
    return at, np.frombuffer(b"".join(extra), np.int64), np.frombuffer(b"".join(mat), np.float32).reshape(len(at), -1)


def _alike(a: Side, b: Side) -> Iterator[tuple[int, np.ndarray]]:
    """Cosines of blocks of rows of a and all of b."""
    step = max(1, min(1024, COSINES // max(1, len(b[0]))))
    for s in range(0, len(a[0]), step):
        yield s, a[2][s : s + step] @ b[2].T


def _density(a: Side, b: Side) -> list[tuple[np.ndarray, ...]]:
    """Weight of the alike members of b for each member of a."""
    w = b[1].astype(np.float64)
    n = np.concatenate([(d >= THRESHOLD) @ w for _, d in _alike(a, b)]).astype(np.int64)
    return [(a[0][n > 0], n[n > 0])]


def _nearest_denser(a: Side, b: Side) -> list[tuple[np.ndarray, ...]]:
    """The nearest alike and denser member of b for each member of a."""
    parts = []
    for s, d in _alike(a, b):
        if d.max() < THRESHOLD:
            continue
        ids, dens = a[0][s : s + len(d), None], a[1][s : s + len(d), None]
        d = np.where(((b[1] > dens) | ((b[1] == dens) & (b[0] < ids))) & (d >= THRESHOLD), d, -1)
        best = d.argmax(axis=1)
        top = d[np.arange(len(d)), best]
        ok = top > 0
        parts.append((ids[ok, 0], top[ok].astype(np.float64), b[0][best[ok]]))
    return parts


def _alike_part(a: Side, b: Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of the cosines of a and b, cut to the rows and columns in which any two members are alike."""
    for s, d in _alike(a, b):
        near = d >= THRESHOLD
        rows = np.flatnonzero(near.any(axis=1))
        if len(rows):
            d = d[rows]
            columns = np.flatnonzero(near[rows].any(axis=0))
            yield rows + s, columns, d[:, columns]


def _pair_density(a: Side, b: Side, cells: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """Both ways at once: weights of the alike members on the other side; and which ``cells`` (starts in b) hold any."""
    na, nb = np.zeros(len(a[0])), np.zeros(len(b[0]))
    for rows, columns, d in _alike_part(a, b):
        near = (d >= THRESHOLD).astype(np.float64)
        na[rows] = near @ b[1][columns].astype(np.float64)
        nb[columns] += a[1][rows].astype(np.float64) @ near
    found = [(x[0][n > 0], n[n > 0].astype(np.int64)) for x, n in ((a, na), (b, nb))]
    return found, np.logical_or.reduceat(nb > 0, cells)


def _pair_denser(a: Side, b: Side, cells: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """Both ways at once: the nearest alike and denser member of the other side."""
    parts = []
    for rows, columns, d in _alike_part(a, b):
        ids, dens, ids_b = a[0][rows], a[1][rows], b[0][columns]
        up = (b[1][columns] > dens[:, None]) | ((b[1][columns] == dens[:, None]) & (ids_b < ids[:, None]))
        near = d >= THRESHOLD
        for mine, other, x in ((ids, ids_b, np.where(near & up, d, -1)), (ids_b, ids, np.where(near & ~up, d, -1).T)):
            best = x.argmax(axis=1)
            top = x[np.arange(len(x)), best]
            ok = top > 0
            parts.append((mine[ok], top[ok].astype(np.float64), other[best[ok]]))
    return parts, np.zeros(len(cells), bool)


def _frame(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: np.concatenate([p[k] for p in parts]) for k, n in enumerate(names)}) if parts else pd.DataFrame({n: np.zeros(0, np.int64) for n in names})


def _met(within: Callable, between: Callable, names: list[str]):
    """Kernels on one cell by itself (in part 0) and with all cells that may be near it; rows come sorted by cell, the cell itself first.

    Besides the kernel's rows, one row (leader, leader) for every two cells that touch, told apart by ``touch``.
    """

    def met(rows: list, parts: list, pairs: list) -> None:
        big, *near = rows
        a = _side([big.ids], [big.extra], [big.mat])
        if big.part == 0:
            parts += within(a, a)
        if not near:
            return
        b = _side([r.ids for r in near], [r.extra for r in near], [r.mat for r in near])
        found, touch = between(a, b, np.cumsum([0] + [len(r.ids) // 8 for r in near[:-1]]))
        parts += found
        pairs += [(big.leader, near[k].leader) for k in np.flatnonzero(touch)]

    def framed(parts: list, pairs: list) -> pd.DataFrame:
        touch = pd.DataFrame(pairs, columns=[names[0], names[-1]], dtype=np.int64)
        return pd.concat([_frame(parts, names).assign(touch=False), touch.assign(**{n: 0 for n in names[1:-1]}, touch=True)[[*names, "touch"]]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for pdf in batches:
            parts: list = []
            pairs: list = []
            for r in pdf.itertuples():
                if held and (r.big, r.part) != (held[0].big, held[0].part):
                    met(held, parts, pairs)
                    held = []
                held.append(r)
            yield framed(parts, pairs)
        if held:
            parts, pairs = [], []
            met(held, parts, pairs)
            yield framed(parts, pairs)

    return run


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands ``BATCH`` bytes to Python at once, or less if the session says so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    least = min(BATCH, _bytes(spark, before) or BATCH)
    spark.conf.set(name, str(least))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _bytes(spark: SparkSession, size: str | None) -> int:
    """A size as Spark writes it, 0 for none."""
    return max(0, spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)) if size and not size.startswith("-") else 0


class Voices:
    """Groups of alike clips of a table with ``clip_id`` and ``audio`` (``array``, ``sampling_rate``).

    Clips with a null id, or null, empty or silent audio, are in no group. Ties
    in density go to the smaller id. Any table may be empty.
    """

    def __init__(self, clips: DataFrame):
        self.spark = clips.sparkSession
        with _small_batches(self.spark):
            self._gathered(clips)

    def _gathered(self, clips: DataFrame) -> None:
        base = clips.filter(F.col("clip_id").isNotNull() & F.col("audio").isNotNull())
        base = base.select("clip_id", F.col("audio.array").alias("array"), F.col("audio.sampling_rate").alias("rate"))
        self.clips = stash(base.mapInPandas(_spectra, "clip_id long, vec binary, cell int, key binary"))
        self.vectors = stash(self.clips.groupBy("key").agg(F.min("clip_id").alias("id"), F.count(F.lit(1)).alias("w"), F.first("vec").alias("vec"), F.first("cell").alias("cell")))
        # cells of the layout are at most len(FREQUENCIES)^2; their sizes cut it into blocks
        totals = {r["cell"]: r["n"] for r in self.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        start, starts = 0, {}
        for c in sorted(totals):
            starts[c], start = start, start + totals[c]
        lut = clips.sparkSession.createDataFrame([(c, starts[c], totals[c]) for c in sorted(totals)] or [(0, 0, 0)], "cell int, at long, n long")
        spread = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        block = ((F.col("at") + spread * F.col("n")) / F.lit(BLOCK)).cast("int")
        laid = self.vectors.join(F.broadcast(lut), "cell").select("id", "w", "vec", block.alias("block"))
        cells = laid.groupBy("block").applyInPandas(_cells, "leader long, vec binary, radius double, top binary, ids binary, ws binary, mat binary")
        self.cells = stash(cells)
        # what meets grows faster than the clips; the tasks grow with it
        self.meetings, sent = stash_measured(self._meetings(self._cell_pairs()), members=F.sum("members"))
        members = start + (sent["members"] or 0)
        fewest = int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.tasks = max(1, math.ceil(members / TASK), min(fewest, math.ceil(members / (TASK // 8))))

    def _cell_pairs(self) -> DataFrame:
        n = self.cells.count()
        groups = max(1, -(-n // LEADER_BLOCK), min(8, n // 256))
        packed = self.cells.select("leader", "vec", "radius", "top", F.pmod(F.xxhash64("leader"), F.lit(groups)).alias("g")).groupBy("g").applyInPandas(_pack_leaders, "g long, ids binary, radii binary, mat binary, tops binary")
        # every stripe of blocks to each of its pairs: a block is sent once for each stripe, not once for each block
        per = max(1, min(HELD, groups // 8))
        stripes = -(-groups // per)
        striped = packed.withColumn("stripe", F.floor(F.col("g") / F.lit(per)))
        other = striped.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
        grid = other.select(F.least("stripe", "other").alias("a"), F.greatest("stripe", "other").alias("b"), *striped.columns)
        grid = grid.repartition(stripes * (stripes + 1) // 2, "a", "b").sortWithinPartitions("a", "b", "stripe", "g")
        return grid.mapInPandas(_near_leaders, "la long, lb long").distinct()

    def _meetings(self, pairs: DataFrame) -> DataFrame:
        """Pairs of cells by their larger one: ``big``, ``small``, ``part``; and the ``members`` sent for the pair.

        The large cell travels once for all small ones that may be near it, or
        once for every ``BLOCK`` of their members if they are more.
        """
        size = self.cells.select("leader", (F.length("ids") / 8).cast("long").alias("n"))
        for s in "ab":
            pairs = pairs.join(size.select(F.col("leader").alias(f"l{s}"), F.col("n").alias(f"n{s}")), f"l{s}")
        swap = F.struct("na", "la") < F.struct("nb", "lb")
        pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
        rows = pairs.select(pick("lb", "la").alias("big"), pick("la", "lb").alias("small"), pick("na", "nb").alias("n"), pick("nb", "na").alias("m"))
        parts = rows.groupBy("big").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"), F.count(F.lit(1)).alias("k"))
        members = F.col("n") + F.col("m") * F.least("parts", "k") / F.col("k")
        return rows.join(parts, "big").select("big", "small", F.pmod(F.xxhash64("small"), F.col("parts")).alias("part"), members.alias("members"))

    def _join(self, extra: DataFrame, within: Callable, between: Callable, schema: str) -> DataFrame:
        """Runs the kernels wherever cells may hold alike members; ``extra`` has the packed ``extra`` of a leader. Rows of ``schema`` and ``touch``."""
        full = self.cells.select("leader", "ids", "mat").join(extra, "leader")
        names = [x.split()[0] for x in schema.split(", ")]
        near = self.meetings.join(full.withColumnRenamed("leader", "small"), "small").select("big", "part", F.col("small").alias("leader"), "ids", "extra", "mat", F.lit(1).alias("near"))
        alone = self.cells.select(F.col("leader").alias("big"), F.lit(0).cast("long").alias("part"))
        big = self.meetings.select("big", "part").unionByName(alone).distinct().join(full.withColumnRenamed("leader", "big"), "big").select("big", "part", F.col("big").alias("leader"), "ids", "extra", "mat", F.lit(0).alias("near"))
        both = near.unionByName(big).repartition(self.tasks, "big", "part").sortWithinPartitions("big", "part", "near")
        return both.mapInPandas(_met(within, between, names), f"{schema}, touch boolean")

    def _packed(self, values: DataFrame) -> DataFrame:
        """Per cell, the ``value`` of each member ``id`` in the order of ``ids``."""
        members = self.cells.select("leader", "ids").mapInPandas(_unpacked, "leader long, at int, id long")
        both = members.join(values, "id").select("leader", "at", "value")
        lists = both.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
        return lists.select("leader", F.col("v.value").alias("v")).mapInPandas(_repacked, "leader long, extra binary")

    def densities(self) -> tuple[DataFrame, DataFrame]:
        """Local density of every distinct vector, ``id`` and ``density`` (alike clips besides one of itself); and the touching cells, ``a`` and ``b``."""
        weights = self.cells.select("leader", F.col("ws").alias("extra"))
        found = self._join(weights, _density, _pair_density, "id long, n long").groupBy("touch", "id", F.when(F.col("touch"), F.col("n")).alias("other")).agg(F.sum("n").alias("n"))
        found = stash(found)
        dens = found.filter("NOT touch").select("id", (F.col("n") - 1).alias("density"))
        return dens, found.filter("touch").select(F.col("id").alias("a"), F.col("other").alias("b"))

    def groups(self) -> DataFrame:
        """Every distinct vector: ``id``, ``w`` (clips), ``density``, ``peak``, ``root`` (one peak of the whole group)."""
        with _small_batches(self.spark):
            return self._grouped()

    def _grouped(self) -> DataFrame:
        dens, touching = self.densities()
        as_value = dens.select("id", F.col("density").alias("value"))
        denser = self._join(self._packed(as_value), _nearest_denser, _pair_denser, "id long, cos double, to long")
        best = denser.filter("NOT touch").groupBy("id").agg(F.max_by(F.col("to"), F.struct(F.col("cos"), -F.col("to"))).alias("to"))
        up = dens.join(best, "id", "left").select(F.col("id").alias("v"), F.coalesce("to", "id").alias("root"))
        labels = stash(follow_to_peak(stash(up))).select(F.col("v").alias("id"), F.col("root").alias("peak"))
        # all members of a cell are alike its leader, so their peaks are tied; so are those of touching cells
        member = self.cells.select("leader", "ids").mapInPandas(_unpacked, "leader long, at int, id long").join(labels, "id")
        inside = stash(member.select("leader", "peak").distinct())
        of_leader = labels.select(F.col("id").alias("leader"), F.col("peak").alias("a"))
        ties = inside.join(of_leader, "leader").select("a", F.col("peak").alias("b"))
        for end, name in (("a", "x"), ("b", "y")):
            touching = touching.join(labels.select(F.col("id").alias(end), F.col("peak").alias(name)), end)
        roots = components(ties.unionByName(touching.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        full = labels.join(roots.select(F.col("v").alias("peak"), "root"), "peak", "left")
        return full.join(dens, "id").join(self.vectors.select("id", "w"), "id").select("id", "w", "density", "peak", F.coalesce("root", "peak").alias("root"))

    def members(self) -> DataFrame:
        """Every clip of a group: ``clip_id``, ``density``, ``peak``, ``root``."""
        ids = self.clips.select("clip_id", "key").join(self.vectors.select("key", "id"), "key").select("clip_id", "id")
        return ids.join(self.groups(), "id").select("clip_id", "density", "peak", "root")

    def found(self) -> DataFrame:
        """One row for each clip but the first of its group: ``first_clip_id``, ``clip_id``."""
        m = stash(self.members())
        first = m.groupBy("root").agg(F.min("clip_id").alias("first_clip_id"))
        return m.join(first, "root").filter("clip_id <> first_clip_id").select("first_clip_id", "clip_id")

    def described(self, typical: int = 3) -> DataFrame:
        """Every group: ``first_clip_id``, ``clips``, ``peaks``, ``typical_clip_ids`` (the densest, ties by id)."""
        m = self.members()
        rank = F.struct((-F.col("density")).alias("d"), F.col("clip_id").alias("clip_id"))
        agg = m.groupBy("root").agg(F.min("clip_id").alias("first_clip_id"), F.count(F.lit(1)).alias("clips"), F.count_if(F.col("peak") == F.col("clip_id")).alias("peaks"))
        best = _smallest(m.select("root", rank.alias("x")), typical)
        return agg.join(best, "root").select("first_clip_id", "clips", "peaks", F.transform("xs", lambda x: x["clip_id"]).alias("typical_clip_ids"))


def _smallest(rows: DataFrame, n: int, salts: int = 64) -> DataFrame:
    """The ``n`` smallest ``x`` per ``root`` as ``xs``; hot groups are cut by salts first."""
    from pyspark.sql.window import Window

    salted = rows.withColumn("s", F.pmod(F.xxhash64("x"), F.lit(salts)))
    part = salted.withColumn("r", F.row_number().over(Window.partitionBy("root", "s").orderBy("x"))).filter(F.col("r") <= n)
    return part.groupBy("root").agg(F.slice(F.array_sort(F.collect_list("x")), 1, n).alias("xs"))


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids = [np.frombuffer(x, np.int64) for x in pdf["ids"]]
        sizes = [len(x) for x in ids]
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if ids else np.zeros(0, np.int32)
        yield pd.DataFrame({"leader": np.repeat(pdf["leader"].to_numpy(), sizes), "at": at, "id": np.concatenate(ids) if ids else np.zeros(0, np.int64)})


def _repacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"leader": pdf["leader"], "extra": [np.asarray(v, np.int64).tobytes() for v in pdf["v"]]})


def follow_to_peak(up: DataFrame) -> DataFrame:
    """Follows pointers whose last vertex points to itself."""
    inner = up.filter("v <> root")
    tops = up.filter("v = root")
    return follow(inner).unionByName(tops)
