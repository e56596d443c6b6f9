"""Signal functions against loops written from their definitions, with hypothesis."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.functions import signal as S

waves = st.lists(st.sampled_from([0.0, 0.005, 0.02, -0.3, 0.99, 1.0]), max_size=200).map(lambda x: np.array(x, float))


@settings(max_examples=150, deadline=None)
@given(waves, st.integers(1, 40))
def test_frames(x, frame):
    hop = max(1, frame // 2)
    got = S.frame_rms(x, frame, hop)
    want = [math.sqrt((x[s : s + frame] ** 2).mean()) for s in range(0, len(x) - frame, hop)]
    assert np.allclose(got, want) and len(got) == (math.ceil((len(x) - frame) / hop) if len(x) > frame else 0)


@settings(max_examples=200, deadline=None)
@given(waves, st.integers(0, 30))
def test_pauses(x, most):
    want, run = [], 0
    for v in x:
        run = run + 1 if abs(v) < 0.01 else 0
        if run <= most:
            want.append(v)
    assert S.compress_pauses(x, 1000, most).tolist() == want


@settings(max_examples=100, deadline=None)
@given(waves)
def test_tail_and_taper(x):
    end = max((i + 1 for i, v in enumerate(x) if abs(v) >= 0.01), default=0)
    assert S.trim_tail(x, 100, 150).tolist() == x[: end + 15].tolist()
    assert len(S.taper(x, 100)) == len(x)
    assert len(S.post_process(x, 100)) <= len(x)


def test_overrun():
    x = np.ones(3000)
    x[1190:1260] = 0
    assert S.trim_overrun(x, 1000, 2.5) is x
    out = S.trim_overrun(x, 1000, 1.0)
    assert 1150 <= len(out) <= 1320 and out[-1] == 0


def test_resample_keeps_a_tone():
    t = np.arange(800) / 8000
    x = np.sin(2 * np.pi * 300 * t)
    y = S.resample(x, 8000, 16000)
    want = np.sin(2 * np.pi * 300 * np.arange(1600) / 16000)
    assert len(y) == 1600 and np.abs(y - want)[100:-100].max() < 0.02
    assert S.resample(x, 8000, 8000) is x


def test_snr_special_cases():
    assert S.snr_gate(np.zeros(5), 8000) == 0.0
    assert S.snr_gate(np.zeros(1000), 8000) == 100.0
    assert S.snr_evaluation(np.zeros(5), 8000) is None


def test_metrics_udf_edges(spark):
    rows = spark.createDataFrame([(1, None, 8000), (2, [], 8000), (3, [0.5, None, 1.0], 8000), (4, [0.1], None)], "i int, a array<float>, r int")
    got = [r[0] for r in rows.orderBy("i").select(S.wave_metrics("a", "r")).collect()]
    assert [g.samples for g in got] == [None, None, 3, None]
    assert got[2].peak == 1.0 and got[2].frames == 0


def test_spectrogram_peak():
    x = np.sin(2 * np.pi * 1000 * np.arange(4000) / 8000)
    power = S.spectrogram(x, 256, 128).mean(axis=0)
    assert power.argmax() == 32
    assert S.spectrogram(x[:10]).shape == (1, 513)


def test_edit_udf(spark):
    rows = spark.createDataFrame([([0.0, 0.5], 8000), (None, 8000)], "a array<float>, r int")
    got = [r[0] for r in rows.select(S.edit(S.post_process)(F.col("a"), F.col("r"))).collect()]
    assert got == [[0.0, 0.5], None]
