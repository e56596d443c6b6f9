"""File sources and sinks: round trips and edge cases."""

import numpy as np

from voxloom.sources import files


def test_metadata_round_trip(spark, tmp_path):
    rows = [("wavs/a.wav", ' نص "بين" \\ ', "spk0"), ("wavs/b.wav", "x,y;z", "spk1")]
    df = spark.createDataFrame(rows, files.METADATA_SCHEMA)
    files.write_metadata(df.coalesce(1), str(tmp_path / "m"))
    raw = next((tmp_path / "m").glob("part-*.csv")).read_text(encoding="utf-8")
    assert raw == "audio_file|text|speaker_name\n" + "".join("|".join(r) + "\n" for r in rows)
    (tmp_path / "crlf.csv").write_bytes("audio_file|text|speaker_name\r\nwavs/a.wav|كلام|spk0\r\n".encode())
    assert files.read_metadata(spark, str(tmp_path / "crlf.csv")).collect()[0]["speaker_name"] == "spk0"


def test_wav_round_trip(spark, tmp_path):
    x = [0.0, 0.5, -0.5, 1.0]
    df = spark.createDataFrame([("a/clip.wav", x, 8000)], "file string, samples array<double>, rate int")
    for width in (2, 3):
        files.write_wav(df, str(tmp_path), width)
        got = files.read_wav(spark, str(tmp_path)).first()
        assert np.allclose(got["samples"], x, atol=1e-4) and got["rate"] == 8000
    assert files.wav_durations(spark, str(tmp_path)).first()["duration"] == 4 / 8000
    (tmp_path / "bad.wav").write_bytes(b"no wave")
    assert files.read_wav(spark, str(tmp_path)).filter("samples IS NULL").count() == 1


def test_log_curve(spark, tmp_path):
    lines = ["| > loss: 9.0 (before any step)"]
    for k in range(1, 26):
        lines += [f"--> TIME: x -- STEP: {k}/99 -- GLOBAL_STEP: {k * 50}\x1b[0m", f"| > loss: {k / 2} (0)", "| > loss_text: 7", "| > loss: bad" if k == 3 else ""]
    (tmp_path / "t.log").write_text("\n".join(lines))
    curve = files.loss_curve(files.read_log(spark, str(tmp_path / "t.log")))
    got = [(r["step"], r["loss"]) for r in curve.orderBy("line_no").collect()]
    assert got == [(k * 50, k / 2) for k in range(1, 26)]
    avg = files.smoothed(curve).orderBy("step").collect()
    assert [r["step"] for r in avg] == [k * 50 for k in range(5, 26)]
    assert abs(avg[0]["loss_average"] - np.mean([k / 2 for k in range(1, 6)])) < 1e-9
    assert files.smoothed(curve.limit(20)).count() == 0


def test_json_text_listing(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": Infinity, "b": [1, 2]}')
    row = files.read_json(spark, str(tmp_path / "c.json"), "a double, b array<int>").first()
    assert row["a"] == float("inf") and row["b"] == [1, 2]
    (tmp_path / "t.txt").write_text("\n نص  ")
    assert files.read_whole_text(spark, str(tmp_path / "t.txt")).first()["text"] == "نص"
    assert files.latest(files.listing(spark, str(tmp_path), "*.none*"), files.listing(spark, str(tmp_path), "*.json")).endswith("c.json")
    files.write_report(spark.createDataFrame([("ن", 1)], "a string, b int"), str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text(encoding="utf-8") == '{\n  "a": "ن",\n  "b": 1\n}'


def test_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "audio_file string, i int")
    files.quarantine(rows, rows.filter("i = 1"), "audio_file", str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "rejected")).first()["i"] == 1
    assert spark.read.parquet(str(tmp_path / "kept")).first()["i"] == 2


def test_wav_duration_behind_long_chunks(spark, tmp_path):
    df = spark.createDataFrame([("clip.wav", [0.0, 0.5, -0.5, 1.0], 8000)], "file string, samples array<double>, rate int")
    files.write_wav(df, str(tmp_path))
    raw = (tmp_path / "clip.wav").read_bytes()
    at = raw.index(b"data")
    body = raw[8:at] + b"LIST" + (6000).to_bytes(4, "little") + b"\0" * 6000 + raw[at:]
    (tmp_path / "clip.wav").write_bytes(b"RIFF" + len(body).to_bytes(4, "little") + body)
    assert files.wav_durations(spark, str(tmp_path)).first()["duration"] == 4 / 8000
    assert len(files.read_wav(spark, str(tmp_path)).first()["samples"]) == 4
