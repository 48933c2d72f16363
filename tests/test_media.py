import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import dsp, seams
from chronoloom.operators import signal
from chronoloom.sources import files, schemas, sinks
from chronoloom.sources import synthetic as syn
from tests.conftest import rows


def test_wav_blocks_and_features(spark, tmp_path):
    x = syn.tone(440.0, 0.5) + syn.click(0.5, 0.25)
    (tmp_path / "a.wav").write_bytes(syn.wav_bytes(syn.placed(x, -1.0)))
    (tmp_path / "b.wav").write_bytes(syn.wav_bytes(x, 8000))
    b = files.wav_blocks(spark, str(tmp_path))
    assert {r["stream_id"]: r["n"] for r in b.groupBy("stream_id").agg(F.count("*").alias("n")).collect()} == {"a": 10, "b": 20}
    assert files.wav_blocks(spark, str(tmp_path), mono=False).filter("stream_id = 'a'").select("ch").distinct().count() == 2
    f = signal.moment_features(b.filter("stream_id = 'b'"), ["stream_id"]).orderBy("m").collect()
    assert f[0]["flux"] == 0.0 and max(f, key=lambda r: r["flux"])["m"] in (10, 11)
    assert abs(f[3]["centroid"] - 220) < 200
    (tmp_path / "broken.wav").write_bytes(b"RIFFxxxxnope")
    assert files.wav_blocks(spark, str(tmp_path), on_error="skip").count() == 30
    with pytest.raises(Exception):
        files.wav_blocks(spark, str(tmp_path)).count()


def test_wav_widths():
    x = np.array([0.0, 0.5, -0.5, 0.25], np.float32)
    import struct

    for bits, kind, body in ((8, 1, ((x * 128) + 128).astype(np.uint8).tobytes()), (32, 1, (x * 2**31).astype("<i4").tobytes()), (32, 3, x.astype("<f4").tobytes()), (24, 1, b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x))):
        head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, kind, 1, 16000, 16000 * bits // 8, bits // 8, bits)
        rate, y = files.parse_wav(head + b"data" + struct.pack("<I", len(body)) + body)
        assert rate == 16000 and np.allclose(y[:, 0], x, atol=0.01)


def test_chunks_join_without_a_seam():
    x = syn.noise(1.0, 1).reshape(-1, 800)
    whole = dsp.block_features(x)
    a = dsp.block_features(x[:9])
    b = dsp.block_features(x[9:], a[3])
    assert np.allclose(whole[1], np.concatenate([a[1], b[1]]))


def test_spectrum_places_a_tone(spark):
    db = dsp.log_spectrogram(syn.tone(1000.0, 0.5))
    edges = 50 * (160 ** (np.arange(65) / 64))
    top = int(db[50].argmax())
    assert edges[top] <= 1000 < edges[top + 1] and db.shape[1] == 64
    df = spark.createDataFrame([("a", syn.tone(1000.0, 0.5).tolist()), ("b", [])], "s string, x array<double>")
    out = signal.spectra(df, ["s"], "x").collect()
    assert {r["s"] for r in out} == {"a"} and out[0]["loud"] > 0.3


def test_direction():
    left, right = syn.placed(syn.noise(0.2, 3), 1.0).T
    l, r = dsp.log_spectrogram(left), dsp.log_spectrogram(right)
    heard = r.max(axis=0) > -99  # low bins hold no spectral line
    assert (dsp.level_pan(l, r)[heard] > 0.9).all() and (dsp.level_pan(l, r)[~heard] == 0).all()
    x = syn.noise(0.05, 4, level=0.5)
    assert abs(dsp.arrival_lag_ms(x[8:], x[:-8]) + 0.5) < 0.01 or abs(dsp.arrival_lag_ms(x[8:], x[:-8]) - 0.5) < 0.01
    assert dsp.arrival_lag_ms(syn.noise(0.05, 5), syn.noise(0.05, 6)) is None


def test_pictures(spark):
    a, b = syn.flicker_pair(48, 1)
    dx, dy, peak = dsp.global_shift(a, np.roll(np.roll(a, 3, axis=1), -2, axis=0))
    assert abs(dx - 3) < 0.6 and abs(dy + 2) < 0.6 and peak > 0.1
    assert np.allclose(dsp.translated(a, 5, 0), np.roll(a, 5, axis=1))
    assert np.allclose(dsp.gaussian_blur(np.ones((9, 9)), 2.0), 1.0) and np.allclose(dsp.box_blur(np.ones((9, 9)), 3), 1.0)
    sharp = dsp.foveated(a, 24, 24)
    assert np.abs(sharp - a)[22:27, 22:27].mean() < np.abs(sharp - a)[:5, :5].mean()
    assert dsp.half_height_peaks(np.array([[0, 9, 0, 8], [0, 0, 0, 0]])) == 2
    assert dsp.crop(a, 0, 0, 4).shape == (16, 16) and dsp.downsampled(a, 6, 6).shape == (6, 6)
    s = dsp.sight_salience(a, change=np.abs(b - a), fixation=(5, 5), inhibited=[(10, 10, 100.0)])
    assert s.shape == a.shape and dsp.sound_salience(dsp.log_spectrogram(syn.tone(500, 0.2))).max() == 1.0
    px = [(np.clip(f, 0, 1) * 255).astype(np.uint8) for f in syn.flash(6, 8, 3)]
    df = spark.createDataFrame([("v", 33 * i, bytearray(f.tobytes())) for i, f in enumerate(px)], "s string, t bigint, px binary")
    steps = signal.frame_steps(df, ["s"], "t", "px").orderBy("t").collect()
    assert [r["t"] for r in steps if r["mean_step"] > 100] == [99, 165]
    rgb = spark.createDataFrame([(bytearray(np.full((2, 2, 3), 255, np.uint8).tobytes()), 2, 2)], "px binary, h int, w int")
    assert np.allclose(rgb.select(signal.frame_stats("px", "h", "w").alias("s")).select("s.*").first(), (1.0, 0.0, 1.0, 0.0))


def test_blocks_and_rms(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [])], "s string, x array<double>")
    assert rows(signal.blocks(df, ["s"], "x", 2)) == [("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 0.0])]
    assert rows(df.select("s", F.round(signal.rms(F.col("x")), 4))) == [("a", 2.1602), ("b", None)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "trace.txt").write_text("t fx fy s\n0.1 1 2 0 7\n0.2 3 4 1\n\n")
    t = files.text_trace(spark, str(tmp_path / "trace.txt"), ["t", "x", "y", "s", "v"])
    assert rows(t) == [(0.1, 1.0, 2.0, 0.0, 7.0), (0.2, 3.0, 4.0, 1.0, None)]
    (tmp_path / "log.txt").write_text("[t= 1.50s] RECOGNIZED 'red gate' (0.81) at (10,20)\nother\n")
    assert rows(files.sightings_log(spark, str(tmp_path / "log.txt"))) == [("red gate", 10.0, 20.0, 1500, 0.81)]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{broken\n')
    assert rows(files.json_lines(spark, str(tmp_path / "x.jsonl"), "a bigint")) == [(1,)]
    (tmp_path / "tok.json").write_text('{"model": {"vocab": {"ĠCat": 5, "dog": 1}}}')
    assert rows(files.tokenizer_vocabulary(spark, str(tmp_path / "tok.json"))) == [(" Cat", 5), ("dog", 1)]
    (tmp_path / "v.raw").write_bytes(bytes(range(13)))
    assert [(r["t_ms"], bytes(r["px"])) for r in files.raw_frames(spark, str(tmp_path / "v.raw"), 2, 2, 1, 10.0).orderBy("t_ms").collect()] == [(0, bytes(range(4))), (100, bytes(range(4, 8))), (200, bytes(range(8, 12)))]
    got = files.decoded(spark, str(tmp_path / "v.raw"), lambda b: [{"n": len(b)}], "n bigint")
    assert rows(got) == [("v.raw", 13)]


def test_run_directory(spark, tmp_path):
    run = str(tmp_path / "runs" / "r1")
    ev = syn.poisson_events(spark, 2, 1.0, 30.0, 7)
    sinks.write_run(spark, run, {"events": ev, "moments": spark.createDataFrame([], schemas.schema("moments"))}, {"b": 1, "a": 2})
    assert sinks.changed_artifacts(spark, run).count() == 0
    back = files.stored_run(spark, run, ["events", "absent"])
    assert back["events"].count() == 60 and back["absent"] is None
    with pytest.raises(Exception):
        sinks.write_run(spark, run, {"events": ev})
    sinks.write_sidecar(ev.limit(3), run, "note")
    assert {r["problem"] for r in sinks.changed_artifacts(spark, run).collect()} == {"unlisted"}
    assert [r["run"].rsplit("/", 1)[-1] for r in files.runs_in(spark, str(tmp_path / "runs")).collect()] == ["r1"]
    assert sinks.canonical_hash({"a": 1, "b": 2}) == sinks.canonical_hash({"b": 2, "a": 1})
    sinks.write_text_trace(ev.orderBy("id").limit(1), str(tmp_path / "t"), [(F.col("id"), "%05d"), (F.col("stream_id"), "%d")])
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "00000 0"
    sinks.write_feed(ev, str(tmp_path / "feed"))
    sinks.append_log(ev, str(tmp_path / "log"))
    sinks.append_log(ev, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 120
    assert "events" in schemas.names()


def test_synthetic_shapes():
    assert len(syn.glide(100, 200, 0.1)) == 1600 and syn.faded(np.ones(1000, np.float32))[0] == 0
    assert syn.wheel(3, 16).shape == (3, 16, 16) and syn.step_edge(4, 8, 2)[3].sum() == 32
    v, bed = syn.tone(100, 0.1), syn.noise(0.01, 1)
    assert abs(20 * np.log10(np.sqrt(np.mean((syn.mixed(v, bed, -6.0) - v) ** 2)) / np.sqrt(np.mean(v**2))) + 6) < 0.1


def test_seams(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, "bad"), (4, None)], "id bigint, v string")

    def factory():
        def model(v):
            if v == "bad":
                raise ValueError("no")
            return [(w, 50.0, 0.0, 0.0, 1.0, 1.0) for w in (v or "").split()] + ([(" ", 99.0, 0.0, 0.0, 1.0, 1.0)] if v else [])

        return model

    all_rows = seams.model_rows(df, "id", "v", factory, "text string, confidence double, x double, y double, w double, h double")
    assert {r["id"]: r["error"] for r in all_rows.collect()}[3] == "ValueError: no"
    assert rows(seams.read_words(df, "id", "v", factory), "id", "text") == [(1, "a"), (1, "b")]
    base = lambda: lambda v: [(v, {"a b": -1.0, "": -2.0}.get(v))] if v is not None else []
    better = lambda: lambda v: [(v.upper(), -0.1)]
    assert rows(seams.two_tier(df, "id", "v", base, better), "id", "text", "tier") == [(1, "A B", "better"), (2, "", "base"), (3, "bad", "base")]


def test_facts_whole_tracks_and_peaks(spark, tmp_path):
    x = syn.tone_sequence([300.0, 600.0], 0.25, gap_s=0.05)
    assert len(x) == int(0.6 * 16_000) and np.abs(x[4000:4800]).max() == 0.0
    assert len(syn.tone_sequence([], 0.1)) == 0
    (tmp_path / "a.wav").write_bytes(syn.wav_bytes(syn.placed(x, -1.0)))
    (tmp_path / "bad.wav").write_bytes(b"no sound")
    facts = {r["stream_id"]: r for r in files.wav_facts(spark, str(tmp_path)).collect()}
    assert (facts["a"]["rate"], facts["a"]["channels"], facts["a"]["samples"], facts["a"]["error"]) == (16_000, 2, 9600, None)
    assert facts["a"]["duration_s"] == pytest.approx(0.6) and facts["bad"]["error"] == "not a WAV file"
    b = files.wav_blocks(spark, str(tmp_path), mono=False, on_error="skip")
    assert files.whole_track(b, rate=16_000, block=800, seconds=0.6, slack_s=0.1).count() == b.count() == 24
    for broken, why in ((b, "differ in length"), (b.filter("m <> 3"), "hole")):
        with pytest.raises(Exception, match=why):
            files.whole_track(broken, rate=16_000, block=800, seconds=0.6 if why == "hole" else 9.0).count()
    loud = files.peak_normalised(b).groupBy("ch").agg(F.max(F.array_max("x")).alias("top"))
    assert dict(rows(loud))[0] == pytest.approx(1.0) and dict(rows(loud))[1] == pytest.approx(0.0, abs=1e-3)
    silent = b.withColumn("x", F.transform("x", lambda v: (v * 0).cast("float")))
    assert files.peak_normalised(silent).agg(F.max(F.array_max("x"))).first()[0] == 0.0


def test_scales_stay_in_step(spark, tmp_path):
    frames = (syn.step_edge(5, 16, 3) * 255).astype(np.uint8)
    (tmp_path / "v.raw").write_bytes(frames.tobytes() + b"torn")
    raw = files.raw_frames(spark, str(tmp_path), 16, 16, 1, 10.0)
    out = files.split_scales(raw, {"small": (4, 4), "tiny": (2, 2)}).orderBy("t_ms").collect()
    assert [r["t_ms"] for r in out] == [0, 100, 200, 300, 400] and all(len(r["small"]) == 16 and len(r["tiny"]) == 4 for r in out)
    assert out[4]["tiny"] == [0.0, 1.0, 0.0, 1.0] and max(out[0]["small"]) == 0.0
    last = files.frame_at(raw.select("stream_id", "t_ms"), ["stream_id"], "t_ms", 250, slack=100)
    assert rows(last) == [("v", 200)] and files.frame_at(raw.select("stream_id", "t_ms"), ["stream_id"], "t_ms", 9000, slack=100).count() == 0


def test_frame_lookup_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("'s' as k", "id * 10 as t_ms", "id as x").write.parquet(str(tmp_path / "f"))
    plan = files.frame_at(spark.read.parquet(str(tmp_path / "f")), ["k"], "t_ms", 500, slack=100)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(t_ms,500)" in plan and "GreaterThanOrEqual(t_ms,400)" in plan


def test_broken_lines_are_kept(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"a": 1}\n{"a": \n{"a": 2, "b": 3}\n')
    assert rows(files.json_lines(spark, str(tmp_path / "f.json"), "a int")) == [(1,), (2,)]
    kept = files.json_lines(spark, str(tmp_path / "f.json"), "a int", broken="bad")
    assert sorted((r["a"], r["bad"]) for r in kept.collect() if r["bad"] is None) == [(1, None), (2, None)] and [r["bad"] for r in kept.collect() if r["bad"]] == ['{"a": ']


def test_provenance(tmp_path):
    from chronoloom.sources import provenance as P

    assert P.git_state(str(tmp_path)) == {"commit": None, "dirty": None}
    a, b = P.provenance({"x": 1, "y": 2}, str(tmp_path)), P.provenance({"y": 2, "x": 1}, str(tmp_path))
    assert a == b and len(a["config_hash"]) == 64
    assert P.constants()["binder"]["n_shifts"] == 200 and P.constants()["eye"]["mad_to_sigma"] == 1.4826
