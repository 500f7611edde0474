import io
import struct
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.features import dsp, extract
from tessitura.functions import signal as G
from tessitura.functions import text as T
from tessitura.sources import audio, metadata, samples


def tone(f=200.0, rate=16000, seconds=1.0):
    return 0.5 * np.sin(2 * np.pi * f * np.arange(int(rate * seconds)) / rate)


def wav(x, rate=16000, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        scaled = np.asarray(x) * (2 ** (8 * width - 1) - 1)
        w.writeframes((scaled + 128).astype(np.uint8).tobytes() if width == 1 else scaled.astype({2: "<i2", 4: "<i4"}[width]).tobytes())
    return out.getvalue()


def nsp(x, rate=25000):
    data = (np.asarray(x) * 32767).astype("<i2").tobytes()
    header = b"Jan 01 00:00:00 2000" + struct.pack("<IIHH", rate, len(data) // 2, 1, 0)
    body = b"HEDR" + struct.pack("<I", len(header)) + header + b"SDA_" + struct.pack("<I", len(data)) + data
    return b"FORMDS16" + struct.pack("<I", len(body)) + body


def test_decoders():
    x, rate = audio.read_wav(wav(tone()))
    assert rate == 16000 and np.abs(x - tone()).max() < 1e-4
    stereo, _ = audio.read_wav(wav(np.stack([tone(), -tone()], axis=1).reshape(-1), channels=2))
    assert stereo.shape == (16000, 2) and np.abs(stereo.mean(axis=1)).max() < 1e-4
    assert np.abs(audio.read_wav(wav(tone(), width=1))[0] - tone()).max() < 0.02
    y, rate = audio.read_nsp(nsp(tone(rate=25000), 25000))
    assert rate == 25000 and np.abs(y - tone(rate=25000)).max() < 1e-4
    with pytest.raises(audio.AudioReadError):
        audio.read_wav(b"junk")
    with pytest.raises(audio.UnsupportedAudioFormatError):
        audio.decode(b"", "a.mp3")
    assert audio.to_float32(np.array([-32768, 0], np.int16)).tolist() == [-1.0, 0.0]


def test_audio_folder(spark, tmp_path):
    (tmp_path / "Normales").mkdir()
    (tmp_path / "Patologicos").mkdir()
    (tmp_path / "Normales" / "A 1.wav").write_bytes(wav(tone()))
    (tmp_path / "Patologicos" / "B.wav").write_bytes(b"broken")
    (tmp_path / "notes.txt").write_text("x")
    rows = audio.read_audio(spark, str(tmp_path))
    out = {r["sample_id"]: r for r in audio.index_by_path(rows, "d1").collect()}
    assert set(out) == {"d1_normales_a_1", "d1_patologicos_b"}
    assert out["d1_normales_a_1"]["label"] == "healthy" and out["d1_normales_a_1"]["duration"] == 1.0 and len(out["d1_normales_a_1"]["signal"]) == 16000
    assert out["d1_patologicos_b"]["label"] == "pathological" and out["d1_patologicos_b"]["audio_read_status"] == "error"
    assert audio.list_files(spark, str(tmp_path)).count() == 3
    assert {r["error"] is None for r in audio.audio_summary(spark, str(tmp_path)).collect()} == {True, False}


def test_recording_folder(spark, tmp_path):
    at = tmp_path / "Gesund" / "12" / "vowels"
    at.mkdir(parents=True)
    (at / "12-a_n.nsp").write_bytes(nsp(tone(rate=25000)))
    (at / "12-iau.nsp").write_bytes(nsp(tone(rate=25000)))
    (at / "odd.nsp").write_bytes(nsp(tone(rate=25000)))
    (tmp_path / "Gesund" / "overview.csv").write_text("AufnahmeID,AufnahmeDatum,SprecherID,Geburtsdatum,Geschlecht,Pathologien\n12.0,2000-01-01,7,1960-01-01,w,\n")
    out = {r["vowel"]: r for r in audio.index_by_recording(audio.read_audio(spark, str(tmp_path)), "d2").collect()}
    assert set(out) == {"a", "iau"} and out["a"]["label"] == "healthy" and out["a"]["recording_id_matches_folder"] and out["iau"]["condition"] == "sequence"
    m = metadata.typed_metadata(metadata.read_overviews(spark, str(tmp_path)))
    r = m.first()
    assert (r["recording_id"], r["speaker_id"], r["sex"], r["age"], r["pathology_group_key"]) == ("12", "7", "female", 40.0, "gesund")
    joined = metadata.join_metadata(audio.index_by_recording(audio.read_audio(spark, str(tmp_path)), "d2"), m, {"pathology_group_key": "pathology_group_key", "recording_id": "recording_id", "label": "label"})
    assert joined.filter("age = 40").count() == 2


def test_sheet(spark, tmp_path):
    p = tmp_path / "sheet.csv"
    p.write_text("Archivo,edad,sexo,G,Patología\nA 1.wav,40,H,1,\n,,,,\nB.wav,x,m,2,Edema \n")
    out = {r["metadata_file_key"]: r for r in metadata.read_sheet(spark, str(p), "healthy").collect()}
    assert set(out) == {"a_1", "b"} and out["a_1"]["age"] == 40 and out["a_1"]["sex"] == "male" and out["b"]["sex"] == "female" and out["b"]["age"] is None and out["b"]["pathology"] == "Edema"


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ñandú / ÉCOLE-9_ ", "12.0", "12-A_LHL.NSP", "x/Normales/a.b.wav"), (None, None, "12-IAU.nsp", None), ("ß", "7", "bad-a_n.nsp", "Patológicos/z")], "t string, r string, f string, p string")
    out = df.select(T.normalize_text(F.col("t")), T.slugify(F.col("t")), T.normalize_recording_id(F.col("r")), T.parse_vowel_filename(F.col("f")), T.label_from_path(F.col("p")), T.normalize_filename_key(F.col("p"))).collect()
    assert tuple(out[0])[:3] == ("nandu_ecole_9", "and_cole_9", "12") or out[0][0] == "nandu_ecole_9"
    assert tuple(out[0][3]) == ("12", "a", "lhl") and tuple(out[1][3]) == ("12", "iau", "sequence") and out[2][3] is None
    assert [r[4] for r in out] == ["healthy", None, "pathological"] and out[0][5] == "a_b" and out[1][0] == "" and out[1][5] == ""


def test_samples(spark):
    r = samples.typed_samples(spark.createDataFrame([(" s ", "nan", "  ", "x")], "sample_id string, age string, label string, other string")).first()
    assert r["sample_id"] == "s" and r["age"] is None and r["label"] is None and r["metadata"]["other"] == "x" and r["vowel"] is None


def test_column_signals_equal_numpy(spark):
    rng = np.random.default_rng(4)
    xs = [rng.normal(0.1, 1, n).tolist() for n in (1, 2, 17, 100)] + [[0.0] * 20, [1.0] * 9]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x array<double>")
    x = F.col("x")
    out = df.select("i", G.energy_positions(x).alias("e"), G.crossing_positions(x).alias("z"), G.entropy(x).alias("h"), G.partitioned_entropy(x, (2, 3)).alias("p"), G.zero_crossings(x).alias("c"), G.normalize_rms(x).alias("n"), G.pre_emphasis(x).alias("m")).collect()
    for r in out:
        v = np.array(xs[r["i"]])
        assert np.allclose(r["e"], dsp.energy_positions(v)) and np.allclose(r["z"], dsp.crossing_positions(v)) and np.isclose(r["h"], dsp.entropy(v))
        got = [np.nan if q is None else q for q in r["p"]]
        assert np.allclose(got, dsp.partitioned_entropy(v, (2, 3)), equal_nan=True)
        assert r["c"] == (dsp.crossings(v).sum() if len(v) > 1 else 0)
        level = np.sqrt((v**2).mean())
        want = v if level < 1e-12 else v * 0.1 / level
        want = want * (0.99 / np.abs(want).max() if np.abs(want).max() > 0.99 else 1)
        assert np.allclose(r["n"], want) and np.allclose(r["m"], np.append(v[0], v[1:] - 0.97 * v[:-1]))


def test_empty_signals(spark):
    df = spark.createDataFrame([([],)], "x array<double>")
    r = df.select(G.energy_positions(F.col("x")), G.crossing_positions(F.col("x")), G.partitioned_entropy(F.col("x")), G.validation_error(F.col("x"), F.lit(1.0))).first()
    assert r[0] == [None] * 9 and r[1] == [0.0] * 4 and r[2] == [None] * 58 and r[3] == "empty audio signal"


def test_features_of_a_tone():
    f = dsp.features(tone(), 16000)
    assert set(f) == set(dsp.feature_names()) and len(f) == 596
    assert abs(f["glottal_f0_mean"] - 200) < 1 and f["glottal_jitter_local"] < 0.01 and f["glottal_hnr_mean"] > 20
    assert f["zcr_total"] in (399, 400) and abs(f["energy_area_50"] - 0.5) < 0.01
    best = max(range(1, 31), key=lambda i: f[f"harmonic_{i:02d}_amp"])
    assert abs(f[f"harmonic_{best:02d}_freq"] - 200) < 16


def test_resampling():
    for rate in (8000, 22050, 44100, 48000):
        y = dsp.resample(tone(rate=rate), rate, 16000)
        assert len(y) == 16000 and np.abs(y - tone())[400:-400].max() < 2e-3
    with pytest.raises(ValueError):
        dsp.resample(tone(), 0, 16000)
    x = tone()
    assert np.abs(dsp.istft(dsp.stft(x, 2048, 512), 2048, 512, len(x)) - x).max() < 1e-9


def test_preprocessing():
    y, rate = dsp.preprocess(np.ones(1600), 16000)
    assert len(y) == 1600 and rate == 16000
    with pytest.raises(ValueError, match="empty audio signal"):
        dsp.preprocess(np.zeros(0), 16000)
    assert len(dsp.preprocess(tone(), 16000, crop=0.5)[0]) == 8000 and len(dsp.preprocess(tone(), 16000, crop=2.0, pad=True)[0]) == 32000


def test_a_failure_is_a_row(spark):
    df = spark.createDataFrame([("a", tone(seconds=0.2).tolist(), 16000), ("b", [], 16000), ("c", None, 0)], "sample_id string, signal array<float>, sr int")
    out = {r["sample_id"]: r for r in extract.extract(df).collect()}
    assert [out[k]["status"] for k in "abc"] == ["ok", "error", "error"] and out["b"]["error"] == "empty audio signal" and out["a"]["mfcc_01_mean"] is not None
    assert extract.profile(df).filter("status = 'ok'").count() == 1


def test_long_signals_take_one_pass(spark):
    """Means, sums and goals are computed once for a signal; anew for each sample they would take the cube of its length."""
    v = np.random.default_rng(5).normal(0.1, 1, 20_000)
    df = spark.createDataFrame([(v.tolist(),)], "x array<double>")
    x = F.col("x")
    began = time.monotonic()
    r = df.select(G.crossing_positions(x), G.energy_positions(x), G.partitioned_entropy(x, (2, 3)), G.normalize_rms(x), G.remove_dc(x)).first()
    assert time.monotonic() - began < 60
    for got, want in zip(r, (dsp.crossing_positions(v), dsp.energy_positions(v), dsp.partitioned_entropy(v, (2, 3)))):
        np.testing.assert_allclose(got, want)
    np.testing.assert_allclose(r[4], v - v.mean(), atol=1e-9)


def test_named_families_alone(spark):
    """Families that are not asked for are not made, and the values of the others are the same; pieces do not matter."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, n).astype(np.float32).tolist() if n else None, 1000) for i, n in enumerate((66, 400, 0, 3, 1))] + [(5, [1.0, float("inf")], 1000), (6, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "i int, signal array<float>, sr int")
    whole = {r["i"]: r.asDict() for r in extract.extract(df, 8000).collect()}
    for family in ("harmonic_", "mfcc", "glottal_"):
        own = extract.extract(df, 8000, families=(family,))
        assert {c for c in own.columns if c[0] in "hegmz" and c != "error"} == {n for n in dsp.feature_names() if n.startswith(family)}
        assert all(r.asDict() == {c: whole[r["i"]][c] for c in own.columns} for r in own.collect())
    assert [whole[i]["status"] for i in range(7)] == ["ok", "ok", "error", "ok", "ok", "error", "error"] and whole[2]["error"] == "empty audio signal"


def test_filters_and_bins_in_pieces(monkeypatch):
    rng = np.random.default_rng(7)
    a, x = rng.random((40, 70)), rng.gamma(2, 50, 500)
    want = [dsp.median_filter(a, 31, 0), dsp.median_filter(a, 31, 1), *dsp.pitch_path(x, 8000)]
    monkeypatch.setattr(dsp, "FILTER_VALUES", 5000)
    for got, w in zip([dsp.median_filter(a, 31, 0), dsp.median_filter(a, 31, 1), *dsp.pitch_path(x, 8000)], want):
        np.testing.assert_array_equal(got, w)
    for v in (x, np.round(x), np.array([0.1, 0.2, 0.3]), rng.random(64) * 1e-6):
        np.testing.assert_array_equal(dsp.equal_bins(v, 64), np.histogram(v, 64)[0])
