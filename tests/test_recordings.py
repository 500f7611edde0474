"""The data source of recordings against decoding of whole files."""

import hashlib
import io
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessitura.sources import audio
from tessitura.sources import recordings as R
from tests.test_signals_and_sources import nsp, tone, wav


def stereo_nsp(parts):
    body = b"HEDR" + struct.pack("<I", 32) + b" " * 20 + struct.pack("<IIHH", 8000, 1, 1, 1)
    for name, n in parts:
        body += name + struct.pack("<I", n) + b"\1" * (n + n % 2)
    return b"FORMDS16" + struct.pack("<I", len(body)) + body


FILES = {
    "a/one.wav": wav(tone(seconds=0.1)),
    "a/two.WAV": wav(np.tile(tone(seconds=0.1), 2), channels=2),
    "b/byte.wav": wav(tone(seconds=0.1), width=1),
    "b/wide.wav": wav(tone(seconds=0.1), width=4),
    "b/cut.wav": wav(tone(seconds=0.1))[:-37],
    "b/empty.wav": wav([]),
    "b/junk.wav": b"junk",
    "b/none.wav": b"",
    "c/x.nsp": nsp(tone(seconds=0.1)),
    "c/cut.nsp": nsp(tone(seconds=0.1))[:-37],
    "c/two.NSP": stereo_nsp([(b"SD_A", 40), (b"SD_B", 30)]),
    "c/both.nsp": stereo_nsp([(b"SDAB", 42)]),
    "c/bare.nsp": stereo_nsp([]),
    "c/short.nsp": b"FORMDS16" + b"\0" * 4 + b"HEDR" + struct.pack("<I", 4) + b"abcd",
    "c/bad.nsp": b"FORM",
}


def by_header(data, path):
    try:
        rate, channels, frames = R.header(io.BytesIO(data), len(data), path)
        return (rate, channels, frames) if frames else "AudioReadError: empty audio signal"
    except Exception as e:
        return f"{type(e).__name__}: {e}"


def by_samples(data, path):
    try:
        x, rate = audio.decode(data, path)
        return (rate, 1 if x.ndim == 1 else x.shape[1], len(x)) if len(x) else "AudioReadError: empty audio signal"
    except Exception as e:
        return f"{type(e).__name__}: {e}"


@pytest.mark.parametrize("name", FILES)
def test_headers_tell_what_samples_tell(name):
    assert by_header(FILES[name], name) == by_samples(FILES[name], name)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(FILES)), st.integers(0, 200), st.integers(0, 255), st.integers(0, 80))
def test_headers_of_damaged_files(name, at, value, cut):
    """A byte changed or an end cut off: what can be decoded has the same summary."""
    data = bytearray(FILES[name])
    if at < len(data):
        data[at] = value
    data = bytes(data[: max(0, len(data) - cut)])
    want = by_samples(data, name)
    assert by_header(data, name) == want if isinstance(want, tuple) else isinstance(by_header(data, name), str)


@pytest.fixture
def folder(tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "a" / "_draft.wav").write_bytes(b"x")
    (tmp_path / "a" / "notes.txt").write_text("x")
    return str(tmp_path)


def test_source(spark, folder):
    whole = {r["relative_path"]: r.asDict() for r in audio.read_audio(spark, folder).collect()}
    heads = {r["relative_path"]: r.asDict() for r in audio.read_audio(spark, f"file://{folder}", keep_signal=False).collect()}
    assert whole.keys() == heads.keys() == FILES.keys()
    for name, r in whole.items():
        assert r["file_sha256"] == hashlib.sha256(FILES[name]).hexdigest() and r["path"] == f"file:{folder}/{name}"
        assert (r["signal"] is None) == (r["audio_read_status"] == "error") and (r["signal"] is None or len(r["signal"]) == r["frames"])
        assert heads[name] == r | {"signal": None}
    assert {r["file_sha256"] for r in audio.read_audio(spark, folder, keep_signal=False, hashes=False).collect()} == {None}


def test_partitions_by_bytes(spark, folder):
    sizes = [(f"f{i:03}", s) for i, s in enumerate([5, 5, 5, 40, 1, 1, 30, 9])]
    parts = R.planned(sizes, 16, 1)
    assert [f for p in parts for f in p.files] == sizes
    assert [sum(s + 1 for _, s in p.files) for p in parts] == [12, 6, 41, 4, 31, 10]
    spark.dataSource.register(R.Recordings)
    rows = spark.read.format("recordings").options(folder=folder, partition_bytes=2 * R.OPEN_BYTES).load()
    assert rows.rdd.getNumPartitions() > 5 and rows.count() == len(FILES)


def test_empty_folder(spark, tmp_path):
    assert audio.read_audio(spark, str(tmp_path)).count() == 0


def test_files_written_in_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(n, bytearray(d)) for n, d in FILES.items()], "relative_path string, content binary").repartition(3)
    audio.write_files(rows, f"file://{tmp_path}/out")
    got = {r["relative_path"]: r["file_sha256"] for r in audio.read_audio(spark, f"{tmp_path}/out", keep_signal=False).collect()}
    assert got == {n: hashlib.sha256(d).hexdigest() for n, d in FILES.items()}
