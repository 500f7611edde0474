"""Recordings as binary files: listing, decoding of WAV and Kay NSP, indexes of the two database layouts."""

from __future__ import annotations

import io
import struct
import uuid
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.cohort import CohortError, assert_empty, repeated

DECODED = "signal array<float>, sr int, channels int, frames bigint, file_duration double, audio_read_status string, audio_read_error string"


class AudioReadError(ValueError):
    """The bytes can't be decoded."""


class UnsupportedAudioFormatError(AudioReadError):
    """Neither WAV nor NSP."""


def to_float32(x: np.ndarray) -> np.ndarray:
    """Integers to -1..1 by the largest magnitude of their type; floats as they are."""
    x = np.asarray(x)
    if x.dtype.kind == "f":
        return x.astype(np.float32)
    info = np.iinfo(x.dtype)
    if x.dtype.kind == "i":
        return (x / max(abs(info.min), info.max)).astype(np.float32)
    if x.dtype.kind == "u":
        middle = (info.max + 1) / 2
        return ((x - middle) / middle).astype(np.float32)
    raise AudioReadError(f"samples of type {x.dtype}")


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(frames,) or (frames, channels) float32, and the sample rate."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        raise AudioReadError(f"not a readable WAV file: {e}") from e
    if width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8).astype(np.int32)
    else:
        x = np.frombuffer(raw[: len(raw) // width * width], {1: np.uint8, 2: "<i2", 4: "<i4"}[width])
    x = to_float32(x)
    return (x if channels == 1 else x[: len(x) // channels * channels].reshape(-1, channels)), rate


def read_nsp(data: bytes) -> tuple[np.ndarray, int]:
    """Chunks of a FORM: a header with the rate, and 16-bit samples of one or two channels."""
    if data[:8] != b"FORMDS16":
        raise AudioReadError("not an NSP file")
    at, rate, parts = 12, None, {}
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name in (b"HEDR", b"HDR8"):
            rate = struct.unpack_from("<I", body, 20)[0]
        elif name in (b"SDA_", b"SD_A", b"SD_B", b"SDAB"):
            parts[name] = np.frombuffer(body[: len(body) // 2 * 2], "<i2")
        at += 8 + size + size % 2
    if rate is None or not parts:
        raise AudioReadError("an NSP file without header or samples")
    if b"SDAB" in parts:
        x = parts[b"SDAB"][: len(parts[b"SDAB"]) // 2 * 2].reshape(-1, 2)
    else:
        columns = list(parts.values())
        x = columns[0] if len(columns) == 1 else np.stack([c[: min(map(len, columns))] for c in columns], axis=1)
    return to_float32(x), int(rate)


def decode(data: bytes, path: str) -> tuple[np.ndarray, int]:
    low = path.lower()
    if low.endswith(".wav"):
        return read_wav(data)
    if low.endswith(".nsp"):
        return read_nsp(data)
    raise UnsupportedAudioFormatError(f"unsupported format: {path.rsplit('/', 1)[-1]}")


def list_files(spark: SparkSession, folder: str, suffixes: str = "*") -> DataFrame:
    """path, length, modificationTime of all files below the folder; contents aren't read."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffixes).load(folder)
    return scan.select("path", "length", "modificationTime")


def read_audio(spark: SparkSession, folder: str, keep_signal: bool = True, suffixes: str = "wav,nsp", hashes: bool = True) -> DataFrame:
    """A row a file: path, relative_path, file_sha256, the decoded signal (mono), rate, duration, status and error.

    Without the signal the rest comes from headers, and hashes from blocks of bytes (sources.recordings).
    """
    from .recordings import Recordings

    spark.dataSource.register(Recordings)
    files = spark.read.format("recordings").options(folder=folder, signals=keep_signal, hashes=hashes, suffixes=suffixes).load()
    return files.drop("length")


def decoded(files: DataFrame, keep_signal: bool = True) -> DataFrame:
    """The same for a table of path, relative_path and content."""

    def run(contents: pa.Array, paths: pa.Array) -> pa.Array:
        rows = []
        for data, path in zip(contents, paths.to_pylist()):
            try:
                x, rate = decode(data.as_py(), path)
                if not len(x):
                    raise AudioReadError("empty audio signal")
                mono = x if x.ndim == 1 else x.mean(axis=1, dtype=np.float64).astype(np.float32)
                rows.append((mono if keep_signal else None, rate, 1 if x.ndim == 1 else x.shape[1], len(x), len(x) / rate if rate > 0 else 0.0, "ok", None))
            except Exception as e:  # one bad file must not fail the others
                rows.append((None, None, None, None, None, "error", f"{type(e).__name__}: {e}"))
        kinds = [pa.list_(pa.float32()), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.string()]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in DECODED.split(", ")])

    out = files.select("path", "relative_path", F.sha2("content", 256).alias("file_sha256"), F.arrow_udf(run, DECODED)("content", "path").alias("d"))
    return out.select("path", "relative_path", "file_sha256", "d.*")


def audio_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summarized(read_audio(spark, folder, keep_signal=False, hashes=False))


def summarized(audio: DataFrame) -> DataFrame:
    return audio.select("path", "sr", "channels", "frames", "file_duration", F.col("audio_read_error").alias("error"))


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    """16-bit mono."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def encode_nsp(x: np.ndarray, rate: int) -> bytes:
    """16-bit mono."""
    data = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    header = b" " * 20 + struct.pack("<IIHH", rate, len(data) // 2, 32767, 0)
    body = b"HEDR" + struct.pack("<I", len(header)) + header + b"SDA_" + struct.pack("<I", len(data)) + data
    return b"FORMDS16" + struct.pack("<I", len(body)) + body


def write_files(files: DataFrame, folder: str) -> None:
    """A file below the folder for each row of relative_path and content, written in tasks under a name of the task's own, then renamed."""

    def run(batches):
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        n = 0
        for b in batches:
            for name, data in zip(b.column("relative_path").to_pylist(), b.column("content")):
                parent, own = f"{place}/{name}".rsplit("/", 1)
                system.create_dir(parent, recursive=True)
                draft = f"{parent}/_{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(data.as_buffer())
                system.move(draft, f"{parent}/{own}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    files.select("relative_path", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def index_by_path(audio: DataFrame, prefix: str = "d1") -> DataFrame:
    """The first layout: labels from the path, one vowel; repeated ids are an error."""
    p = F.col("relative_path")
    out = audio.withColumns(
        {
            "sample_id": T.sample_id(prefix, p), "base": F.lit(prefix.upper()), "filepath": F.col("path"), "filename": T.file_name(p), "file_stem": T.file_stem(p),
            "file_key": T.normalize_filename_key(p), "folder": F.when(p.contains("/"), F.split(p, "/")[0]), "label": T.label_from_path(p), "vowel": F.lit("a"),
            "pitch": F.lit(None).cast("string"), "samplerate": F.col("sr"), "duration": F.col("file_duration"), "speaker_id": T.sample_id(prefix, p), "speaker_id_source": F.lit("assumed_unique_acoustic_sample"),
        }
    )
    assert_empty(repeated(out, "sample_id"), "repeated sample_id")
    return out.drop("path", "file_duration")


def index_by_recording(audio: DataFrame, prefix: str = "d2") -> DataFrame:
    """The second layout: <group>/<recording>/vowels/<id>-<vowel>_<condition>.nsp; other names are left out."""
    p = F.col("relative_path")
    parsed = audio.withColumn("parsed", T.parse_vowel_filename(T.file_name(p))).filter(F.col("parsed").isNotNull() & p.rlike("(^|/)[^/]+/[^/]+/vowels/[^/]+$"))
    parts = F.split(p, "/")
    group, folder = F.element_at(parts, -4), F.element_at(parts, -3)
    out = parsed.withColumns(
        {
            "sample_id": T.sample_id(prefix, p), "base": F.lit(prefix.upper()), "filepath": F.col("path"), "recording_id": F.col("parsed.recording_id"), "vowel": F.col("parsed.vowel"),
            "condition": F.col("parsed.condition"), "pitch": F.col("parsed.condition"), "pathology_group": group, "pathology_group_key": T.normalize_text(group),
            "recording_id_matches_folder": folder == F.col("parsed.recording_id"), "label": T.label_from_group(T.normalize_text(group)), "duration": F.col("file_duration"), "samplerate": F.col("sr"),
        }
    )
    if out.isEmpty():
        raise CohortError("no recording below the folder")
    return out.drop("path", "parsed", "file_duration")
