"""Recordings as a data source: partitions planned by bytes, summaries from headers.

``spark.read.format("recordings").option("folder", ...)`` gives a row a file: path, relative_path, length, file_sha256 and what
decoding tells.  Options:

* ``signals`` (true): decode the samples.  If false, rate, channels and frames come from the headers of the file's
  chunks, found by seeking, and ``signal`` is null; rows are otherwise the same as with signals.
* ``hashes`` (true): the SHA-256 of the bytes, read in blocks of 1 MB.  If both are false a task reads some
  hundred bytes of a file.
* ``partition_bytes`` (128 MB): most bytes of a partition, unless a file is larger; a file counts for 4 MB more than it
  has where its content is read, so that small files don't crowd a task.
* ``suffixes`` (``wav,nsp``): in any case.

Files are listed where the plan is made, as by Spark's own sources, and opened through pyarrow.fs (file, s3, gs, hdfs).
Names that start with ``_`` or ``.`` are left out.  A file that cannot be decoded has status and error; one that is gone
or can't be read fails the task, which Spark tries again.
"""

from __future__ import annotations

import hashlib
import os
import struct
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import audio

SCHEMA = f"path string, relative_path string, length bigint, file_sha256 string, {audio.DECODED}"
PARTITION_BYTES, OPEN_BYTES, BLOCK_BYTES = 128 << 20, 4 << 20, 1 << 20
#: Bytes of samples that go to the JVM together, unless a file has more.
BATCH_BYTES = 16 << 20


def opened(folder: str) -> tuple[fs.FileSystem, str, str]:
    """File system, its name of the folder, and the folder's URI as Spark writes it."""
    if "://" not in folder:
        local = os.path.abspath(folder.removeprefix("file:"))
        return fs.LocalFileSystem(), local, f"file:{local}"
    system, place = fs.FileSystem.from_uri(folder)
    if folder.startswith("file:"):
        return system, place.rstrip("/"), f"file:{place.rstrip('/')}"
    return system, place.rstrip("/"), folder.rstrip("/")


def wav_header(f, size: int) -> tuple[int, int, int]:
    """Rate, channels and frames that are there; raises as audio.read_wav does."""
    try:
        with wave.open(f) as w:
            width, channels, rate, named = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.getnframes()
            at = f.tell()
        f.seek(4)
        there = min(size, 8 + struct.unpack("<I", f.read(4))[0]) - at  # samples beyond the end of the outer chunk don't count
    except (wave.Error, EOFError) as e:
        raise audio.AudioReadError(f"not a readable WAV file: {e}") from e
    if width not in (1, 2, 3, 4):
        raise KeyError(width)
    return rate, channels, min(named, max(there, 0) // (width * channels))


def nsp_header(f, size: int) -> tuple[int, int, int]:
    """The same of an NSP file, walking over its chunks."""
    if f.read(8) != b"FORMDS16":
        raise audio.AudioReadError("not an NSP file")
    at, rate, parts = 12, None, {}
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name in (b"HEDR", b"HDR8"):
            rate = struct.unpack_from("<I", f.read(min(length, 24)), 20)[0]
        elif name in (b"SDA_", b"SD_A", b"SD_B", b"SDAB"):
            parts[name] = min(length, size - at - 8) // 2
        at += 8 + length + length % 2
    if rate is None or not parts:
        raise audio.AudioReadError("an NSP file without header or samples")
    if b"SDAB" in parts:
        return rate, 2, parts[b"SDAB"] // 2
    return rate, len(parts), min(parts.values())


def header(f, size: int, path: str) -> tuple[int, int, int]:
    low = path.lower()
    if low.endswith(".wav"):
        return wav_header(f, size)
    if low.endswith(".nsp"):
        return nsp_header(f, size)
    raise audio.UnsupportedAudioFormatError(f"unsupported format: {path.rsplit('/', 1)[-1]}")


def digest(f) -> str:
    total = hashlib.sha256()
    while block := f.read(BLOCK_BYTES):
        total.update(block)
    return total.hexdigest()


@dataclass
class Part(InputPartition):
    """Files of a partition: name below the folder, and bytes."""

    files: list[tuple[str, int]]


def planned(files: list[tuple[str, int]], most: int, more: int) -> list[Part]:
    """Files in the given order, cut into parts of at most so many bytes; ``more`` is added for each file."""
    parts, held = [], most + 1
    for name, size in files:
        if held + size + more > most:
            parts.append(Part([]))
            held = 0
        parts[-1].files.append((name, size))
        held += size + more
    return parts


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["folder"]
        self.signals, self.hashes = (options.get(k, "true").lower() == "true" for k in ("signals", "hashes"))
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.suffixes = tuple(f".{s.strip().lower()}" for s in options.get("suffixes", "wav,nsp").split(","))

    def partitions(self) -> list[Part]:
        system, place, _ = opened(self.folder)
        found = system.get_file_info(fs.FileSelector(place, recursive=True))
        names = [(i.path[len(place) :].lstrip("/"), i.size) for i in found if i.type == fs.FileType.File]
        names = sorted((n, s) for n, s in names if n.lower().endswith(self.suffixes) and not any(p[0] in "_." for p in n.split("/")))
        whole = self.signals or self.hashes
        return planned(names if whole else [(n, 0) for n, _ in names], self.most, OPEN_BYTES if whole else OPEN_BYTES >> 4) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, place, uri = opened(self.folder)
        rows, held = [], 0
        for name, _ in partition.files:
            with system.open_input_file(f"{place}/{name}") as f:
                row = self._row(f, f.size(), f"{uri}/{name}", name)
            rows.append(row)
            held += row["signal"].nbytes if row["signal"] is not None else 0
            if held > BATCH_BYTES or len(rows) == 1000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _row(self, f, size: int, path: str, name: str) -> dict:
        row = dict.fromkeys(COLUMNS.names) | {"path": path, "relative_path": name, "length": size, "audio_read_status": "ok"}
        data = f.read() if self.signals else None
        if self.hashes:
            row["file_sha256"] = hashlib.sha256(data).hexdigest() if data is not None else digest(f)
        f.seek(0)
        try:
            x = None
            if data is not None:
                x, rate = audio.decode(data, path)
                channels, frames = 1 if x.ndim == 1 else x.shape[1], len(x)
            else:
                rate, channels, frames = header(f, size, path)
            if not frames:
                raise audio.AudioReadError("empty audio signal")
            mono = x if x is None or x.ndim == 1 else x.mean(axis=1, dtype=np.float64).astype(np.float32)
            row |= {"signal": mono, "sr": rate, "channels": channels, "frames": frames, "file_duration": frames / rate if rate > 0 else 0.0}
        except OSError:
            raise
        except Exception as e:  # one bad file must not fail the others
            row |= {"audio_read_status": "error", "audio_read_error": f"{type(e).__name__}: {e}"}
        return row


COLUMNS = pa.schema(
    [("path", pa.string()), ("relative_path", pa.string()), ("length", pa.int64()), ("file_sha256", pa.string()), ("signal", pa.list_(pa.float32())), ("sr", pa.int32()), ("channels", pa.int32())]
    + [("frames", pa.int64()), ("file_duration", pa.float64()), ("audio_read_status", pa.string()), ("audio_read_error", pa.string())]
)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c.name] for r in rows], c.type) for c in COLUMNS], schema=COLUMNS)


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
