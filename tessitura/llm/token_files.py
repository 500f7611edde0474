"""Token-id files: an independent zstandard frame for each document, with a trailing seek table.

A file is a plain zstandard file in the public seekable layout:

* a frame for each document: its ids as little-endian unsigned 32-bit integers;
* a frame with the index: the number of documents, then their ids, null flags and numbers of tokens;
* a skippable frame with the seek table: for each frame its packed size, plain size and the low 32
  bits of the XXH64 of its plain bytes, then the number of frames, a flag byte and the magic number.

A reader fetches the table from the end of the file, the index, and then only the frames of the
documents it wants, and checks each frame's checksum.

Writing: rows are range-partitioned by doc_id and each partition writes one file under a temporary
name and renames it, so a repeated task writes the same file again.  Files in name order hold
ascending ids.  The number of tokens in each file goes to the driver, one number a file.

Folders may be of any file system that pyarrow opens: file, s3 (also under Hadoop's names s3a and s3n),
gs, abfs, and hdfs where executors have libhdfs.

Edge cases: ids are whole numbers, and null ids come first; equal ids are ordered by text; a null text is empty and becomes
the end id alone; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, pieces, prepare, written
from .subwords import encoder, vocabulary_path

# Numbers of the seekable layout.
SKIPPABLE, SEEKABLE, HAS_CHECKSUM = 0x184D2A5E, 0x8F92EAB1, 0x80
LEVEL = 3
#: The id appended to every document.
END_ID = 1


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub("^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _checksum(plain: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class FrameWriter:
    """Writes documents to an open binary file."""

    def __init__(self, out):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.tokens: list[int] = []

    def _frame(self, plain: bytes) -> None:
        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), _checksum(plain)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.tokens.append(len(ids) // 4)
        self._frame(ids)

    def close(self) -> None:
        n = len(self.ids)
        null = np.array([i is None for i in self.ids], np.uint8)
        held = np.array([i or 0 for i in self.ids], "<i8")
        self._frame(struct.pack("<Q", n) + held.tobytes() + null.tobytes() + np.array(self.tokens, "<i8").tobytes())
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), HAS_CHECKSUM, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Reads documents from a seekable binary file; only what is asked for is unpacked."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        source.seek(-9, io.SEEK_END)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & HAS_CHECKSUM:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(-9 - 12 * n, io.SEEK_END)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        plain = self._frame(n - 1)
        (k,) = struct.unpack_from("<Q", plain)
        ids = np.frombuffer(plain, "<i8", k, 8)
        null = np.frombuffer(plain, np.uint8, k, 8 + 8 * k)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.n_tokens = np.frombuffer(plain, "<i8", k, 8 + 9 * k)

    def _frame(self, i: int) -> bytes:
        packed, plain, checksum = map(int, self.table[i])
        self.source.seek(int(self.at[i]))
        data = self.unpack.decompress(self.source.read(packed), max_output_size=max(plain, 1))
        if len(data) != plain or _checksum(data) != checksum:
            raise ValueError(f"frame {i} is damaged")
        return data

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        return np.frombuffer(self._frame(i), "<u4")

    def find(self, wanted: Iterable[int | None]) -> Iterator[tuple[int | None, np.ndarray]]:
        """The documents with the wanted doc_ids."""
        wanted = set(wanted)
        for i, d in enumerate(self.doc_ids):
            if d in wanted:
                yield d, self.ids(i)


@dataclass(frozen=True)
class TokenFiles:
    """Files in ascending order of their documents: (uri, documents, tokens)."""

    files: list[tuple[str, int, int]]

    def starts(self) -> list[tuple[str, int]]:
        out, at = [], 0
        for uri, _, tokens in self.files:
            out.append((uri, at))
            at += tokens
        return out


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> TokenFiles:
    """Encode all texts and write them to the folder, which all executors must reach."""
    prepare(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()
    end = struct.pack("<I", end_id)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def write(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.ids.zst"
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        hidden = f"{path}/.{name}.{task.taskAttemptId()}"
        encode = encoder(vocabulary).encode
        with store.open_output_stream(hidden) as out:
            w = FrameWriter(out)
            for piece in pieces(gathered(chain([first], batches))):
                ids, n = encode(piece.column("text"))
                packed, stop = ids.tobytes(), (np.cumsum(n) * 4).tolist()
                for d, a, b in zip(piece.column("doc_id").to_pylist(), [0, *stop], stop):
                    w.add(d, packed[a:b] + end)
            w.close()
        store.move(hidden, f"{path}/{name}")
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{name}"]), pa.array([len(w.ids)], pa.int64()), pa.array([sum(w.tokens)], pa.int64())], names=["file", "documents", "tokens"]
        )

    manifest = written(ordered.mapInArrow(write, "file string, documents bigint, tokens bigint"), "token-manifest")
    return TokenFiles(sorted((r["file"], r["documents"], r["tokens"]) for r in manifest.collect()))


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids_crc32, ids (binary) from the files."""
    prepare(spark)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    listed = spark.createDataFrame(files.starts() or [], "file string, start bigint")

    def read(batches):
        for b in batches:
            for uri, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                store, path = _open(uri)
                with store.open_input_file(path) as source:
                    r = FrameReader(source)
                    for lo in range(0, len(r), 256):
                        ids = [r.ids(i).tobytes() for i in range(lo, min(lo + 256, len(r)))]
                        n = np.array([len(x) // 4 for x in ids], np.int64)
                        begin = start + np.cumsum(n) - n
                        start += int(n.sum())
                        crc = [zlib.crc32(x) for x in ids]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(r.doc_ids[lo : lo + 256], pa.int64()), pa.array(begin), pa.array(n), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                        )

    return listed.repartition(max(1, len(files.files))).mapInArrow(read, schema)
