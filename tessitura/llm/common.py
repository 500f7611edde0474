"""Shared pieces of the corpus operators: session set-up, shared tables, word splitting.

Words are maximal runs of bytes other than space and 0x09-0x0D.  These bytes are ASCII, so
splitting UTF-8 bytes gives the same words as splitting code points, and numpy can do it for a
whole Arrow batch without making a Python string per word.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch sent to Python.  Texts are a few KB, some over 100 KB.
BATCH_ROWS = 512
#: Bytes of text hashed at once; working arrays take about 40 times as much.
BLOCK_BYTES = 1 << 20
#: Rows of two or three numbers that may be broadcast.
BROADCAST_ROWS = 300_000

_shipped: set[str] = set()
_tables: list[tuple[object, str]] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and this package on every executor.  Safe to call again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.basename(root)
        place = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
        with zipfile.ZipFile(place, "w") as z:
            for folder, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.join(name, os.path.relpath(path, root)))
        spark.sparkContext.addPyFile(place)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where unset (tests) a temporary one.

    Executors on other machines would not see a temporary folder of this one, so with them it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = held.get() if held.isDefined() else f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df written to the shared folder and read again.

    Cuts lineage, so a lost executor repeats reading and not the work above, and makes what is
    above run once.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by written() that nothing reads any more."""
    for t in tables:
        path = t._written_at
        drop(t.sparkSession, path)
        _tables[:] = [x for x in _tables if x[1] != path]


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most BROADCAST_ROWS rows of a few numbers; else a join is shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@atexit.register
def _clean() -> None:
    for spark, path in _tables:
        try:
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:  # the JVM may be gone; the folder is the cluster's own to clean
            continue


# ---------------------------------------------------------------- words in Arrow batches

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (one more than the texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may still own bytes
        held = np.asarray(column.is_valid())
        lengths = np.where(held, np.diff(at), 0)
        keep = np.repeat(held, np.diff(at))
        return raw[keep], np.concatenate([[0], np.cumsum(lengths)])
    return raw, at - at[0]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each text's first word (one more than texts)."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    inside = ~_SEPARATOR[raw]
    first = np.ones(n + 1, bool)  # a word cannot run over the start of a text
    first[1:n] = ~inside[:-1]
    first[at[:-1]] = True
    starts = np.flatnonzero(inside & first[:n])
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:]
    ends_of_text = at[1:][at[1:] > 0] - 1
    last[ends_of_text] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased if asked), by prefix sums of a polynomial."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        p, inverse = _power(hi - lo + 1)
        seg = raw[lo:hi]
        if lower:
            seg = _LOWER[seg]
        with np.errstate(over="ignore"):
            total = np.empty(hi - lo + 1, np.uint64)
            total[0] = 0
            np.cumsum((seg.astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=total[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """For each position the hash of the k word hashes from there on; k - 1 fewer than words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : n + i]
    return mix(out)


def inside_texts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows of k words that lie in one text, and how many each text has."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    where = np.repeat(first[:-1], counts) + ragged(counts)
    return where, counts


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, end to end."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def per_text(values: np.ndarray, counts: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
    """how.reduce over each text's run of values; 0 for texts with none."""
    shape = (len(counts), *values.shape[1:])
    out = np.zeros(shape, values.dtype)
    full = counts > 0
    if full.any():
        out[full] = how.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return out


def gathered(batches, limit: int = 2 * BLOCK_BYTES):
    """Arrow batches joined until they hold the limit of bytes, so that work for each distinct word is shared."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (t := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield t.to_batches()[0]


def pieces(batches, limit: int = 4 * BLOCK_BYTES):
    """Arrow batches cut so that the text in each piece stays near the limit (one text may exceed it)."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        if len(lengths) > at:
            yield b.slice(at)
