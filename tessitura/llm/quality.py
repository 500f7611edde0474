"""Quality rules: compression bands.

A text is compressed with zstandard as a whole and in fixed chunks.  The ratio of plain to packed
bytes is high for repetitive and low for incompressible text, and it rises with length, so each
length has its own limits.  A text is rejected when its whole ratio leaves the band of its length,
or when too many of its chunks leave the chunk band (a noisy or repeated stretch in a long text).

The limits stand well outside of what clean text gives: of documents labelled clean the ratios are
0.88-1.74, 1.34-1.97, 1.72-2.22, 2.12-2.41 and 2.34-2.48 in the five bands, and 1.47-2.01 for chunks.

Edge cases: a null text counts as empty; texts under the first band's length have no limit by
compression, and the word rules below judge them.  Texts are processed whole, however long.  Each
row is judged on its own, so repeated rows get equal verdicts; an empty table gives an empty result;
other columns don't take part.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SEPARATOR, inside_texts, per_text, pieces, prepare, utf8, window_hashes, word_hashes, words

#: (bytes from which the band holds, least ratio, greatest ratio).
BANDS = ((64, 0.70, 2.6), (256, 1.10, 3.0), (1024, 1.35, 3.5), (4096, 1.50, 4.0), (16384, 1.60, 5.0))
#: Bytes of a chunk, the least last chunk that counts, and the band of a chunk's ratio.
CHUNK, LEAST_CHUNK, CHUNK_BAND = 1024, 512, (1.25, 3.5)
#: Share of chunks outside their band that rejects a text.
CHUNK_SHARE = 0.3
LEVEL = 3
#: Words a text must have, and percent of words that may lie in repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, ratio double, bad_chunks bigint, n_chunks bigint, reason string"
)
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_LEAD = np.ones(256, np.int64)  # bytes that begin a code point
_LEAD[0x80:0xC0] = 0
_LEAD[_SEPARATOR] = 0
_BLANK = b" \t\n\v\f\r"


def _repeated_words(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Per text: words in windows of k words that stand in that text twice or more."""
    where, counts = inside_texts(first, k)
    if not len(where):
        return np.zeros(len(first) - 1, np.int64)
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key = window_hashes(h, k)[where] + text * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, where[twice], 1)
    np.add.at(edge, where[twice] + k, -1)
    covered = (np.cumsum(edge[:-1]) > 0).astype(np.int64)
    return per_text(covered, np.diff(first))


def _repeated_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def measure(
    text: Column,
    bands: Sequence[tuple[int, float, float]] = BANDS,
    chunk: int = CHUNK,
    chunk_band: tuple[float, float] = CHUNK_BAND,
    chunk_share: float = CHUNK_SHARE,
) -> Column:
    """struct of word counts, compression ratio and verdict of a text column (fields in RESULT)."""
    bands = sorted(bands)

    def packed(z, text: bytes) -> tuple[float, int, int, str | None]:
        n = len(text)
        ratio = n / len(z.compress(text)) if n else 0.0
        low, high = 0.0, float("inf")
        for least, a, b in bands:
            if n >= least:
                low, high = a, b
        bad = chunks = 0
        for i in range(0, n, chunk):
            part = text[i : i + chunk]
            if len(part) >= LEAST_CHUNK:
                r = len(part) / len(z.compress(part))
                chunks += 1
                bad += not chunk_band[0] <= r <= chunk_band[1]
        if ratio > high:
            return ratio, bad, chunks, "repetitive"
        if ratio < low:
            return ratio, bad, chunks, "incompressible"
        return ratio, bad, chunks, "chunks" if chunks and bad > chunk_share * chunks else None

    @F.arrow_udf(RESULT)
    def measured(texts: pa.Array) -> pa.Array:
        import zstandard

        z = zstandard.ZstdCompressor(level=LEVEL)
        out: list[list] = []
        for piece in pieces([pa.RecordBatch.from_arrays([texts], ["text"])]):
            raw, at = utf8(piece.column("text"))
            starts, ends, first = words(raw, at)
            n = np.diff(first)
            size = np.diff(at)
            repeated = _repeated_words(word_hashes(raw, starts, ends, lower=False), first, WINDOW)
            chars, symbols = per_text(_LEAD[raw], size), per_text(_SYMBOL[raw], size)
            data = raw.tobytes()
            plain = [data[a:b] for a, b in zip(at[:-1], at[1:])]
            ratio, bad, chunks, reason = zip(*(packed(z, t) for t in plain))
            failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
            kept = ~failed & np.array([r is None for r in reason])
            why = ["words" if a < LEAST_WORDS else "repeated words" if f else r for a, f, r in zip(n, failed, reason)]
            lines = [_repeated_lines(t) for t in plain]
            columns = [n, chars, symbols, lines, repeated, failed, kept, ratio, bad, chunks, why]
            out.append([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)])
        if not out:
            return pa.array([], _KIND)
        return pa.StructArray.from_arrays([pa.concat_arrays(c) for c in zip(*out)], fields=list(_FIELDS))

    return measured(text)


_TYPES = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
_FIELDS = [pa.field(n, _TYPES[t]) for n, t in (x.split() for x in RESULT.split(", "))]
_KIND = pa.struct(_FIELDS)


def quality_measures(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the fields of measure() for each row of docs."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", measure(F.col("text"), **options).alias("m")).select("doc_id", "m.*")


def quality_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns unchanged, that the rules keep.  No shuffle."""
    prepare(docs.sparkSession)
    return docs.filter(measure(F.col("text"), **options)["kept"])
