"""Benchmark decontamination by spaced-seed hashing.

A document and an item overlap if, laid on each other without gaps,

* a stretch of LEAST_WORDS words or more, from an equal word to an equal word, has LEAST_SHARE of its
  words equal, or
* LEAST_SHARE of the item's words are equal to those they lie on, however short the item is.

A mask selects some positions of a window of words; the hash of the selected words is the same
whatever stands at the others, so a few masks find passages in which words were substituted.
Together they hit every overlap of items of LEAST_WORDS words or more: a pattern of equal and changed
words that no mask hits has less than LEAST_SHARE equal (tests/llm/test_decontaminate.py counts all).
Shorter items have masks of their own, made so that every allowed choice of changed words leaves one
whole; texts are hashed under these only if the benchmark has items of that length.

Windows of all texts are hashed under each mask.  A Bloom bitmap of fixed size, made from the
benchmark's hashes, drops nearly all windows at once; the rest are joined with the benchmark's
hashes by Spark, so no side needs to be small.  Each joined diagonal is then aligned word by word,
as far as the item reaches.

Words are lower-cased (A-Z) and freed of all ASCII punctuation at both ends; a word of nothing else
stays whole.  Items of fewer than LEAST_ITEM words (a parameter) are not looked for: with least_item=1
they are found where they stand unchanged, which is nearly everywhere for an item like "yes".
Edge cases: null or empty texts and items match nothing; repeated items count as one text with
several ids; repeated rows are found each; ids may be null; an empty table on either side gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, prepare, ragged, small, utf8, word_hashes, words, written

#: The masks: 1 selects a word.
MASKS = ("1101111", "111010011", "11100100011")
#: Words of the shortest item looked for.
LEAST_ITEM = 5
#: Words looked at on each side of the hits; more if an item is longer.
RADIUS = 64
#: Words of an overlap, unless it is of the whole item, and the share of them that are equal.
LEAST_WORDS, LEAST_SHARE = 12, 0.8
#: Words that a mask for shorter items selects at most.
SHORT_WEIGHT = 6
#: Bits of the bitmap.
BLOOM_BITS = 24

_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def _normal_words(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalized words, and each text's first."""
    raw, at = utf8(column)
    starts, ends, first = words(raw, at)
    core = np.flatnonzero(~_PUNCT[raw])
    cut = np.flatnonzero(_PUNCT[raw[starts]] | _PUNCT[raw[ends - 1]])
    lo, hi = np.searchsorted(core, starts[cut]), np.searchsorted(core, ends[cut])
    some = hi > lo
    starts, ends = starts.copy(), ends.copy()
    starts[cut[some]], ends[cut[some]] = core[lo[some]], core[hi[some] - 1] + 1
    return word_hashes(raw, starts, ends), first


def _masked(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (salt * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(mask):
            if c == "1":
                out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : n + i]
    return mix(out)


def _in_text(first: np.ndarray, span: int) -> np.ndarray:
    counts = np.maximum(np.diff(first) - span + 1, 0)
    return np.repeat(first[:-1], counts) + ragged(counts)


def short_masks(length: int, share: float = LEAST_SHARE) -> list[str]:
    """Masks for items of so many words: whichever words are changed, as many as the share allows, one mask fits beside them."""
    changed = most_changed(length, share)
    weight = min(SHORT_WEIGHT, length - changed)
    left = {frozenset(range(length)) - set(c) for c in combinations(range(length), changed)}
    masks = []
    while left:
        # Of all masks of this weight the one that hits most of what is left; the first of equals.
        best = max(combinations(range(length), weight), key=lambda m: sum(_fits(m, length, p) for p in left))
        masks.append("".join("1" if i in best else "0" for i in range(best[0], best[-1] + 1)))
        left = {p for p in left if not _fits(best, length, p)}
    return masks


def _fits(mask: tuple[int, ...], length: int, equal: frozenset) -> bool:
    return any(all(i - mask[0] + s in equal for i in mask) for s in range(length - mask[-1] + mask[0]))


def most_changed(n: int, share: float) -> int:
    """How many of n words may differ."""
    return int(n * (1 - share) + 1e-9)


def _families(masks: Sequence[str], share: float, lengths: Sequence[int]):
    """(salt, mask, length of items or None for those of LEAST_WORDS or more) of all masks in use."""
    out = [(k, mask, None) for k, mask in enumerate(masks)]
    return out + [(100 * n + k, mask, n) for n in lengths for k, mask in enumerate(short_masks(n, share))]


def _seeds_of(batches, masks: Sequence[str], share: float, least_words: int, least_item: int):
    """hash, item, position for each mask and window of the items."""
    for b in batches:
        for piece in pieces([b]):
            h, first = _normal_words(piece.column("text"))
            keys = np.asarray(piece.column("item").to_numpy())
            n = np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            short = [int(k) for k in np.unique(n) if least_item <= k < least_words]
            for salt, mask, length in _families(masks, share, short):
                where = _in_text(first, len(mask))
                size = n[owner[where]]
                where = where[size >= least_words if length is None else size == length]
                if len(where):
                    hashes, i = _masked(h, mask, salt)[where], owner[where]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes.view(np.int64)), pa.array(keys[i]), pa.array((where - first[:-1][i]).astype(np.int32))], names=["hash", "item", "item_pos"]
                    )


def _item_words(batches):
    for b in batches:
        h, first = _normal_words(b.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("item"), lists], names=["item", "item_words"])


def _bloom_slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - BLOOM_BITS), (h >> np.uint64(8)) & np.uint64((1 << BLOOM_BITS) - 1)


def row_key() -> Column:
    """Tells rows apart by id and text."""
    return F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.length("text").alias("text_length"))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: Sequence[str] = MASKS,
    radius: int = RADIUS,
    least_words: int = LEAST_WORDS,
    least_share: float = LEAST_SHARE,
    least_item: int = LEAST_ITEM,
) -> DataFrame:
    """key (row_key of the document), item_id, doc_start, item_start, n_words, n_equal: each verified overlap.

    Starts count words; n_words is the length of the aligned stretch and n_equal its equal words.  The masks
    given here are proven for the default least_words and least_share; others need others.
    """
    spark = prepare(docs.sparkSession)
    span = max(least_words, *map(len, masks))
    # Items of one text are looked for once.
    texts = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text", F.xxhash64("text").alias("item"))
    distinct = texts.groupBy("item").agg(F.min("text").alias("text"))
    seeds = written(distinct.mapInArrow(lambda it: _seeds_of(it, masks, least_share, least_words, least_item), "hash bigint, item bigint, item_pos int").distinct(), "seeds")
    item_words = written(distinct.mapInArrow(_item_words, "item bigint, item_words array<bigint>"), "items")
    # Two slots a hash, at most 2^BLOOM_BITS distinct numbers whatever the benchmark's size.
    slot = F.explode(F.array(F.shiftrightunsigned("hash", 64 - BLOOM_BITS), F.shiftrightunsigned("hash", 8).bitwiseAND((1 << BLOOM_BITS) - 1)))
    slots = seeds.select(slot.alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bits = np.zeros(1 << BLOOM_BITS, bool)
    bits[slots] = True
    packed = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    # A diagonal is no longer than its item, so all of it lies in the stretch.
    radius = max(radius, item_words.agg(F.max(F.size("item_words"))).first()[0] or 0)
    lengths = [r["n"] for r in item_words.select(F.size("item_words").alias("n")).filter(F.col("n").between(least_item, least_words - 1)).distinct().collect()]

    families = _families(masks, least_share, sorted(lengths))

    def known(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
        a, b = _bloom_slots(h)
        hit = np.flatnonzero((bitmap[(a >> np.uint64(3)).astype(np.int64)] >> (a & np.uint64(7)).astype(np.uint8)) & 1)
        b = b[hit]
        return hit[((bitmap[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]

    def scan(batches):
        bitmap = np.frombuffer(packed.value, np.uint8)
        for piece in pieces(batches):
            h, first = _normal_words(piece.column("text"))
            n = np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            found = []
            for salt, mask, _ in families:
                hashes = _masked(h, mask, salt)
                hit = known(bitmap, hashes)
                hit = hit[hit + len(mask) <= first[1:][owner[hit]]] if len(hit) else hit  # a window lies in one text
                found.append((hit, hashes[hit]))
            pos = np.concatenate([p for p, _ in found])
            if not len(pos):
                continue
            order = np.argsort(pos, kind="stable")
            pos, hashes = pos[order], np.concatenate([x for _, x in found])[order]
            # Hits of one text that lie within the radius of each other share a stretch of words.
            new = np.ones(len(pos), bool)
            new[1:] = (owner[pos[1:]] != owner[pos[:-1]]) | (np.diff(pos) > radius)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(pos))
            text = owner[pos[begin]]
            lo = np.maximum(pos[begin] - radius, first[:-1][text])
            hi = np.minimum(pos[end - 1] + span + radius, first[1:][text])
            part = [h[a:b].view(np.int64) for a, b in zip(lo, hi)]
            rows = [
                piece.column("key").take(pa.array(text)),
                pa.array((lo - first[:-1][text]).astype(np.int64)),
                pa.array(part, pa.list_(pa.int64())),
                pa.array([list(zip(hashes[a:b].view(np.int64).tolist(), (pos[a:b] - s).tolist())) for a, b, s in zip(begin, end, lo)], pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays(rows, names=["key", "begin", "stretch", "hits"])

    keyed = docs.select(row_key().alias("key"), "text")
    key_type = keyed.schema["key"].dataType.simpleString()
    stretches = keyed.mapInArrow(scan, f"key {key_type}, begin bigint, stretch array<bigint>, hits array<struct<hash:bigint,pos:int>>")
    stretches = written(stretches.withColumn("id", F.monotonically_increasing_id()), "stretches")
    hits = stretches.select("id", F.explode("hits").alias("hit")).select("id", "hit.*")
    diagonals = hits.join(seeds, "hash").groupBy("id", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.min("pos").alias("pos"))
    pairs = diagonals.join(stretches.drop("hits"), "id").join(item_words, "item")

    def verify(batches):
        for b in batches:
            out = []
            for i, (doc, item, shift, begin) in enumerate(zip(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("stretch", "item_words", "shift", "begin")))):
                # Position p of the stretch lies on position p - shift of the item.
                a, e = max(0, shift), min(len(doc), len(item) + shift)
                equal = np.asarray(doc[a:e]) == np.asarray(item[a - shift : e - shift])
                best = _longest(equal, least_share)
                if best and best[1] - best[0] < least_words and int(equal.sum()) < len(item) - most_changed(len(item), least_share):
                    best = None
                if best:
                    out.append((i, begin + a + best[0], a + best[0] - shift, best[1] - best[0], int(equal[best[0] : best[1]].sum())))
            if out:
                rows, *columns = zip(*out)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").take(at), b.column("item").take(at), *(pa.array(c, pa.int64()) for c in columns)],
                    names=["key", "item", "doc_start", "item_start", "n_words", "n_equal"],
                )

    kinds = f"key {key_type}, item bigint, doc_start bigint, item_start bigint, n_words bigint, n_equal bigint"
    verified = pairs.select("key", "item", "begin", "shift", "stretch", "item_words").mapInArrow(verify, kinds)
    return verified.join(texts.select("item", "item_id"), "item").drop("item")


def _longest(equal: np.ndarray, share: float) -> tuple[int, int] | None:
    """The longest stretch from an equal word to an equal word with that share equal; the first of such."""
    at = np.flatnonzero(equal)
    if not len(at):
        return None
    # Words gain 1 - share if equal and lose share if not; a stretch has the share if it does not lose.
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - share, -share))])
    lowest = np.minimum.accumulate(total[at])  # over where a stretch may begin
    begin = np.searchsorted(-lowest, -(total[at + 1] + 1e-9))
    size = at + 1 - at[begin]
    best = int(size.argmax())
    return int(at[begin[best]]), int(at[best]) + 1


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id and the longest overlap of each document and item that overlap."""
    found = overlaps(docs, benchmark, **options)
    longest = F.max_by(F.struct("doc_start", "item_start", "n_words", "n_equal"), F.struct("n_equal", -F.col("doc_start"))).alias("o")
    return found.groupBy(F.col("key.doc_id").alias("doc_id"), "item_id").agg(longest).select("doc_id", "item_id", "o.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, columns unchanged, that overlap with no benchmark item."""
    found = overlaps(docs, benchmark, **options).select("key.*").distinct()
    found = small(written(found.toDF("leak_id", "leak_hash", "leak_length"), "leaks"))
    same = docs["doc_id"].eqNullSafe(found["leak_id"]) & (F.xxhash64(docs["text"]) == found["leak_hash"]) & (F.length(docs["text"]) == found["leak_length"])
    return docs.join(found, same, "left_anti")
