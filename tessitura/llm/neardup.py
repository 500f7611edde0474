"""Near-duplicates by b-bit MinHash.

1. Each text becomes the set of its distinct k-word shingles (A-Z lower-cased; a text of fewer words
   is one shingle).  One pass makes the set's size and digest, 128 minima of hash functions, and
   keeps the low 2 bits of each minimum, packed in 32 bytes.  Rows with equal sets are one node
   from here on, so a group of copies of any size is one node.
2. Bands of 5 minima are hashed; nodes that share a band meet.  There the packed signatures are
   compared by bit counts: the share of equal 2-bit lanes, corrected for the quarter that agree by
   chance, estimates the similarity.  A meeting place emits a spanning forest of the pairs whose
   estimate reaches the threshold less a margin of about five standard errors, never all its pairs.
3. Components of that forest are families.  Only their texts are read again, and in each family
   full shingle sets are compared: a breadth-first search emits a spanning forest of the links
   with 100 * intersection >= percent * union, so what it connects is exactly what all links
   connect.
4. Components of those links give each row the smallest doc_id that it reaches.

Meeting places and families of any size are searched whole, in two steps.  First they are dealt into
blocks of bounded size that share some pivots, and what is found in the blocks is joined to components.
Then only nodes of different components are left to compare: those outside the largest component of
the place meet all its blocks and each other, in groups of bounded size.  Copies of one text link with
the pivots, so that the largest component is nearly all of a large family and the second step is small;
only a place crowded with texts that are all unlike costs the square of its blocks.

Bands of 5 out of 25 miss a pair at the threshold with probability (1 - 0.85^5)^25 = 4e-7
(0.8: 5e-5).

A node is a 64-bit digest of its set, and sets are of 64-bit hashes; unlike sets agree with probability 2^-64.

Edge cases: null and empty texts, and texts of separators only, have no shingles and link with
nothing; null ids are never the smallest of a group that has another; repeated rows share a node;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, prepare, ragged, small, utf8, window_hashes, word_hashes, words, written
from .components import components

HASHES, BITS, ROWS = 128, 2, 5
BANDS = HASHES // ROWS
#: Standard error of the estimate at the threshold is under 0.04.
MARGIN = 0.18
#: Nodes whose signatures, and nodes and shingles whose sets, are compared with each other in memory at once.
BLOCK, FAMILY_BLOCK, FAMILY_SHINGLES = 2048, 192, 1 << 21
#: Expected members of a large meeting place that stand in each of its blocks.
PIVOTS = 16
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_LANES = np.uint64(0x5555555555555555)


def shingle_sets(column, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts end to end, and how many each text has."""
    raw, at = utf8(column)
    starts, ends, first = words(raw, at)
    h = word_hashes(raw, starts, ends)
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    where = np.repeat(first[:-1], counts) + ragged(counts)
    out = np.empty(len(where), np.uint64)
    owner = np.repeat(np.arange(len(n)), counts)
    full = n[owner] >= k
    out[full] = window_hashes(h, k)[where[full]]
    for j in range(1, k):
        short = n[owner] == j
        if short.any():
            out[short] = window_hashes(h, j)[where[short]] + np.uint64(j)
    order = np.argsort(out + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
    again = np.zeros(len(out), bool)
    again[order[1:]] = (out[order[1:]] == out[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    keep = ~again
    return out[keep], np.bincount(owner[keep], minlength=len(n)).astype(np.int64)


def _signatures(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, packed low bits and band keys of each non-empty set."""
    begin = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        digest = mix(np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin) + counts.astype(np.uint64))
        x = (sets >> np.uint64(32)).astype(np.uint32)
        minima = np.empty((len(counts), HASHES), np.uint32)
        for i in range(HASHES):
            minima[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], begin)
        low = (mix(minima.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(len(counts), -1, 64 // BITS)
        packed = np.zeros(low.shape[:2], np.uint64)
        for i in range(64 // BITS):
            packed |= low[:, :, i] << np.uint64(BITS * i)
        keys = np.zeros((len(counts), BANDS), np.uint64)
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + minima[:, r : BANDS * ROWS : ROWS] + np.uint64(1))
        keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
    return digest, packed, keys


def _sign(batches, k: int):
    for piece in pieces(batches):
        sets, counts = shingle_sets(piece.column("text"), k)
        full = np.flatnonzero(counts)
        rows = piece.num_rows
        if len(full):
            digest, packed, keys = _signatures(sets, counts[full])
        none = np.ones(rows, bool)
        none[full] = False
        place = np.zeros(rows, np.int64)
        place[full] = np.arange(len(full))

        def spread(values, none=none, place=place):
            return pa.array(values, mask=None).take(pa.array(place, mask=none))

        if len(full):
            node = spread(digest.view(np.int64))
            sig = spread([x.tobytes() for x in packed])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64))).take(pa.array(place, mask=none))
        else:
            node, sig, bands = pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), pa.array(counts), node, sig, bands], names=["doc_id", "text_key", "n_shingles", "node", "sig", "bands"])


def runs(batches, keys: tuple[str, ...]):
    """Tables of consecutive rows with equal keys, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i == j:
                continue
            key = tuple(c[i] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _estimates(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, corrected for lanes that agree by chance."""
    x = sig ^ other
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & _LANES).sum(axis=-1, dtype=np.int64)
    chance = 0.5**BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def _forest(n: int, linked, side: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest by breadth-first search; linked(i, rest) says which of rest link with i.

    Nodes of side 1 are linked with each other already: the search begins at all of them.
    """
    front, rest, out = np.flatnonzero(side).tolist(), np.flatnonzero(side == 0), []
    while len(rest):
        if not front:
            front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            hit = linked(i, rest)
            new = rest[hit]
            out += [(i, int(j)) for j in new]
            front += new.tolist()
            rest = rest[~hit]
        front = []
    return out


def _meet(batches, least: float):
    """Pairs of a spanning forest of each meeting place, by estimates."""

    def emit(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], names=["a", "b"])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    pairs: list[tuple[int, int]] = []

    def pairs_of_two():
        nodes = np.stack([n for n, _ in waiting])
        sigs = np.stack([s for _, s in waiting])
        good = _estimates(sigs[:, 0], sigs[:, 1]) >= least
        return emit(nodes[good, 0], nodes[good, 1])

    for t in runs(batches, ("key", "block")):
        if t.num_rows < 2:
            continue
        nodes, at = np.unique(t.column("node").to_numpy(), return_index=True)
        side = t.column("side").to_numpy()[at]
        if len(nodes) < 2 or side.all():
            continue
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(t.num_rows, -1)[at]
        if len(nodes) == 2:
            waiting.append((nodes, sig))
            if len(waiting) >= 4096:
                yield pairs_of_two()
                waiting.clear()
            continue
        pairs += [(nodes[i], nodes[j]) for i, j in _forest(len(nodes), lambda i, rest, sig=sig: _estimates(sig[rest], sig[i]) >= least, side)]
        if len(pairs) >= 4096:
            yield emit(*zip(*pairs))
            pairs.clear()
    if waiting:
        yield pairs_of_two()
    if pairs:
        yield emit(*zip(*pairs))


def _link(batches, k: int, percent: int):
    """Links of a spanning forest of each family, confirmed on full sets."""
    for t in runs(batches, ("key", "block")):
        nodes, at = np.unique(t.column("node").to_numpy(), return_index=True)
        side = t.column("side").to_numpy()[at]
        if len(nodes) < 2 or side.all():
            continue
        t = t.take(pa.array(at))
        parts = [shingle_sets(p.column("text"), k) for b in t.to_batches() for p in pieces([b])]
        sets, counts = np.concatenate([s for s, _ in parts]), np.concatenate([c for _, c in parts])
        _, column = np.unique(sets, return_inverse=True)
        begin = np.cumsum(counts) - counts
        mark = np.zeros(int(column.max()) + 1, bool)

        def linked(i, rest, column=column, begin=begin, counts=counts, mark=mark):
            hit = np.zeros(len(rest), bool)
            n = counts[i]
            near = np.flatnonzero((100 * np.minimum(counts[rest], n) >= percent * np.maximum(counts[rest], n)))
            if not len(near):
                return hit
            own = column[begin[i] : begin[i] + n]
            mark[own] = True
            sizes = counts[rest[near]]
            where = np.repeat(begin[rest[near]], sizes) + ragged(sizes)
            common = np.add.reduceat(mark[column[where]].astype(np.int64), np.cumsum(sizes) - sizes)
            mark[own] = False
            hit[near] = 100 * common >= percent * (sizes + n - common)
            return hit

        out = _forest(len(nodes), linked, side)
        if out:
            a, b = np.array(out).T
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block")


def _components_within(rows: DataFrame, large: DataFrame, compared) -> DataFrame:
    """node, label: components of the links between nodes of equal key.

    rows: key, node and what compared needs; large: key, members, blocks of keys that must be cut;
    compared(groups of rows with key, block, side) -> a, b: links that connect what all links of a group connect.
    """
    columns = rows.columns
    large = written(large.select("key", "members", "blocks"), "large")
    if large.isEmpty():
        return components(compared(_grouped(rows.withColumn("block", F.lit(0)).withColumn("side", F.lit(0)))))
    # Blocks that share pivots.
    held = rows.join(small(large), "key", "left")
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    pivot = F.pmod(F.xxhash64("key", "node"), F.col("members")) < PIVOTS
    block = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    labels = components(compared(_grouped(held.withColumn("block", F.explode(block)).withColumn("side", F.lit(0)).select(*columns, "block", "side"))))
    # Of keys that are in more than one component yet, all outside the largest one meet the rest.
    cut = rows.join(small(large), "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = cut.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    open_ = most.filter(F.col("most") < F.col("all")).join(large, "key").select(
        F.col("key").alias("open"),
        "main",
        F.greatest(F.lit(1), F.ceil(F.col("blocks") * F.col("most") / F.col("all"))).cast("int").alias("main_blocks"),
        # Two parts of the others share a group.
        F.ceil(2 * F.col("blocks") * (F.col("all") - F.col("most")) / F.col("all")).cast("int").alias("parts"),
    )
    open_ = written(open_, "open")
    if open_.isEmpty():
        return labels
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    main_block = F.pmod(F.xxhash64("node", F.lit(2)), F.col("main_blocks")).cast("int")
    every_part, every_block = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("main_blocks") - 1)
    # Group m * parts + p: block m of the largest component, and part p; after those: parts p <= q.
    with_main = F.transform(every_block, lambda m: m * F.col("parts") + F.col("part"))
    with_others = F.transform(every_part, lambda q: F.col("main_blocks") * F.col("parts") + F.least("part", q) * F.col("parts") + F.greatest("part", q))
    of_main = F.transform(every_part, lambda p: F.col("main_block") * F.col("parts") + p)
    rest = cut.join(small(open_), F.col("key") == F.col("open")).withColumn("side", (F.col("label") == F.col("main")).cast("int"))
    rest = rest.withColumn("part", part).withColumn("main_block", main_block)
    rest = rest.withColumn("block", F.explode(F.when(F.col("side") == 1, of_main).otherwise(F.concat(with_main, with_others))))
    more = compared(_grouped(rest.select(*columns, "block", "side")))
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))


def _families(nodes: DataFrame, percent: int) -> DataFrame:
    """node, label: components of the candidate pairs."""
    rows = nodes.select(F.explode("bands").alias("key"), "node", "sig")
    large = rows.groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > BLOCK)
    least = percent / 100 - MARGIN
    blocks = F.ceil(F.col("members") / (BLOCK // 2)).cast("int")
    return _components_within(rows, large.withColumn("blocks", blocks), lambda groups: groups.mapInArrow(lambda it: _meet(it, least), "a bigint, b bigint"))


def _links(docs: DataFrame, signed: DataFrame, families: DataFrame, k: int, percent: int) -> DataFrame:
    """node, label: components of the links between nodes of a family."""
    # One row stands for each node, so that only repeated rows are read more than once.
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    one = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(first, F.max("n_shingles").alias("n_shingles"))
    member = written(families.withColumnRenamed("label", "key").join(one, "node").select("key", "node", "n_shingles", "first.*"), "members")
    large = member.groupBy("key").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / (FAMILY_BLOCK // 2)), F.ceil(F.col("shingles") / (FAMILY_SHINGLES // 2))).cast("int")
    large = large.filter((F.col("members") > FAMILY_BLOCK) | (F.col("shingles") > FAMILY_SHINGLES)).withColumn("blocks", F.least(blocks, F.col("members").cast("int")))
    chosen = small(member.select("key", "node", F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key")))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    texts = texts.join(chosen, (F.col("text_key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = written(texts.dropDuplicates(["node"]).select("key", "node", "text"), "family-texts")
    return _components_within(texts, large, lambda groups: groups.mapInArrow(lambda it: _link(it, k, percent), "a bigint, b bigint"))


def _clustered(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows (doc_id, text_key, n_shingles, node) and node, component."""
    prepare(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    schema = f"doc_id {id_type}, text_key bigint, n_shingles bigint, node bigint, sig binary, bands array<bigint>"
    signed = written(keyed.mapInArrow(lambda it: _sign(it, k), schema), "signatures")
    nodes = signed.filter(F.col("node").isNotNull()).select("node", "sig", "bands").dropDuplicates(["node"])
    families = written(_families(nodes, percent), "families")
    labels = written(_links(docs, signed, families, k, percent), "labels")
    return signed.drop("sig", "bands"), labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, for each row of docs."""
    signed, labels = _clustered(docs, k, percent)
    least = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    least = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Written, so that the join can be split where a group has many nodes.
    by_label = written(least.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    by_node = written(least.join(by_label, "label").select("node", "component_id"), "components")
    out = signed.join(by_node, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, columns unchanged, but one row only of each near-duplicate group.

    That is the row with the smallest doc_id (nulls last, then by a hash of the text); rows without
    a word stay.
    """
    signed, labels = _clustered(docs, k, percent)
    rows = signed.filter(F.col("node").isNotNull()).groupBy("node", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = written(rows.select("label", "doc_id", "text_key", "copies"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = rows.groupBy("label").agg(F.min(order).alias("first")).select(F.col("label").alias("first_label"), "first.*").drop("no_id")
    first = written(first.withColumnsRenamed({"doc_id": "first_id", "text_key": "first_key"}), "components")
    joined = rows.join(first, F.col("label") == F.col("first_label"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    gone = joined.filter(~is_first | (F.col("copies") > 1)).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), is_first.alias("gone_once"))
    gone = written(gone, "duplicates")

    def same(g: DataFrame):
        return docs["doc_id"].eqNullSafe(g["gone_id"]) & (F.xxhash64(docs["text"]) == g["gone_key"])

    out = docs.join(small(gone), same(gone), "left_anti")
    again = gone.filter("gone_once")
    if not again.isEmpty():  # rows that agree in id and text with the row that stays
        repeated = docs.join(small(again), same(again), "left_semi")
        out = out.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
    return out


def oracle() -> str:
    """DuckDB SQL for near_duplicates(k=3, percent=85) by all pairs of documents that share a shingle."""
    return """
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
      FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
      FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (
      SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
      JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
    reach AS (
      SELECT doc_id AS root, doc_id AS node FROM d
      UNION
      SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.node),
    c AS (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id"""
