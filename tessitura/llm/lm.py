"""Language-model scoring: a unigram base and a causal self-attention model on subword ids.

Both learn from all training rows.

* Base: words are counted by 64-bit hash, each task first on its own, then by Spark.  A text's
  frequent words are looked up in a table of fixed size that every worker holds, in which the most
  frequent word of each slot stands, and in a list of the others that make up over a part in COMMON
  of the training words; all other words are joined with the counts by Spark, so the vocabulary may
  grow without bound and no key of the join is hot.
* Model: subword ids are counted, with the class of the id before them.  The most frequent ids are
  classes of their own, and the others are grouped into classes by k-means on what stands before
  them.  The model predicts the next class, by a softmax over branches of like classes and one inside
  the branch, from a context of 32 ids; an id's probability is its class's times its share of the
  class among what followed the same frequent id in training (or another), smoothed by its share of
  the class overall.
* Training: the weights start from a short training in one task on START_WINDOWS windows or so,
  drawn from all training windows by a hash.  Then the model is trained on every window of every
  training row, once, in ROUNDS rounds of averaging.  A hash of id and text deals the rows to shards of about SHARD_WORDS words;
  in each round every shard trains on its part of its windows from the current weights, and Spark
  averages the weights, weighed by windows.  What a task holds is bounded: a shard that is too large
  for MOST_IDS (rows equal in id and text) is cut, and its parts train like shards.
* Scoring: windows of 32 targets overlap by OVERLAP; the first window of a text scores all its
  positions and later ones only the new, so each id, and the end of the text, is scored once.

Neither the partitions of the input nor the order of its rows matter: the same rows give the same
scores but for rounding.  That is so for rows that have an id; others are dealt to shards by position.

Edge cases: a null text is empty: one end token.  With no training row the base counts are 0 and
the model is uniform over classes.  Null ids hash as empty text in fold().  Repeated rows get equal
scores; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .attention import CONTEXT, Params
from .common import gathered, mix, pieces, prepare, ragged, utf8, word_hashes, words, written
from .subwords import encoder, vocabulary_path

#: Slots of the table of frequent words; a word is common from one in so many training words (so COMMON words are at most).
HEAD_BITS, COMMON = 20, 10_000
#: Ids with a class of their own, and ids with an input of their own.  The other classes are groups of ids.
OWN_CLASSES, OWN_INPUTS = 600, 2047
CLASSES = attention.BRANCHES * attention.LEAVES
#: Frequent ids told apart as what stands before an id, and the weight of an id's share of its class against counts after that.
BEFORE, PRIOR = 63, 50.0
#: Positions by which windows overlap when texts are scored; in training each id is a target once.
OVERLAP = 4
#: Words of a shard (about), the most shards, and ids that a task trains on at most before it begins another part.
SHARD_WORDS, MOST_SHARDS, MOST_IDS = 1 << 20, 1 << 14, 1 << 23
#: Rounds of averaging; each window belongs to one of them, so all are trained on.
ROUNDS = 2
#: Texts whose windows are built together, and windows of several such groups that are mixed.
GROUP_TEXTS, MIXED_WINDOWS = 64, 8192
#: Windows (about) from which one task makes the first weights, and passes over them.
START_WINDOWS, START_PASSES = 32768, 10
BATCH, START_RATE, RATE = 128, 0.015, 0.006
#: Windows that go through the model at once.
SCORED_AT_ONCE = 128

STEP = CONTEXT - OVERLAP


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id's text modulo a number; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# ------------------------------------------------------------------ base


def _count_words(batches):
    """word (hash) and n, summed in part.  Words that came first to a slot of a table are counted there, others by sorting."""
    key, count = np.zeros(1 << HEAD_BITS, np.uint64), np.zeros(1 << HEAD_BITS, np.int64)
    held, n = [], 0

    def given(word, times):
        for lo in range(0, len(word), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(word[lo : lo + 65536].view(np.int64)), pa.array(times[lo : lo + 65536])], names=["word", "n"])

    def sorted_out():
        return given(*np.unique(np.concatenate(held), return_counts=True))

    for piece in pieces(gathered(batches)):
        raw, at = utf8(piece.column("text"))
        starts, ends, _ = words(raw, at)
        h = word_hashes(raw, starts, ends)
        slot = (h >> np.uint64(64 - HEAD_BITS)).astype(np.int32)
        free = count.take(slot) == 0
        key[slot[free]] = h[free]  # the last of each free slot stays
        known = key.take(slot) == h
        count += np.bincount(slot[known], minlength=len(count))
        held.append(h[~known])
        n += len(held[-1])
        if n > 4_000_000:
            yield from sorted_out()
            held, n = [], 0
    if held:
        yield from sorted_out()
    some = np.flatnonzero(count)
    yield from given(key[some], count[some])


@dataclass(frozen=True)
class WordCounts:
    """counts: word (hash), n; head: frequent words and counts by slot, then those of common words that have no slot; totals of the training rows."""

    counts: DataFrame
    head: object
    documents: int
    tokens: int
    distinct: int

    @property
    def unit(self) -> float:
        """log10 of the denominator."""
        return float(np.log10(self.tokens + self.distinct + 1))


def count_words(train: DataFrame) -> WordCounts:
    spark = prepare(train.sparkSession)
    counts = written(train.select("text").mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    row = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    documents = train.count()
    # The most frequent word of each slot; the number of slots is fixed.  Words that occur once are left to the join.
    slot = F.shiftrightunsigned("word", 64 - HEAD_BITS)
    best = counts.filter("n > 1").groupBy(slot.alias("slot")).agg(F.max(F.struct("n", "word")).alias("w")).select("slot", "w.word", "w.n").toArrow()
    head_word, head_n = np.zeros(1 << HEAD_BITS, np.uint64), np.zeros(1 << HEAD_BITS, np.int64)
    at = best.column("slot").to_numpy()
    head_word[at] = best.column("word").to_numpy().view(np.uint64)
    head_n[at] = best.column("n").to_numpy()
    common = counts.filter(F.col("n") * COMMON > row["n"]).select("word", "n").toArrow()
    word, n = common.column("word").to_numpy().view(np.uint64), common.column("n").to_numpy()
    lost = head_word[(word >> np.uint64(64 - HEAD_BITS)).astype(np.int64)] != word
    word, n = word[lost], n[lost]
    order = np.argsort(word)
    head = spark.sparkContext.broadcast((head_word, head_n, word[order], n[order]))
    return WordCounts(counts, head, documents, row["n"] + documents, row["v"] + (documents > 0))


# ------------------------------------------------------------------ one pass over all texts


def encoded(docs: DataFrame, counts: WordCounts, vocabulary: str) -> DataFrame:
    """row, doc_id, train, key, shard, n_words, n_head, head_sum, tail (hashes of other words), n_ids, ids (16 bits each, packed).

    The rows of a shard lie together in one file, in the order of their keys.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    head = counts.head
    shards = min(MOST_SHARDS, 1 + counts.tokens // SHARD_WORDS)

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        head_word, head_n, more_word, more_n = head.value
        encode = encoder(vocabulary, "<u2").encode
        logs, more_logs = np.log10(head_n + 1.0), np.log10(more_n + 1.0)
        for piece in pieces(gathered(batches)):
            raw, at = utf8(piece.column("text"))
            starts, ends, first = words(raw, at)
            h = word_hashes(raw, starts, ends)
            ids, n_ids = encode(piece.column("text"))
            id_ends = np.cumsum(n_ids) * 2
            packed, plain = [], ids.tobytes()
            for a, b in zip((id_ends - n_ids * 2).tolist(), id_ends.tolist()):
                packed.append(pack(plain[a:b]))
            slot = (h >> np.uint64(64 - HEAD_BITS)).astype(np.int64)
            known = (head_word[slot] == h) & (head_n[slot] > 0)
            text = np.repeat(np.arange(piece.num_rows), np.diff(first))
            sums = np.bincount(text[known], logs[slot[known]], piece.num_rows).astype(np.float64)
            if len(more_word):
                rest = np.flatnonzero(~known)
                at = np.minimum(np.searchsorted(more_word, h[rest]), len(more_word) - 1)
                hit = more_word[at] == h[rest]
                sums += np.bincount(text[rest[hit]], more_logs[at[hit]], piece.num_rows)
                known[rest[hit]] = True
            n_head = np.bincount(text[known], minlength=piece.num_rows).astype(np.int64)
            tail = h[~known].view(np.int64)
            cuts = np.concatenate([[0], np.cumsum(~known)])[first].astype(np.int32)
            columns = [
                *(piece.column(c) for c in ("doc_id", "train", "key", "shard")),
                pa.array(np.diff(first)),
                pa.array(n_head),
                pa.array(sums),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(tail)),
                pa.array(n_ids),
                pa.array(packed, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "train", "key", "shard", "n_words", "n_head", "head_sum", "tail", "n_ids", "ids"])

    schema = f"doc_id {id_type}, train boolean, key bigint, shard int, n_words bigint, n_head bigint, head_sum double, tail array<bigint>, n_ids bigint, ids binary"
    # Equal texts with ids go to different shards; rows without an id are dealt by position.
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id", "text"))
    keyed = docs.withColumn("key", key).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    dealt = keyed.select("doc_id", "train", "key", "shard", "text").mapInArrow(run, schema).repartition(shards, "shard").sortWithinPartitions("shard", "key")
    return written(dealt.withColumn("row", F.monotonically_increasing_id()), "encoded")


def base_scores(rows: DataFrame, counts: WordCounts) -> DataFrame:
    """row, n_tail, tail_sum: known words and log10 counts of the words outside the table."""
    tail = rows.select("row", F.explode("tail").alias("word"))
    found = tail.join(counts.counts, "word")
    return found.groupBy("row").agg(F.count("*").alias("n_tail"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("tail_sum"))


# ------------------------------------------------------------------ model


@dataclass(frozen=True)
class Classes:
    """Of each id its class and input; the class of a text's end.  Input 0 is the begin of a text."""

    class_of: np.ndarray
    input_of: np.ndarray
    end: int


@dataclass(frozen=True)
class Model:
    """params; classes; of each id its number as what stands before, and its log10 share of its class after each such."""

    params: Params
    classes: Classes
    before_of: np.ndarray
    log_share: np.ndarray


def _ids(binary) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end, and each text's number of ids, of packed ids."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    plain = [unpack(x) for x in binary.to_pylist()]
    return np.frombuffer(b"".join(plain), "<u2"), np.array([len(x) // 2 for x in plain], np.int64)


def _count_ids(n_ids: int):
    def run(batches):
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            total += np.bincount(_ids(b.column("ids"))[0], minlength=n_ids)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(total[i])], names=["id", "n"])

    return run


def _before(ids: np.ndarray, n: np.ndarray, before_of: np.ndarray) -> np.ndarray:
    """What stands before each id: a frequent id's number, another (BEFORE), or a text's begin (BEFORE + 1)."""
    out = np.empty(len(ids), np.int64)
    if len(ids):
        out[1:] = before_of[ids[:-1]]
        out[(np.cumsum(n) - n)[n > 0]] = BEFORE + 1
    return out


def _count_before(n_ids: int, before_of: np.ndarray):
    """How often each id follows each frequent id, another, or a text's begin."""
    k = BEFORE + 2

    def run(batches):
        total = np.zeros(n_ids * k, np.int64)
        held, size = [], 0
        for b in batches:
            ids, n = _ids(b.column("ids"))
            held.append(ids.astype(np.int64) * k + _before(ids, n, before_of))
            size += len(ids)
            if size > 2_000_000:
                total += np.bincount(np.concatenate(held), minlength=n_ids * k)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=n_ids * k)
        i = np.flatnonzero(total)
        for lo in range(0, len(i), 65536):
            part = i[lo : lo + 65536]
            yield pa.RecordBatch.from_arrays([pa.array((part // k).astype(np.int32)), pa.array((part % k).astype(np.int32)), pa.array(total[part])], names=["id", "before", "n"])

    return run


def _groups(profile: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k-means of rows (square roots of distributions), weighted; starts at the heaviest rows."""
    x = np.sqrt(profile / np.maximum(profile.sum(axis=1, keepdims=True), 1))
    centre = x[np.argsort(-weight, kind="stable")[:k]].copy()
    for _ in range(12):
        near = np.argmax(x @ centre.T - 0.5 * (centre * centre).sum(axis=1), axis=1)
        for j in range(len(centre)):
            own = near == j
            if own.any():
                centre[j] = np.average(x[own], axis=0, weights=weight[own])
    return near


def _tree(profile: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """The number (branch * leaves + leaf) of each class: branches are groups of like profiles, equal in number."""
    x = np.sqrt((profile + 1e-9) / (profile + 1e-9).sum(axis=1, keepdims=True))
    by_mass = np.argsort(-mass, kind="stable")
    centre = x[by_mass[: attention.BRANCHES]].copy()
    for _ in range(8):
        near = x @ centre.T
        branch, room = np.zeros(len(x), np.int64), np.full(attention.BRANCHES, attention.LEAVES)
        for i in by_mass:
            branch[i] = np.argmax(np.where(room > 0, near[i], -1.0))
            room[branch[i]] -= 1
        for j in range(len(centre)):
            own = branch == j
            centre[j] = np.average(x[own], axis=0, weights=mass[own] + 1.0)
    order = np.argsort(branch, kind="stable")
    code = np.empty(len(x), np.int64)
    code[order] = np.arange(len(x))  # each branch is full
    return code


def window_count(n: np.ndarray, step: int) -> np.ndarray:
    """Windows of texts of n ids and their ends."""
    return 1 + np.maximum(-(-(n + 1 - CONTEXT) // step), 0)


def windows(ids: np.ndarray, n: np.ndarray, m: Classes, step: int, chosen=None):
    """Inputs, target classes, text, held and scored mask of windows over texts of n ids each and their ends.

    chosen: function of (text, window number) -> mask of windows to build.
    """
    tokens = n + 1  # with the end
    stop = np.cumsum(tokens)
    total = int(stop[-1]) if len(stop) else 0
    is_id = np.ones(total, bool)
    is_id[stop - 1] = False
    # Numbers fit in 16 bits.  The last window may reach beyond the last text.
    target = np.full(total + CONTEXT, m.end, np.uint16)
    target[:total][is_id] = m.class_of.take(ids)
    # The input is what stands before; before a text stands the end of another, which reads as 0 too.
    own = np.zeros(total + CONTEXT + 1, np.uint16)
    own[1 : total + 1][is_id] = m.input_of.take(ids)
    count = window_count(n, step)
    text = np.repeat(np.arange(len(n)), count)
    number = ragged(count)
    if chosen is not None:
        keep = chosen(text, number)
        text, number = text[keep], number[keep]
    start = (stop - tokens)[text] + number * step
    held = _PLACES < (stop[text] - start)[:, None]
    scored = held.copy()
    scored[number > 0, : CONTEXT - step] = False
    x, y = (np.lib.stride_tricks.sliding_window_view(a, CONTEXT).take(start, axis=0) for a in (own, target))
    return x, y, text, held, scored


_PLACES = np.arange(CONTEXT)


def _train(p: Params, x, y, held, rate: float, passes: int, seed: int) -> Params:
    """Adam over the windows in random order; the rate falls to nothing along the way."""
    rng = np.random.default_rng(seed)
    adam = attention.Adam({k: v.copy() for k, v in p.items()}, rate)
    steps = passes * -(-len(x) // BATCH)
    for _ in range(passes):
        _pass(adam, x, y, held, rng.permutation(len(x)), rate, steps)
    return adam.p


def _pass(adam: attention.Adam, x, y, held, order: np.ndarray, rate: float, steps: int) -> None:
    for lo in range(0, len(order), BATCH):
        part = order[lo : lo + BATCH]
        adam.rate = rate * max(0.0, 1 - adam.t / steps)
        adam.step(attention.gradients(adam.p, x[part], y[part], held[part]))


def _train_part(p: Params, groups: list, m: Classes, r: int) -> tuple[Params, int]:
    """Train once on the windows of round r of the groups (keys, ids, n); the weights, and how many windows it were.

    Only the ids are held; windows are built for a few groups at a time.
    """
    rng = np.random.default_rng(100 + r)

    def of_round(key, text, number):
        return (key[text] + number) % ROUNDS == r

    total = 0
    for key, _, n in groups:
        count = window_count(n, CONTEXT)
        total += int(of_round(key, np.repeat(np.arange(len(n)), count), ragged(count)).sum())
    adam = attention.Adam({k: v.copy() for k, v in p.items()}, RATE)
    # Each mix may end in a part of a batch.
    steps, built, trained = -(-total // BATCH) + total // MIXED_WINDOWS + 1, [], 0
    for i, g in enumerate(rng.permutation(len(groups))):
        key, ids, n = groups[g]
        x, y, _, held, _ = windows(ids, n, m, CONTEXT, lambda text, number, key=key: of_round(key, text, number))
        built.append((x, y, held))
        if sum(len(b[0]) for b in built) >= MIXED_WINDOWS or i == len(groups) - 1:
            x, y, held = (np.concatenate(c) for c in zip(*built))
            built = []
            _pass(adam, x, y, held, rng.permutation(len(x)), RATE, steps)
            trained += len(x)
    return adam.p, trained


def _parts(batches):
    """Lists of groups (keys, ids, n) of the rows of one shard each; a list ends early at MOST_IDS."""
    groups, size, last = [], 0, None
    for b in batches:
        shard = b.column("shard").to_numpy()
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
            for lo in range(a, z, GROUP_TEXTS):
                if groups and (shard[lo] != last or size > MOST_IDS):
                    yield groups
                    groups, size = [], 0
                last = shard[lo]
                part = b.slice(lo, min(GROUP_TEXTS, z - lo))
                ids, n = _ids(part.column("ids"))
                groups.append((part.column("key").to_numpy(), ids, n))
                size += len(ids)
    if groups:
        yield groups


def _drawn(m: Classes, share: float):
    """Windows (x, y, held and a hash that orders them) drawn by a hash of the row's key and their number."""
    least = np.uint64(min(int(share * 2.0**64), (1 << 64) - 1))

    def run(batches):
        for b in batches:
            key, n = b.column("key").to_numpy().view(np.uint64), b.column("n_ids").to_numpy()
            count = window_count(n, CONTEXT)
            text = np.repeat(np.arange(len(n)), count)
            with np.errstate(over="ignore"):
                h = mix(mix(key)[text] + ragged(count).astype(np.uint64))
            hit = h <= least
            some = np.unique(text[hit])  # few texts have a window that is drawn
            if not len(some):
                continue
            chosen = hit[np.isin(text, some)]
            x, y, _, held, _ = windows(*_ids(b.column("ids").take(pa.array(some))), m, CONTEXT, lambda text, number, chosen=chosen: chosen)
            columns = [x.astype("<u2"), y.astype("<u2"), held.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), *(pa.array([r.tobytes() for r in c], pa.binary()) for c in columns)], names=["h", "x", "y", "held"])

    return run


def fit(rows: DataFrame, n_ids: int) -> Model:
    """Learn from the training rows of encoded()."""
    train = rows.filter("train").select("key", "shard", "n_ids", "ids")
    counted = train.select("ids").mapInArrow(_count_ids(n_ids), "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(n_ids, np.int64)
    total[counted.column("id").to_numpy()] = counted.column("n").to_numpy()
    ranked = np.argsort(-total, kind="stable")
    before_of = np.full(n_ids, BEFORE, np.int64)
    before_of[ranked[:BEFORE]] = np.arange(BEFORE)
    pairs = train.select("ids").mapInArrow(_count_before(n_ids, before_of), "id int, before int, n bigint").groupBy("id", "before").agg(F.sum("n").alias("n")).toArrow()
    profile = np.zeros((n_ids, BEFORE + 2))
    profile[pairs.column("id").to_numpy(), pairs.column("before").to_numpy()] = pairs.column("n").to_numpy()
    documents = train.count()
    # Class 0 is the end until the tree gives classes their numbers.
    class_of = np.full(n_ids, 1 + OWN_CLASSES, np.int64)
    class_of[ranked[:OWN_CLASSES]] = 1 + np.arange(OWN_CLASSES)
    seen = ranked[OWN_CLASSES:][total[ranked[OWN_CLASSES:]] > 0]
    if len(seen):
        class_of[seen] = 1 + OWN_CLASSES + _groups(profile[seen], total[seen].astype(float), CLASSES - 1 - OWN_CLASSES)
    mass = np.bincount(class_of, total, CLASSES)
    mass[0] = documents
    after = np.zeros((CLASSES, BEFORE + 2))
    np.add.at(after, class_of, profile)
    code = _tree(after, mass)
    share = (total + 1.0) / (mass + np.bincount(class_of, minlength=CLASSES))[class_of]
    log_share = np.log10((profile + PRIOR * share[:, None]) / (after[class_of] + PRIOR)).astype(np.float32)
    input_of = 1 + OWN_INPUTS + class_of
    input_of[ranked[:OWN_INPUTS]] = 1 + np.arange(min(OWN_INPUTS, n_ids))
    m = Classes(code[class_of], input_of, int(code[0]))
    by_code = np.zeros(CLASSES)
    by_code[code] = mass
    p = attention.new_params(1 + OWN_INPUTS + CLASSES, by_code.reshape(attention.BRANCHES, attention.LEAVES))
    if documents:
        p = _started(train, p, m, START_WINDOWS / (documents + total.sum() / CONTEXT))
        for r in range(ROUNDS):
            p = _averaged(train, p, m, r)
    return Model(p, m, before_of, log_share)


def _started(train: DataFrame, p: Params, m: Classes, share: float) -> Params:
    """The first training, in one task: the drawn windows are few at any size, and a worker has one numpy thread."""
    spark = train.sparkSession
    drawn = train.select("key", "n_ids", "ids").mapInArrow(_drawn(m, share), "h bigint, x binary, y binary, held binary").toArrow().sort_by("h")
    if not drawn.num_rows:
        return p
    x, y, held = (np.frombuffer(b"".join(drawn.column(c).to_pylist()), t).reshape(-1, CONTEXT) for c, t in (("x", "<u2"), ("y", "<u2"), ("held", np.uint8)))
    work = spark.sparkContext.broadcast((p, x, y, held.astype(bool)))

    def run(batches):
        attention.keep_memory()
        for b in batches:
            if b.num_rows:
                flat = attention.pack(_train(*work.value, START_RATE, START_PASSES, 1))
                yield pa.RecordBatch.from_arrays([pa.array(flat.astype(np.float32))], names=["value"])

    flat = spark.range(0, 1, 1, 1).mapInArrow(run, "value float").toArrow().column("value").to_numpy()
    return attention.unpack(flat, p)


def _averaged(train: DataFrame, p: Params, m: Classes, r: int) -> Params:
    """One round: each shard trains on its windows of the round; the weights are averaged by Spark."""
    held_params = train.sparkSession.sparkContext.broadcast((p, m))

    def run(batches):
        attention.keep_memory()
        p, m = held_params.value
        total, weight = 0.0, 0
        for groups in _parts(batches):
            trained, size = _train_part(p, groups, m, r)
            if size:
                total = total + attention.pack(trained).astype(np.float64) * size
                weight += size
        if weight:
            for lo in range(0, len(total), 8192):
                part = total[lo : lo + 8192]
                at = pa.array(np.arange(lo, lo + len(part), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([at, pa.array(part), pa.array(np.full(len(part), float(weight)))], names=["at", "sum", "weight"])

    trained = train.mapInArrow(run, "at int, sum double, weight double").groupBy("at").agg((F.sum("sum") / F.sum("weight")).alias("value")).toArrow()
    if not trained.num_rows:
        return p
    flat = attention.pack(p)
    flat[trained.column("at").to_numpy()] = trained.column("value").to_numpy()
    return attention.unpack(flat, p)


def model_scores(rows: DataFrame, model: Model) -> DataFrame:
    """rows without ids and tail, and model_sum: log10 probability of each text with its end."""
    spark = rows.sparkSession
    held_model = spark.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c not in ("key", "shard", "n_ids", "ids", "tail")]

    def run(batches):
        attention.keep_memory()
        m = held_model.value
        for b in batches:
            out = []
            for lo in range(0, b.num_rows, 64):
                out.append(score(m, *_ids(b.slice(lo, 64).column("ids"))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*kept, "model_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.select(*kept, "ids").mapInArrow(run, f"{schema}, model_sum double")


def score(m: Model, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    k = m.log_share.shape[1]
    shares = np.concatenate([[0.0], np.cumsum(m.log_share.reshape(-1).take(ids.astype(np.int64) * k + _before(ids, n, m.before_of)), dtype=np.float64)])
    ends = np.cumsum(n)
    out = shares[ends] - shares[ends - n]
    x, y, text, _, scored = windows(ids, n, m.classes, STEP)
    for lo in range(0, len(x), SCORED_AT_ONCE):
        part = slice(lo, lo + SCORED_AT_ONCE)
        rows = np.flatnonzero(scored[part])
        h, _ = attention.hidden(m.params, x[part])
        lp = attention.log_probs(m.params, h.take(rows, axis=0), y[part].reshape(-1).take(rows))
        out += np.bincount(text[part].take(rows // CONTEXT), lp, len(n)) / np.log(10)
    return out


def language_scores(docs: DataFrame, held_out: Column, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    prepare(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()
    texts = docs.select("doc_id", (~held_out).alias("train"), "text")
    counts = count_words(texts.filter("train"))
    rows = encoded(texts, counts, vocabulary)
    n_ids = len(encoder(vocabulary, "<u2").ends_word)
    model = fit(rows, n_ids)
    scored = model_scores(rows, model).join(base_scores(rows, counts), "row", "left")
    n_tokens = F.col("n_words") + 1
    end_known = 1 if counts.documents else 0
    end = float(np.log10(counts.documents + 1.0))
    base = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + F.lit(end) - n_tokens * F.lit(counts.unit)
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + end_known).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        F.col("model_sum").alias("score"),
    )
