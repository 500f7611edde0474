"""Language identification of mixed-language texts.

Training counts, for each language label, the hashed byte 4-grams of words (with their borders) and
the scripts of their letters, over all training rows: each task sums its own, Spark adds them, and
the driver holds one table of fixed size for each language.

Prediction scores each word under each language by naive Bayes.  The scripts of a word's letters,
found by code-point ranges, narrow the candidates to languages that use them all; if none does, to
those that use one of them; if none does, to all.  Others can't have the word.  Viterbi then labels
the words of a text: changing the language between words costs a penalty, so that stray words don't
break a span, and stretches in another language become spans of their own.  The text's language is
the one whose spans hold most letters, and its score their share of all letters.

Most texts are in one language.  If no stretch of words favours another language by more than half
the penalty, no path with a change can be best, and the text needs no dynamic programme; this is
a proof and not an approximation.

A letter is a code point of a Unicode letter category; digits, marks and punctuation of a script are none.
All labels are learned: the driver and the workers hold a table of 0.5 MB for each label.

Edge cases: a null text, and one without a letter, gets ``und`` and score 0; with no training row
all texts do; letters outside the ranges are a script of their own; ties go to the
first label in code-point order; repeated rows get equal results; only text is read to predict.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, per_text, pieces, prepare, utf8, words

#: Slots of the n-gram table; cost of a change of language; how far a language that doesn't use the script stays behind all that do.
SLOT_BITS, SWITCH, OFF_SCRIPT = 16, 12.0, 1000.0
#: Share of a language's letters from which it counts as using a script.
SCRIPT_SHARE = 0.01
#: Weight of an n-gram's log-likelihood: overlapping n-grams aren't independent.
DAMPING = 0.5

# First and last code point of blocks with letters of a script.
SCRIPTS = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x531, 0x58F),),
    "Hebrew": ((0x591, 0x5F4), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)),
    "Devanagari": ((0x900, 0x97F),),
    "Bengali": ((0x980, 0x9FF),),
    "Tamil": ((0xB80, 0xBFF),),
    "Telugu": ((0xC00, 0xC7F),),
    "Thai": ((0xE00, 0xE7F),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7A3)),
    "Kana": ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
#: The number of letters outside the ranges, and how many numbers there are.
OTHER = len(SCRIPTS) + 1
KINDS = OTHER + 1
_table: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """For each code point the number of its script (from 1) if it is a letter, else 0."""
    if not _table:
        of = np.full(0x110000, OTHER, np.int8)
        for i, blocks in enumerate(SCRIPTS.values()):
            for a, b in blocks:
                of[a : b + 1] = i + 1
        of[[c for c in range(0x110000) if not chr(c).isalpha()]] = 0
        _table.append(of)
    return _table[0]


def letter_scripts(raw: np.ndarray) -> np.ndarray:
    """For each byte that begins a letter the number of its script (from 1), else 0."""
    table = script_table()
    out = table[:128][np.minimum(raw, 127)]  # 127 is no letter
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        b = [raw[np.minimum(lead + i, len(raw) - 1)].astype(np.int32) for i in range(4)]
        two, three, four = b[0] < 0xE0, (b[0] >= 0xE0) & (b[0] < 0xF0), b[0] >= 0xF0
        point = np.where(two, (b[0] & 31) << 6 | b[1] & 63, 0)
        point = np.where(three, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, point)
        point = np.where(four, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63, point)
        out[lead] = table.take(point)
    return out


@dataclass
class _Words:
    slots: np.ndarray  # of each word's n-grams, end to end
    sizes: np.ndarray  # n-grams of each word; 0 if it has no letter
    scripts: np.ndarray  # of each word, a bit for each number
    letters: np.ndarray  # letters of each word
    first: np.ndarray  # each text's first word
    starts: np.ndarray
    ends: np.ndarray


def _words_of(raw: np.ndarray, at: np.ndarray) -> _Words:
    starts, ends, first = words(raw, at)
    script = letter_scripts(raw)
    length = ends - starts
    total = np.concatenate([[0], np.cumsum(script > 0)])
    letters = total[ends] - total[starts]
    bits = (np.int32(1) << script.astype(np.int32)) * (script > 0)
    of_word = np.bitwise_or.reduceat(bits, starts) if len(starts) else np.zeros(0, np.int32)  # runs over the gap, where it's 0
    # Byte i of " word " and the three before it; one more n-gram than bytes.
    padded = np.concatenate([[32, 32, 32], _LOWER[raw], [32]]).astype(np.uint32)
    gram = padded[3:] | padded[2:-1] << 8 | padded[1:-2] << 16
    gram[:] |= np.concatenate([padded[:-3]]) << 24
    # In the first bytes of a word what stands before must read as spaces.
    sizes = np.where(letters > 0, length + 1, 0)
    full = np.flatnonzero(sizes)
    n = sizes[full]
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    where = np.repeat(starts[full], n) + offset
    g = gram[where]
    for k, mask, fill in ((0, 0xFF, 0x20202000), (1, 0xFFFF, 0x20200000), (2, 0xFFFFFF, 0x20000000)):
        edge = offset == k
        g[edge] = g[edge] & np.uint32(mask) | np.uint32(fill)
    last = offset == np.repeat(n, n) - 1
    g[last] = g[last] & np.uint32(0xFFFFFF00) | np.uint32(0x20)
    g = (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    return _Words(g.astype(np.int64), sizes, of_word, letters, first, starts, ends)


@dataclass(frozen=True)
class LanguageModel:
    """languages in code-point order; weights by n-gram slot and language; which uses which script."""

    languages: tuple[str, ...]
    weights: np.ndarray
    uses: np.ndarray


def fit(labelled: DataFrame) -> LanguageModel:
    """Learn from all rows of labelled (text, lang) whose text and lang are not null."""
    prepare(labelled.sparkSession)
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    place = {v: i for i, v in enumerate(languages)}
    slots = 1 << SLOT_BITS

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for piece in pieces(batches):
            raw, at = utf8(piece.column("text"))
            w = _words_of(raw, at)
            own, lang = np.unique([place[v] for v in piece.column("lang").to_pylist()], return_inverse=True)
            of_gram = np.repeat(np.repeat(lang, np.diff(w.first)), w.sizes)
            grams = np.bincount(of_gram * slots + w.slots, minlength=len(own) * slots).reshape(-1, slots)
            scripts = letter_scripts(raw)
            letters = np.bincount(np.repeat(lang, np.diff(at)) * KINDS + scripts, minlength=len(own) * KINDS).reshape(-1, KINDS)
            letters[:, 0] = 0
            for i, total in zip(own.tolist(), np.concatenate([grams, letters], axis=1)):
                sums[i] = sums[i] + total if i in sums else total
        for i, total in sums.items():
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), i, np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["lang", "slot", "n"])

    counts = known.mapInArrow(count, "lang int, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((slots + KINDS, len(languages)), np.float32)
    table[counts.column("slot").to_numpy(), counts.column("lang").to_numpy()] = counts.column("n").to_numpy()
    grams = table[:slots] + np.float32(0.5)
    weights = np.float32(DAMPING) * np.log(grams / grams.sum(axis=0, dtype=np.float64).astype(np.float32))
    letters = table[slots:]
    uses = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    return LanguageModel(tuple(languages), weights, uses)


def candidates(scripts: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """For words with these scripts (a bit for each number), which languages may have them."""
    kinds, of = np.unique(scripts, return_inverse=True)
    out = np.empty((len(kinds), uses.shape[1]), bool)
    for i, bits in enumerate(kinds.tolist()):
        own = uses[[k for k in range(KINDS) if bits >> k & 1]]
        each = own.all(axis=0)
        out[i] = each if each.any() else own.any(axis=0) if own.any() else True
    return out[of]


def word_scores(w: _Words, model: LanguageModel) -> np.ndarray:
    """Score of each word under each language, 0 for words without a letter and for the best language of others."""
    out = np.zeros((len(w.sizes), len(model.languages)))
    full = np.flatnonzero(w.sizes)
    if len(full):
        n = w.sizes[full]
        s = np.add.reduceat(model.weights[w.slots], np.cumsum(n) - n, axis=0).astype(np.float64)
        may = candidates(w.scripts[full], model.uses)
        if not may.all():
            s = np.where(may, s, np.where(may, s, np.inf).min(axis=1, keepdims=True) - OFF_SCRIPT)
        out[full] = s - s.max(axis=1, keepdims=True)
    return out


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best labels of each text's words; all texts advance together, the longest last."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    longest = len(scores[order[0]]) if order else 0
    if not longest:
        return [np.zeros(0, np.int64) for _ in scores]
    k = scores[order[0]].shape[1]
    lengths = np.array([len(scores[i]) for i in order])
    packed = np.concatenate([scores[i] for i in order])
    begin = np.cumsum(lengths) - lengths
    back = np.zeros((len(packed), k), np.int16)
    value = np.zeros((len(order), k))
    own = np.arange(k)
    for t in range(longest):
        live = int(np.searchsorted(-lengths, -t, "left"))
        v = value[:live]
        if t:
            best = v.argmax(axis=1)
            change = v[np.arange(live), best] - switch
            stay = v >= change[:, None]
            back[begin[:live] + t] = np.where(stay, own, best[:, None])
            v = np.where(stay, v, change[:, None])
        value[:live] = v + packed[begin[:live] + t]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for r, i in enumerate(order):
        labels = np.zeros(lengths[r], np.int64)
        state = int(value[r].argmax()) if lengths[r] else 0
        rows = back[begin[r] : begin[r] + lengths[r]].tolist()
        for t in range(lengths[r] - 1, -1, -1):
            labels[t] = state
            state = rows[t][state]
        out[i] = labels
    return out


def label_words(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language (its number) of each word of each text."""
    counts = np.diff(first)
    total = per_text(scores, counts)
    main = total.argmax(axis=1) if len(counts) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    labels = main[text]
    if not len(scores):
        return labels
    # The greatest gain of any stretch of words if it went to another language.
    gain = scores - scores[np.arange(len(text)), labels][:, None]
    total = np.cumsum(gain, axis=0)
    at_start = np.concatenate([np.zeros((1, gain.shape[1])), total])[first[:-1]][text]
    inside = total - at_start
    step = 1.0 + 2 * np.abs(inside).max()
    level = -step * text[:, None]
    lowest = np.minimum.accumulate(inside - gain + level, axis=0)
    most = (inside + level - lowest).max(axis=1)
    doubtful = np.flatnonzero(per_text(most, counts, np.maximum) > switch / 2)
    for i, best in zip(doubtful, viterbi([scores[first[i] : first[i + 1]] for i in doubtful], switch)):
        labels[first[i] : first[i + 1]] = best
    return labels


RESULT = "lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>"


def predict(text: Column, model: LanguageModel, spans: bool = True) -> Column:
    """struct<lang_pred, score, spans> of a text column; spans have code-point offsets, and cover words."""

    def predicted(texts: pa.Array) -> pa.Array:
        langs, shares, found = [], [], []
        # A word takes a number for each language.
        limit = max(1 << 16, (1 << 25) // max(8, len(model.languages)))
        for piece in pieces([pa.RecordBatch.from_arrays([texts], ["text"])], limit):
            column = piece.column("text")
            raw, at = utf8(column)
            w = _words_of(raw, at)
            n = np.diff(w.first)
            labels = label_words(word_scores(w, model), w.first) if model.languages else np.zeros(len(w.sizes), np.int64)
            held = np.zeros((len(w.sizes), max(1, len(model.languages))))
            held[np.arange(len(labels)), labels] = w.letters
            held = per_text(held, n)
            all_letters = held.sum(axis=1)
            best = held.argmax(axis=1)
            point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]) if spans else None
            for i in range(len(n)):
                if all_letters[i] == 0 or not model.languages:
                    langs.append("und")
                    shares.append(0.0)
                    found.append([])
                    continue
                langs.append(model.languages[best[i]])
                shares.append(float(held[i, best[i]] / all_letters[i]))
                found.append(_spans(labels, w, int(w.first[i]), int(w.first[i + 1]), point, int(at[i]), model) if spans else [])
        kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(found, kind)], ["lang_pred", "score", "spans"])

    return F.arrow_udf(predicted, RESULT)(text)


def _spans(labels, w: _Words, lo: int, hi: int, point, base: int, model: LanguageModel) -> list[dict]:
    own = labels[lo:hi]
    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
    return [
        {"lang": model.languages[own[i]], "start": int(point[w.starts[lo + i]] - point[base]), "end": int(point[w.ends[lo + j - 1]] - point[base])}
        for i, j in zip(cuts[:-1], cuts[1:])
    ]


def identify(docs: DataFrame, model: LanguageModel, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and spans of each row of docs."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", predict(F.col("text"), model, spans).alias("p")).select("doc_id", "p.*")
