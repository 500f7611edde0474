"""Personal data: typed patterns find seeds, and contextual bootstrapping finds what they miss.

1. One pass over the texts finds e-mail addresses, IP addresses, card and phone numbers (the base
   spans) and other tokens that look like identifiers, each with the lexical patterns it stands in:
   the two words before it, the words on both sides, the two words after it, and a prefix inside the
   token (``id=``).  Digits of pattern words read as 0; where the text begins or ends stands a mark.
2. Patterns and instances form a graph, which Spark scores in rounds.  Seeds score 1 and are accepted.
   A pattern's confidence is the summed score of its distinct instances over their number plus one; it
   is trusted if enough of its instances are accepted and its confidence is high.  An instance's score
   is one minus the product of (1 - confidence) over its trusted patterns, and it is accepted, with the
   kind of the best of them, when it has one.  Accepted instances support further patterns in the next
   round, so patterns without any seed come to be trusted.  It ends when number and summed score of
   the accepted stay (to a thousandth), or after ROUNDS.
3. The unseen identifiers in trusted patterns are the further spans.

A pattern needs a letter in its words, so that marks and punctuation alone teach nothing, and a kind
takes only instances with as many digits as it may have (DIGITS).
Only patterns with enough distinct instances can ever be trusted; the graph leaves out the others.
Offsets count code points; ends are exclusive.  Texts are never cut.  Pattern words of over LONG_WORD
characters stand as their hash.  Edge cases: a null text is empty, without spans; repeated rows are
judged each, and count once in the graph; of kinds with equal confidence the last in code-point order
is taken; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, prepare, utf8, written

KINDS = ("email", "ip", "card", "phone")
#: Accepted instances a pattern needs, and confidence it needs to add spans.
SUPPORT, CONFIDENCE = 3, 0.6
#: Rounds of the graph at most: each takes in patterns that are one step further from the seeds.
ROUNDS = 12
#: Digits of identifiers that a pattern may give a kind.
DIGITS = {"email": (0, 1 << 30), "ip": (4, 12), "card": (12, 19), "phone": (6, 15)}
#: Characters of the longest pattern word that stands as it is.
LONG_WORD = 40
#: An identifier-like token has so many letters and digits, so many of them digits.
LEAST_CHARS, LEAST_DIGITS = 6, 4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Stand for words beyond the text.
BEGIN, END = "<begin>", "<end>"
_EDGE = ".,;:!?\"'()[]{}<>"

_SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,contexts:array<string>>"


def emails(text: str):
    last = 0
    at = text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        if found:
            i = at
            while i > last and text[i - 1] in _LOCAL:
                i -= 1
            if i < at:
                last = found.end()
                yield i, last
        at = text.find("@", at + 1)


def ips(text: str):
    """Runs of dotted numbers, four at a time from the left."""
    for run in _DOTTED.finditer(text):
        parts = list(_DIGITS.finditer(text, run.start(), run.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(p := m.group().lstrip("0")) <= 3 and int(p or 0) <= 255 for m in four):
                yield four[0].start(), four[3].end()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str):
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the typed patterns, by kind as in KINDS, then start."""
    return [(kind, a, b) for kind, find in zip(KINDS, (emails, ips, cards, phones)) for a, b in find(text)]


def _held(word: str) -> str:
    import xxhash

    return word if len(word) <= LONG_WORD else f"#{xxhash.xxh128_hexdigest(word.encode())}"


def _shape(word: str) -> str:
    return _held(re.sub(r"[0-9]+", "0", word.lower()).strip(_EDGE))


class _Words:
    """Where the words of a text begin and end."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def shape(self, i: int) -> str:
        if 0 <= i < len(self.starts):
            return _shape(self.text[self.starts[i] : self.ends[i]])
        return BEGIN if i < 0 else END

    def contexts(self, start: int, end: int) -> list[str]:
        """The patterns that a span stands in."""
        i, j = bisect_right(self.starts, start) - 1, bisect_left(self.ends, end)
        prefix = self.text[self.starts[i] : start].lower()
        if prefix.strip(_EDGE):  # of the same token; quotes and brackets alone are none
            return [f"in|{_held(prefix)}"]
        b, a = self.shape(i - 1), self.shape(j + 1)
        out = [("before", self.shape(i - 2), b), ("around", b, a), ("after", a, self.shape(j + 2))]
        return [f"{side}|{x} {y}" for side, x, y in out if any(w not in (BEGIN, END) and any(map(str.isalpha, w)) for w in (x, y))]


def _instances(text: str, base: list[tuple[str, int, int]]) -> list[tuple]:
    """Seeds and other identifier-like tokens: (kind or None, start, end, value, contexts)."""
    words = _Words(text)
    out = [(k, a, b, text[a:b].lower(), words.contexts(a, b)) for k, a, b in base]
    covered = sorted((a, b) for _, a, b in base)
    i = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        cut = max(text.rfind("=", a, b), text.rfind(":", a, b)) + 1
        a = cut if cut and cut < b else a
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        if i < len(covered) and covered[i][0] < b:
            continue
        value = text[a:b]
        if sum(c.isalnum() for c in value) >= LEAST_CHARS and sum("0" <= c <= "9" for c in value) >= LEAST_DIGITS:
            out.append((None, a, b, value.lower(), words.contexts(a, b)))
    return out


def _line(spans) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


_MARK = np.zeros(256, bool)
_MARK[list(b"@0123456789")] = True


SCANNED = f"counts array<bigint>, base string, instances array<{_SPAN}>"


def scan(texts: pa.Array) -> pa.Array:
    """Base counts by kind, the base spans as a line, and all instances with contexts."""
    counts, lines, found = [], [], []
    for piece in pieces([pa.RecordBatch.from_arrays([texts], ["text"])]):
        column = piece.column("text")
        raw, at = utf8(column)
        marks = np.concatenate([[0], np.cumsum(_MARK[raw])])
        has = marks[at[1:]] > marks[at[:-1]]
        for i, marked in enumerate(has):
            text = column[i].as_py() if marked else ""
            base = base_spans(text) if marked else []
            counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
            lines.append(",".join(f"{k}:{a}:{b}" for k, a, b in base))
            found.append([dict(zip(("kind", "start", "end", "value", "contexts"), x)) for x in _instances(text, base)] if marked else [])
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("contexts", pa.list_(pa.string()))])
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.list_(pa.int64())), pa.array(lines, pa.string()), pa.array(found, pa.list_(span))], ["counts", "base", "instances"]
    )


def merged(base: pa.Array, extra: pa.Array) -> pa.Array:
    """Base spans and further ones in one line."""
    out = []
    for b, e in zip(base.to_pylist(), extra.to_pylist()):
        if e:
            spans = [tuple(x.split(":")) for x in b.split(",") if x]
            spans = [(k, int(i), int(j)) for k, i, j in spans] + [(x["kind"], x["start"], x["end"]) for x in e]
            b = _line(set(spans))
        out.append(b)
    return pa.array(out, pa.string())


def plausible(value: Column, kind: Column) -> Column:
    """May an identifier be of this kind, by its digits?"""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    out = F.lit(False)
    for k, (low, high) in DIGITS.items():
        out = out | ((kind == k) & digits.between(low, high))
    return out


def trusted_contexts(seen: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """context, kind, confidence of patterns that may add spans; seen: kind, value, context of every instance.

    A pattern may stand in most texts: it is a key only of sums, made in each task first, and of joins
    of distinct (pattern, value) pairs against one row for each trusted pattern.
    """
    # A value that is a seed anywhere is a seed; edges are distinct.
    edges = written(seen.groupBy("context", "value").agg(F.max("kind").alias("kind")), "contexts")
    seeds = edges.filter(F.col("kind").isNotNull()).groupBy("value").agg(F.max("kind").alias("seed"))
    eligible = edges.groupBy("context").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    graph = edges.select("context", "value").join(eligible, "context").join(seeds, "value", "left")
    graph = written(graph.select("context", "value", "n", "seed"), "contexts")
    given = graph.filter(F.col("seed").isNotNull()).select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    given = accepted = written(given.distinct(), "contexts")
    held = None
    while True:
        each = graph.join(accepted, "value").groupBy("context", "n", "kind").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
        sums = each.groupBy("context", "n").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"), F.max(F.struct("score", "kind")).alias("best"))
        strength = F.col("score") / (F.col("n") + 1)
        trusted = sums.filter((F.col("votes") >= support) & (strength >= confidence)).select("context", F.col("best.kind").alias("kind"), strength.alias("confidence"))
        trusted = written(trusted, "contexts")
        rounds -= 1
        if not rounds:
            return trusted
        found = graph.filter(F.col("seed").isNull()).join(trusted, "context").filter(plausible(F.col("value"), F.col("kind"))).groupBy("value")
        score = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        found = found.agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), score.alias("score"))
        accepted = written(given.unionByName(found), "contexts")
        now = tuple(accepted.agg(F.count("*"), F.round(F.sum("score"), 3)).first())
        if now == held:
            return trusted
        held = now


def personal_data(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, counts by kind (base), base and spans (lines of kind:start:end) for each row of docs."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.arrow_udf(scan, SCANNED)(F.col("text")).alias("s")).select("doc_id", "row", "s.*")
    rows = written(rows, "personal")
    each = rows.select("row", F.explode("instances").alias("i")).select("row", "i.*")
    each = each.select("row", "kind", "start", "end", "value", F.explode("contexts").alias("context"))
    trusted = trusted_contexts(each.select("kind", "value", "context"), rounds, support, confidence)
    unseen = each.filter(F.col("kind").isNull()).drop("kind").join(trusted, "context").filter(plausible(F.col("value"), F.col("kind")))
    best = unseen.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    extra = best.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    joined = rows.drop("instances").join(extra, "row", "left")
    return joined.select("doc_id", *[F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)], "base", F.arrow_udf(merged, "string")("base", "extra").alias("spans"))
