"""Fill-in-middle: texts cut in three and put together in another order, by a parallel automaton scan.

An automaton over UTF-8 bytes says where units (code points or words) begin and whether a marker has been seen.  A
text is cut into chunks of bytes, and each chunk is scanned from every state at once: it emits its transition
function (the state it ends in, for each state it may be entered in) and the units it counts from each.  Functions
compose associatively, so the entry states and counts of all chunks follow from their prefixes, and the cut before
unit k is looked for only in the chunk that holds it.

Chunks of ``CHUNK`` bytes are scanned in lock step, all chunks of an Arrow batch at a time.  A text of up to ``BLOCK``
bytes is composed and cut in the task that reads it.  A giant one is dealt as blocks over tasks: each emits its
function, the functions of a text (at most 2^31 / BLOCK = 32,768 of a few numbers) are composed, and the blocks that
hold the cuts are scanned again.  Both ways use the same functions below and give the same rows.

Edge cases: a null text counts as empty and stays plain, as does a text with a marker in it; a null doc_id is hashed
as the empty string; rows that repeat get equal results; a cut never splits a code point, and both cuts may be equal or
at an end of the text; an empty table gives an empty result.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SEPARATOR, pieces, prepare, ragged, small, utf8, written

#: The markers, in the order prefix, suffix, middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Percent of texts that are transformed, and percent of those whose suffix comes first.
RATE, SPM = 90, 20
#: Bytes of a chunk that is scanned in lock step, and of a block that a task gets whole.
CHUNK, BLOCK = 512, 1 << 16
#: The symbol that fills a chunk up; it changes no state and begins no unit.
FILL = 256


@dataclass(frozen=True)
class Automaton:
    """next[state, symbol] and begins[state, symbol] (does a unit begin with this byte); state 0 is the first."""

    next: np.ndarray
    begins: np.ndarray
    #: States in which a marker has been seen.
    marked: np.ndarray

    @property
    def states(self) -> int:
        return len(self.next)


def _seen(markers: Sequence[str]) -> tuple[np.ndarray, int]:
    """Transitions over the prefixes of the markers, and the state, absorbing, in which one has been seen."""
    plain = [m.encode() for m in markers]
    prefixes = sorted({m[:i] for m in plain for i in range(len(m))}, key=lambda p: (len(p), p))
    at = {p: i for i, p in enumerate(prefixes)}
    found = len(prefixes)
    table = np.full((found + 1, 256), found, np.uint8)
    for p in prefixes:
        for b in range(256):
            held = p + bytes([b])
            if not any(held.endswith(m) for m in plain):
                table[at[p], b] = at[next(held[i:] for i in range(len(held) + 1) if held[i:] in at)]
    return table, found


def automaton(unit: str = "chars", markers: Sequence[str] = MARKERS) -> Automaton:
    """Units are ``chars`` (code points) or ``words`` (runs of other than white space; a unit ends where the next begins)."""
    table, found = _seen(markers)
    if unit == "chars":
        own = np.zeros((1, 256), np.uint8)
        begins = (np.arange(256) & 0xC0) != 0x80
        begins = begins[None, :]
    elif unit == "words":
        own = np.tile((~_SEPARATOR).astype(np.uint8), (2, 1))  # state 1: inside a word
        begins = np.stack([~_SEPARATOR, np.zeros(256, bool)])
    else:
        raise ValueError(f"no such unit: {unit}")
    n = len(table)
    both = (own[:, None, :].astype(np.int64) * n + table[None, :, :]).reshape(-1, 256)
    return _smallest(both, np.repeat(begins, n, axis=0), np.tile(np.arange(n) == found, len(own)))


def _smallest(table: np.ndarray, begins: np.ndarray, marked: np.ndarray) -> Automaton:
    """States that no continuation tells apart become one (refinement of a partition until it is stable)."""
    kind = np.unique(np.hstack([begins, marked[:, None]]), axis=0, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.hstack([kind[:, None], kind[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == kind.max():
            break
        kind = finer
    first = np.unique(kind, return_index=True)[1]
    order = np.argsort(np.where(np.arange(len(first)) == kind[0], -1, first), kind="stable")  # the first state stays 0
    name = np.empty(len(first), np.int64)
    name[order] = np.arange(len(first))
    rows = first[order]
    fill = np.arange(len(rows))[:, None]
    return Automaton(np.hstack([name[kind[table[rows]]], fill]).astype(np.uint8), np.hstack([begins[rows], np.zeros_like(fill, bool)]), marked[rows])


def _by_step(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbols of all chunks, a row for each step, filled up at the end."""
    n, lengths = len(starts), ends - starts
    symbols = np.full((n, int(lengths.max(initial=0))), FILL, np.uint16)
    within = ragged(lengths)
    symbols[np.repeat(np.arange(n), lengths), within] = raw[np.repeat(starts, lengths) + within]
    return np.ascontiguousarray(symbols.T)


def scan(a: Automaton, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transition function and, for each start state, the count of units of each chunk raw[start:end]."""
    width = a.next.shape[1]
    both = (a.next.astype(np.int32) * width * 2 + a.begins).ravel()  # where the next state's row is, and whether a unit begins
    state = np.tile(np.arange(a.states, dtype=np.int32)[:, None] * width, (1, len(starts)))
    count = np.zeros(state.shape, np.int32)
    for row in _by_step(raw, starts, ends):
        found = both.take(state + row)
        count += found & 1
        state = found >> 1
    return (state // width).T.astype(np.uint8), count.T.astype(np.int64)


def locate(a: Automaton, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """In each chunk, entered in its state, the place where the unit of that number (from 0) begins; its end if there is none."""
    width = a.next.shape[1]
    state, left = entry.astype(np.int64) * width, unit.astype(np.int64).copy()
    found, out = a.begins.ravel(), (ends - starts).astype(np.int64)
    to = a.next.astype(np.int64).ravel() * width
    for step, row in enumerate(_by_step(raw, starts, ends)):
        at = state + row
        begins = found.take(at)
        out[begins & (left == 0)] = step
        left -= begins
        state = to.take(at)
    return out


def compose(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First f, then g; for arrays of functions, pairwise."""
    return np.take_along_axis(g[0], f[0].astype(np.int64), 1), f[1] + np.take_along_axis(g[1], f[0].astype(np.int64), 1)


def prefixes(states: np.ndarray, counts: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composition of all chunks of a text up to and with each, by doubling; per: chunks of each text."""
    place, step = ragged(per), 1
    f = (states.copy(), counts.copy())
    while step < int(per.max(initial=0)):
        later = np.flatnonzero(place >= step)
        earlier = later - step
        g = compose((f[0][earlier], f[1][earlier]), (f[0][later], f[1][later]))
        f[0][later], f[1][later] = g
        step *= 2
    return f


def chunks(at: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the chunks of all texts (which begin at ``at``), and how many each has (an empty one has one)."""
    lengths = np.diff(at)
    per = np.maximum(1, -(-lengths // size))
    starts = np.repeat(at[:-1], per) + ragged(per) * size
    return starts, np.minimum(starts + size, np.repeat(at[1:], per)), per


def find(a: Automaton, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, per: np.ndarray, f: tuple[np.ndarray, np.ndarray], unit: np.ndarray, entry: np.ndarray | None = None) -> np.ndarray:
    """For each text (row) the bytes of raw at which its units of these numbers (columns) begin; f: prefixes of its chunks.

    entry: the state in which each text is entered.  A number past the last unit gives the end of the text.
    """
    entry = np.zeros(len(per), np.int64) if entry is None else entry
    rows = np.arange(len(starts))
    to = f[1][rows, np.repeat(entry, per)]
    end = np.cumsum(per)
    # Counts of one text after the other, each text above the former ones: one search for all.
    above = np.cumsum(to[end - 1] + 1) - (to[end - 1] + 1)
    k = np.searchsorted(to + np.repeat(above, per), unit + above[:, None], "right")
    k = np.minimum(k, end[:, None] - 1)
    first = k == (end - per)[:, None]
    before = np.where(first, 0, to[k - 1])
    state = np.where(first, entry[:, None], f[0][k - 1, entry[:, None]])
    flat = k.ravel()
    return (starts[flat] + locate(a, raw, starts[flat], ends[flat], state.ravel(), (unit - before).ravel())).reshape(k.shape)


def hashes() -> list[Column]:
    """h1 to h4: 32 bits each of SHA-256 of ``1:`` and the doc_id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


_FOUND = [("n", pa.int64()), ("marked", pa.bool_()), ("first", pa.int64()), ("second", pa.int64()), ("cut_a", pa.int64()), ("cut_b", pa.int64())]


def _cuts(unit: str, markers: Sequence[str]):
    """Arrow function: text, h1, h2 -> units, whether a marker is in it, and both cuts in units and in bytes."""
    a = automaton(unit, markers)

    @F.arrow_udf("n bigint, marked boolean, first bigint, second bigint, cut_a bigint, cut_b bigint")
    def found(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        draws = np.stack([h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)], 1)
        out, done = [], 0
        for piece in pieces([pa.RecordBatch.from_arrays([text], ["text"])]):
            raw, at = utf8(piece.column("text"))
            starts, ends, per = chunks(at)
            f = prefixes(*scan(a, raw, starts, ends), per)
            last = np.cumsum(per) - 1
            n = f[1][last, 0]
            units = np.sort(draws[done : done + len(n)] % (n[:, None] + 1), axis=1)
            cuts = find(a, raw, starts, ends, per, f, units) - at[:-1, None]
            out.append(_struct([n, a.marked[f[0][last, 0]], *units.T, *cuts.T], _FOUND))
            done += len(n)
        return pa.concat_arrays(out) if out else _struct([()] * len(_FOUND), _FOUND)

    return found


def _struct(columns: Sequence[Sequence], fields: Sequence[tuple[str, pa.DataType]]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], fields=[pa.field(n, t) for n, t in fields])


def _giant(docs: DataFrame, unit: str, markers: Sequence[str], block: int) -> DataFrame:
    """docs (doc_id, text, h1, h2, ...) with the struct ``cut`` of _cuts(), for texts whose blocks are dealt over tasks."""
    a = automaton(unit, markers)
    held = written(docs.withColumn("row", F.monotonically_increasing_id()), "giant-texts")
    plain = F.col("text").cast("binary")
    places = F.sequence(F.lit(0), F.call_function("div", F.octet_length(plain) - 1, F.lit(block)).cast("int"))
    blocks = held.select("row", F.explode(places).alias("place"), plain.alias("whole"))
    blocks = written(blocks.select("row", "place", F.substring("whole", F.col("place") * block + 1, F.lit(block)).alias("part")).repartition("row", "place"), "blocks")
    lists = [("to", pa.list_(pa.int32())), ("units", pa.list_(pa.int64()))]
    spots = pa.list_(pa.struct([("place", pa.int32()), ("state", pa.int32()), ("unit", pa.int64())]))
    resolved = [("n", pa.int64()), ("marked", pa.bool_()), ("first", pa.int64()), ("second", pa.int64()), ("spots", spots)]

    @F.arrow_udf("to array<int>, units array<bigint>")
    def function(part: pa.Array) -> pa.Array:
        out = []
        for p in part:
            raw = np.frombuffer(p.as_py(), np.uint8)
            starts, ends, per = chunks(np.array([0, len(raw)]))
            f = prefixes(*scan(a, raw, starts, ends), per)
            out.append((f[0][-1].astype(np.int32), f[1][-1]))
        return _struct(list(zip(*out)) or [(), ()], lists)

    @F.arrow_udf("n bigint, marked boolean, first bigint, second bigint, spots array<struct<place:int,state:int,unit:bigint>>")
    def resolve(f: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        """Units of the text, and for each cut its block, that block's entry state and the unit's number in it."""
        out = []
        for functions, *draws in zip(f.to_pylist(), h1.to_pylist(), h2.to_pylist()):
            own = prefixes(np.array([x["to"] for x in functions], np.uint8), np.array([x["units"] for x in functions]), np.array([len(functions)]))
            n = int(own[1][-1, 0])
            first, second = sorted(h % (n + 1) for h in draws)
            found = []
            for k in (first, second):
                place = min(int(np.searchsorted(own[1][:, 0], k, "right")), len(functions) - 1)
                state, before = (0, 0) if place == 0 else (int(own[0][place - 1, 0]), int(own[1][place - 1, 0]))
                found.append({"place": place, "state": state, "unit": k - before})
            out.append((n, bool(a.marked[own[0][-1, 0]]), first, second, found))
        return _struct(list(zip(*out)) or [()] * 5, resolved)

    @F.arrow_udf("bigint")
    def located(part: pa.Array, state: pa.Array, k: pa.Array) -> pa.Array:
        out = []
        for p, entry, unit in zip(part, state.to_pylist(), k.to_pylist()):
            raw = np.frombuffer(p.as_py(), np.uint8)
            starts, ends, per = chunks(np.array([0, len(raw)]))
            f = prefixes(*scan(a, raw, starts, ends), per)
            out.append(int(find(a, raw, starts, ends, per, f, np.array([[unit]]), np.array([entry]))[0, 0]))
        return pa.array(out, pa.int64())

    functions = blocks.select("row", "place", function("part").alias("f")).select("row", F.struct("place", "f.to", "f.units").alias("f"))
    whole = functions.groupBy("row").agg(F.array_sort(F.collect_list("f")).alias("f"))  # 2^31 / block of a text at most
    solved = whole.join(held.select("row", "h1", "h2"), "row").select("row", resolve("f", "h1", "h2").alias("s"))
    solved = written(solved.select("row", "s.*"), "cuts")
    wanted = solved.select("row", F.posexplode("spots").alias("which", "spot")).select("row", "which", "spot.*")
    # Only two blocks of a text are met again; their bytes stay where they are while the list of them is short.
    at = blocks.join(small(wanted), ["row", "place"]).select("row", "which", (F.col("place").cast("long") * block + located("part", "state", "unit")).alias("at"))
    cuts = at.groupBy("row").agg(F.max(F.when(F.col("which") == 0, F.col("at"))).alias("cut_a"), F.max(F.when(F.col("which") == 1, F.col("at"))).alias("cut_b"))
    cut = F.struct("n", "marked", "first", "second", "cut_a", "cut_b").alias("cut")
    return held.join(solved.join(cuts, "row").select("row", cut), "row").select(*docs.columns, "cut")


def fill_in_middle(docs: DataFrame, unit: str = "chars", markers: Sequence[str] = MARKERS, rate: int = RATE, spm: int = SPM, block: int = BLOCK) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_units, middle_units (null if plain) and output of each row.

    Where the cuts fall and which form a text gets follow from hashes of its doc_id.  A text that is empty or holds a
    marker stays plain.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select("doc_id", text.alias("text"), *[h.alias(f"h{i + 1}") for i, h in enumerate(hashes())])
    giant = F.octet_length("text") > block
    near = held.filter(~giant).withColumn("cut", _cuts(unit, markers)("text", "h1", "h2"))
    far = held.filter(giant)
    whole = near if far.isEmpty() else near.unionByName(_giant(far, unit, markers, block))
    stays = (F.col("cut.n") == 0) | F.col("cut.marked") | (F.col("h3") % 100 >= rate)
    form = F.when(stays, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    plain, a, b = F.col("text").cast("binary"), F.col("cut.cut_a").cast("int"), F.col("cut.cut_b").cast("int")
    parts = {"prefix": F.substring(plain, F.lit(1), a), "middle": F.substring(plain, a + 1, b - a), "suffix": F.substring(plain, b + 1, F.octet_length("text") - b)}
    prefix, middle, suffix = (p.cast("string") for p in parts.values())
    p, s, m = (F.lit(x) for x in markers)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    changed = F.col("form") != "plain"
    return whole.withColumn("form", form).select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(changed, F.col("cut.first")).alias("prefix_units"),
        F.when(changed, F.col("cut.second") - F.col("cut.first")).alias("middle_units"),
        output.alias("output"),
    )


def restored(output: str = "output", form: str = "form", markers: Sequence[str] = MARKERS) -> Column:
    """The exact text, from output and form.  No marker is in a part, nor can one arise where parts meet."""
    out, p, s, m = F.col(output), *(F.lit(x) for x in markers)

    def between(left: Column, right: Column | None) -> Column:
        rest = F.split_part(out, left, F.lit(2))
        return rest if right is None else F.split_part(rest, right, F.lit(1))

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm_ = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", psm).otherwise(spm_)


def oracle(rate: int = RATE, spm: int = SPM) -> str:
    """DuckDB SQL for the rows of the query, by substrings of code points."""
    h = [f"('0x' || substr(digest, {1 + 8 * i}, 8))::BIGINT" for i in range(4)]
    return f"""
    WITH plain AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
    drawn AS (
      SELECT *, least({h[0]} % (n + 1), {h[1]} % (n + 1)) AS a, greatest({h[0]} % (n + 1), {h[1]} % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {h[2]} % 100 >= {rate} THEN 'plain'
                  WHEN {h[3]} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
      FROM plain),
    cut AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                       ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM cut"""
