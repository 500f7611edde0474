import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import fim as M

from .conftest import ODD

TEXTS = ["", None, "a", "é漢\U0001f600", "with <P> marker", "<S", "<<M>", "< P>", "a<P", "x" * 3000, "é漢\U0001f600 <" * 400, "long " * 4000, "tail <M>" * 900, "<P" * 700]


def brute(i, text, block=None):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in M.MARKERS) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def drawn(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(n)]), rng.choice(TEXTS)) for _ in range(n)]
    return rows + [(i, "".join(rng.choice("ab <PSM>é漢\U0001f600") for _ in range(rng.randint(0, 2500)))) for i in range(n, 2 * n)]


@pytest.mark.parametrize("block", [M.BLOCK, 512, 1000])
def test_outputs_equal_brute_force_with_any_block(spark, docs, block):
    rows = drawn(block, 120)
    out = M.fill_in_middle(docs(*rows), block=block).withColumn("back", M.restored()).collect()
    assert Counter(tuple(r)[:6] for r in out) == Counter(brute(*r) for r in rows)
    assert Counter((r["doc_id"], r["back"]) for r in out) == Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_query_equals_sql(spark, docs):
    from tessitura.llm.queries import fim_digest

    df = docs(*drawn(5, 150))
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toArrow())
    assert Counter(tuple(r) for r in fim_digest(df).collect()) == Counter(con.execute(M.oracle()).fetchall())


@pytest.mark.parametrize("unit", ["chars", "words"])
def test_functions_of_chunks_compose_to_the_whole(unit):
    a, rng = M.automaton(unit), np.random.default_rng(3)
    raw = np.frombuffer("".join(rng.choice(list("ab <PSM>é\t漢"), 5000)).encode(), np.uint8)
    whole = M.scan(a, raw, np.array([0]), np.array([len(raw)]))
    for cuts in (3, 40, 700):
        e = np.sort(np.concatenate([[0, len(raw)], rng.integers(0, len(raw), cuts)]))
        f = M.prefixes(*M.scan(a, raw, e[:-1], e[1:]), np.array([len(e) - 1]))
        assert (f[0][-1] == whole[0][0]).all() and (f[1][-1] == whole[1][0]).all()
    left, right = M.scan(a, raw, np.array([0]), np.array([777])), M.scan(a, raw, np.array([777]), np.array([len(raw)]))
    both = M.compose(left, right)
    assert (both[0] == whole[0]).all() and (both[1] == whole[1]).all()


def test_units_begin_where_a_pattern_says():
    text = "one  two\tthree é漢 \n end"
    raw = np.frombuffer(text.encode(), np.uint8)

    def begins(unit, n):
        places = np.zeros(n + 1, int)
        return M.locate(M.automaton(unit), raw, places, places + len(raw), places, np.arange(n + 1)).tolist()

    words = [len(text[: m.start()].encode()) for m in re.finditer("[^ \t-\r]+", text)]
    assert begins("words", len(words)) == [*words, len(raw)]
    assert begins("chars", len(text)) == [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert M.automaton("chars").states == 4  # the states behind the three markers' first two characters are one
    with pytest.raises(ValueError, match="no such unit"):
        M.automaton("lines")


def test_words_are_cut_whole(spark, docs):
    rows = [(i, " ".join(["alpha", "beta", "gamma"] * 300)) for i in range(40)]
    for block in (M.BLOCK, 700):
        for r in M.fill_in_middle(docs(*rows), unit="words", block=block).collect():
            parts = re.split("<[PSM]>", r["output"])
            assert r["n"] == 900 and all(re.fullmatch("((alpha|beta|gamma) ?)*", x) for x in parts)


def test_odd_and_no_rows(spark, docs):
    out = M.fill_in_middle(docs(*ODD), block=4096).collect()
    assert Counter(tuple(r) for r in out) == Counter(brute(*r) for r in ODD)
    assert M.fill_in_middle(docs(*ODD).limit(0)).count() == 0
    assert M.fill_in_middle(docs(*ODD).filter(F.col("doc_id") == 8), block=64).count() == 1
