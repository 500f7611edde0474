import random
import re

import zstandard
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa

from tessitura.llm import common, quality as Q

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def brute_kept(text):
    b = (text or "").encode()
    z = zstandard.ZstdCompressor(level=Q.LEVEL)
    low, high = 0, float("inf")
    for least, a, c in Q.BANDS:
        if len(b) >= least:
            low, high = a, c
    r = len(b) / len(z.compress(b)) if b else 0
    parts = [b[i : i + Q.CHUNK] for i in range(0, len(b), Q.CHUNK)]
    ratios = [len(p) / len(z.compress(p)) for p in parts if len(p) >= Q.LEAST_CHUNK]
    bad = sum(not Q.CHUNK_BAND[0] <= x <= Q.CHUNK_BAND[1] for x in ratios)
    return low <= r <= high and not (ratios and bad > Q.CHUNK_SHARE * len(ratios))


def test_equals_brute_force(spark, docs):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 80, 700])))) for i in range(60)]
    rows += [(100, "a b c d e\n" * 30), (101, "".join(rng.choices([chr(c) for c in range(32, 122)], k=4000))), (102, rows[5][1] + "\nline one here\nline one here\n\n")]
    rows += [(200 + i, t) for i, (_, t) in enumerate(ODD)]
    out = Q.quality_measures(docs(*rows)).collect()
    want = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute(want[r["doc_id"]]), r["doc_id"]
        assert r["kept"] == (not got[5] and brute_kept(want[r["doc_id"]]))
    assert not next(r for r in out if r["doc_id"] == 101)["kept"]


def test_filter_and_empty(spark, docs):
    rng = random.Random(2)
    good = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(300))
    df = docs((1, good), (2, None), (3, "a b c d e " * 100))
    assert [r["doc_id"] for r in Q.quality_documents(df).collect()] == [1]
    assert Q.quality_documents(df).columns == df.columns
    assert Q.quality_measures(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab é漢\n\t\x0b\x85\xa0 "), max_size=30)), max_size=6))
def test_words_as_in_the_pattern(texts):
    raw, at = common.utf8(pa.array(texts, pa.string()))
    starts, ends, first = common.words(raw, at)
    data = raw.tobytes()
    got = [[data[a:b].decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    h = common.word_hashes(raw, starts, ends, lower=False)
    flat = [w for ws in got for w in ws]
    assert len({*zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))
    assert np.array_equal(common.ragged(np.array([2, 0, 3])), [0, 1, 0, 1, 2])
