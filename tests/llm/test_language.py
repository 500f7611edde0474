import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import langid as L
from tessitura.llm import lm as M
from tessitura.llm import attention as A
from tessitura.llm import subwords

from .conftest import ODD

SYLLABLES = {"en": "the ing ion ter and ght ow ea".split(), "de": "sch ung ein ich ver keit ü zu".split(), "ru": "ов на ст ет про ий".split()}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(text(rng, lang, 60), lang) for lang in SYLLABLES for _ in range(60)] + [(None, "en"), ("x", None)]
    return L.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_held_out_texts(spark, docs, model):
    rng = random.Random(2)
    rows = [(i, text(rng, lang)) for i, lang in enumerate(["en", "de", "ru"] * 30)]
    out = {r["doc_id"]: r for r in L.identify(docs(*rows), model).collect()}
    assert np.mean([out[i]["lang_pred"] == ["en", "de", "ru"][i % 3] for i in range(90)]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_spans_of_mixed_text(spark, docs, model):
    rng = random.Random(3)
    a, b, c = text(rng, "en", 20), text(rng, "de", 20), text(rng, "ru", 20)
    whole = f"{a} \n{b} {c}"
    spans = L.identify(docs((1, whole)), model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de", "ru"]
    assert [whole[s["start"] : s["end"]] for s in spans] == [a, b, c]


def test_odd_texts(spark, docs, model):
    out = {r["doc_id"]: r for r in L.identify(docs(*ODD, (20, "123 -- !"), (21, "漢字"), (22, "ß"), (23, "𝔘")), model).collect()}
    for i in (1, 2, 3, 20):
        assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
    assert all(out[i]["lang_pred"] in SYLLABLES for i in (4, 21, 22, 23))
    empty = L.fit(spark.createDataFrame([], "text string, lang string"))
    assert L.identify(docs((1, "abc")), empty).first()["lang_pred"] == "und"
    assert L.identify(docs((1, "abc")).limit(0), model).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 7))
        s = rng.normal(0, 8, (n, 3))

        def value(p):
            return sum(s[i, a] for i, a in enumerate(p)) - 12 * sum(a != b for a, b in zip(p, p[1:]))

        best = max(map(value, itertools.product(range(3), repeat=n)))
        assert abs(value(L.label_words(s, np.array([0, n]), 12.0)) - best) < 1e-9


def test_scripts():
    raw = np.frombuffer("aé漢я가1ʘ٣१・ء".encode(), np.uint8)
    names = [*L.SCRIPTS, "other"]
    got = [names[i - 1] for i in L.letter_scripts(raw) if i]
    assert got == ["Latin", "Latin", "Han", "Cyrillic", "Hangul", "Latin", "Arabic"]


def test_texts_without_a_letter(spark, docs, model):
    """Digits, marks and punctuation of any script are no letters; all letters are."""
    none = ["٣٤٥ ١٢", "१२३", "・", "\u0301", "１２", "…—", "₤ 5"]
    some = ["א", "ა", "𐐀", "ꙮ", "ⴰ", "x1"]
    out = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs(*enumerate(none + some)), model).collect()}
    assert [out[i] for i in range(len(none))] == ["und"] * len(none)
    assert all(out[len(none) + i] in SYLLABLES for i in range(len(some)))


def test_scripts_narrow_the_candidates(spark, docs, model):
    """A word in a script that only one language uses is in that language, whatever the words around it."""
    text_of = "the ight ing " * 30 + "конституция " + "owea andter " * 30
    spans = L.identify(docs((1, text_of)), model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "ru", "en"]
    uses = np.zeros((L.KINDS, 3), bool)
    uses[1, :2] = uses[3, 1:] = True
    assert L.candidates(np.array([1 << 1, 1 << 3, 1 << 1 | 1 << 3, 1 << 5, 1 << 1 | 1 << 5]), uses).tolist() == [[True, True, False], [False, True, True], [False, True, False], [True] * 3, [True, True, False]]


def test_all_labels_are_learned(spark, docs):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrst"
    rows = [("".join(rng.choices(letters[i % 20] + letters[i // 20], k=6)) + f" {letters[i % 20]}{letters[i // 20]}" * 8, f"l{i:03d}") for i in range(240) for _ in range(2)]
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 240
    equal = L.fit(spark.createDataFrame([("ab ab", "x"), ("ab ab", "w")], "text string, lang string"))
    assert L.identify(docs((1, "ab")), equal).first()["lang_pred"] == "w"


# ------------------------------------------------------------------ language model


def branches(n):
    return np.arange(1, n + 1).reshape(-1, 5)


def plain_log_probs(p, h):
    """Natural log probability of every class at each row of h, one row and branch at a time."""
    out = []
    for row in h.astype(np.float64):
        z = row @ p["branch"]
        z = z - np.log(np.exp(z).sum())
        leaves = [row @ p["leaf"][j] for j in range(len(z))]
        out.append(np.concatenate([z[j] + w - np.log(np.exp(w).sum()) for j, w in enumerate(leaves)]))
    return np.array(out)


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in A.new_params(50, branches(20)).items()}
    x, y, held = rng.integers(0, 50, (3, A.CONTEXT)), rng.integers(0, 20, (3, A.CONTEXT)), rng.random((3, A.CONTEXT)) < 0.7
    target = y.reshape(-1)[held.reshape(-1)]

    def loss(p):
        return -plain_log_probs(p, A.hidden(p, x)[0][held.reshape(-1)])[np.arange(len(target)), target].mean()

    g, h = A.gradients(p, x, y, held), A.hidden(p, x)[0][held.reshape(-1)]
    assert abs(loss(p) + A.log_probs(p, h, target).mean()) < 1e-6
    for name in p:
        at = (x[0, 3], 2) if name == "embed" else tuple(rng.integers(0, n - 1) for n in p[name].shape)
        q = {k: v.copy() for k, v in p.items()}
        q[name][at] += 1e-4
        up = loss(q)
        q[name][at] -= 2e-4
        down = loss(q)
        assert abs(g[name][at] - (up - down) / 2e-4) < 1e-6
    assert (A.hidden(p, x)[0][:, -1] == 1).all() and not g["join"][:, -1].any()
    assert abs(np.exp(plain_log_probs(p, h)).sum(axis=1) - 1).max() < 1e-9


def test_no_position_sees_what_follows():
    rng = np.random.default_rng(1)
    p = A.new_params(50, branches(20))
    x = rng.integers(0, 50, (1, A.CONTEXT))
    changed = x.copy()
    changed[0, 20:] = 7
    assert np.allclose(A.hidden(p, x)[0][:20], A.hidden(p, changed)[0][:20])


def test_great_scores_are_limited():
    rng = np.random.default_rng(1)
    p = A.new_params(50, branches(20))
    x, y = rng.integers(0, 50, (2, A.CONTEXT)), rng.integers(0, 20, (2, A.CONTEXT))
    for name in ("look", "branch", "leaf"):
        p[name] *= np.float32(1e4)
    assert all(np.isfinite(v).all() for v in A.gradients(p, x, y, np.ones(x.shape, bool)).values())
    assert np.isfinite(A.log_probs(p, A.hidden(p, x)[0], y.reshape(-1))).all()


@pytest.mark.parametrize("step", [M.STEP, A.CONTEXT])
def test_every_token_is_scored_once(step):
    n = np.array([0, 1, 5, 31, 32, 33, 60, 61, 200])
    ids = np.arange(int(n.sum())).astype(np.uint16) % 50
    m = M.Classes(np.arange(50) % 9 + 1, np.arange(50) % 20 + 1, 17)
    x, y, text_of, held, scored = M.windows(ids, n, m, step)
    assert np.bincount(np.repeat(text_of, scored.sum(axis=1)), minlength=len(n)).tolist() == (n + 1).tolist()
    assert step < A.CONTEXT or (held == scored).all()
    begin = np.cumsum(n) - n
    for t in range(len(n)):
        own = ids[begin[t] : begin[t] + n[t]]
        assert y[text_of == t][scored[text_of == t]].tolist() == [*m.class_of[own], 17]
        assert x[text_of == t][scored[text_of == t]].tolist() == [0, *m.input_of[own]]


def test_score_equals_plain_loop():
    rng = np.random.default_rng(2)
    p = A.new_params(40, branches(20))
    c = M.Classes(rng.integers(0, 20, 100), rng.integers(1, 40, 100), 3)
    m = M.Model(p, c, rng.integers(0, M.BEFORE + 1, 100), np.log10(rng.random((100, M.BEFORE + 2))).astype(np.float32))
    n = np.array([0, 3, 70, 133])
    ids = rng.integers(0, 100, int(n.sum())).astype(np.uint16)
    got = M.score(m, ids, n)
    for t, (a, k) in enumerate(zip(np.cumsum(n) - n, n)):
        own = ids[a : a + k].astype(int)
        inputs, targets, total, done = [0, *c.input_of[own]], [*c.class_of[own], 3], 0.0, 0
        for s in range(0, k + 1, M.STEP):
            w = np.zeros((1, A.CONTEXT), int)
            part = inputs[s : s + A.CONTEXT]
            w[0, : len(part)] = part
            z = plain_log_probs(p, A.hidden(p, w)[0])
            for j in range(len(part)):
                if s + j >= done:
                    total += z[j, targets[s + j]]
                    done += 1
        share = sum(m.log_share[i, m.before_of[own[j - 1]] if j else M.BEFORE + 1] for j, i in enumerate(own))
        assert abs(got[t] - total / np.log(10) - share) < 1e-3 and done == k + 1


def test_tree_gives_each_class_a_place():
    rng = np.random.default_rng(3)
    code = M._tree(rng.random((M.CLASSES, 9)) * (rng.random((M.CLASSES, 1)) < 0.7), rng.integers(0, 50, M.CLASSES).astype(float))
    assert sorted(code.tolist()) == list(range(M.CLASSES))


def test_scores_of_a_corpus(spark, docs, monkeypatch):
    import math
    import re
    import zlib
    from collections import Counter

    monkeypatch.setattr(M, "SHARD_WORDS", 5000)  # several shards
    rng = random.Random(5)
    rows = [(i, text(rng, ["en", "de"][i % 2], 80)) for i in range(240)] + [(1000 + i, t) for i, (_, t) in enumerate(ODD)]
    df = docs(*rows)
    out = {r["doc_id"]: r for r in M.language_scores(df, M.fold(7) == 2).collect()}
    assert len(out) == len(rows)
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    train = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for _, t in train for w in low(t))
    total, unit = sum(c.values()) + len(train), math.log10(sum(c.values()) + len(train) + len(c) + 1 + 1)
    for d, t in rows:
        w = low(t)
        base = sum(math.log10(c[x] + 1) - unit for x in w) + math.log10(len(train) + 1) - unit
        r = out[d]
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, total)
        assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(d).encode()) % 7 == 2)
    # Neither partitions nor order matter.
    again = {r["doc_id"]: r["score"] for r in M.language_scores(df.repartition(5, "text"), M.fold(7) == 2).collect()}
    assert all(abs(again[d] - r["score"]) < 1e-4 * abs(r["score"]) for d, r in out.items())
    held = [r for d, r in out.items() if r["held_out"] and d < 1000]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_common_words_without_a_slot(spark, docs, monkeypatch):
    """With few slots most words lose theirs: the base is the same."""
    rng = random.Random(6)
    df = docs(*[(i, text(rng, "en", 30)) for i in range(30)])
    known = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in M.language_scores(df, M.fold(7) == 2).collect()}
    monkeypatch.setattr(M, "HEAD_BITS", 3)
    counts = M.count_words(df)
    assert len(counts.head.value[2]) > 50
    assert {r["doc_id"]: (r["n_known"], round(r["base_score"], 6)) for r in M.language_scores(df, M.fold(7) == 2).collect()} == known


def test_no_training_rows(spark, docs):
    out = M.language_scores(docs((1, "a b"), (2, None)), F.lit(True)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in sorted(out, key=lambda r: r["doc_id"])] == [(3, 0, 0), (1, 0, 0)]
    assert M.language_scores(docs((1, "a")).limit(0), F.lit(True)).count() == 0
    assert subwords.vocabulary_path().endswith(subwords.VOCABULARY)


def test_every_training_window_is_trained_on(monkeypatch):
    """Also those of texts of one window: the rounds take each window once and leave none out, however rows are cut in parts."""
    import pyarrow as pa
    import zstandard

    rng = np.random.default_rng(4)
    n = np.array([0, 1, 5, 20, 31, 32, 60, 300, 2000, 7])
    ids = rng.integers(0, 100, int(n.sum())).astype(np.uint16)
    m = M.Classes(rng.integers(1, 12, 100), rng.integers(1, 40, 100), 0)
    seen = []

    def taken(p, x, y, held):
        seen.extend((a[c].tobytes(), b[c].tobytes()) for a, b, c in zip(x, y, held))
        return {k: np.zeros_like(v) for k, v in p.items()}

    monkeypatch.setattr(M.attention, "gradients", taken)
    monkeypatch.setattr(M, "MIXED_WINDOWS", 30)
    monkeypatch.setattr(M, "GROUP_TEXTS", 2)
    monkeypatch.setattr(M, "MOST_IDS", 3)
    p = A.new_params(40, branches(20))
    stop = np.cumsum(n)
    packed = [zstandard.compress(ids[b - k : b].tobytes()) for b, k in zip(stop, n)]
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(10) * 7 - 9), pa.array(np.array([0, 0, 0, 1, 1, 1, 1, 4, 4, 4], np.int32)), pa.array(packed, pa.binary())], names=["key", "shard", "ids"])
    parts = list(M._parts([rows.slice(0, 4), rows.slice(4, 0), rows.slice(4)]))
    assert [sum(len(g[2]) for g in part) for part in parts] == [3, 1, 2, 1, 2, 1]
    sizes = [M._train_part(p, part, m, r)[1] for part in parts for r in range(M.ROUNDS)]
    x, y, _, held, _ = M.windows(ids, n, m, A.CONTEXT)
    assert sum(sizes) == len(x)
    assert sorted(seen) == sorted((a[c].tobytes(), b[c].tobytes()) for a, b, c in zip(x, y, held))
