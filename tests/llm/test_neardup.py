import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessitura.llm import neardup as N
from tessitura.llm.components import components

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    """component by row position"""
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * len(a | sets[j]):
                group[root(i)] = root(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(i)
    least = {}
    for m in members.values():
        ids = [rows[i][0] for i in m if rows[i][0] is not None]
        for i in m:
            least[i] = min(ids) if ids else None
    return [len(s) for s in sets], least


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
    return " ".join(w)


def corpus(seed, groups=12):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = ["w%d" % rng.randrange(5000) for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.randint(1, 12)):
            rows.append((i, edited(rng, base, rng.choice([0, 0, 1, 2, 3, 6]) if len(base) > 8 else 0)))
            i += 1
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 85), (2, 5, 80)])
def test_equals_all_pairs(spark, docs, seed, k, percent):
    rows = corpus(seed) + [(900 + j, t) for j, (_, t) in enumerate(ODD)] + [(None, None), (5, "Two Words")]
    n, want = brute(rows, k, percent)
    out = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs(*rows), k, percent).collect()]
    expected = []
    for i, (d, _) in enumerate(rows):
        c = d if n[i] == 0 else want[i]
        expected.append((d, n[i], c, d == c))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, out)) == sorted(map(key, expected))


def test_equals_sql(spark, docs):
    df = docs(*corpus(4))
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    assert sorted(tuple(r) for r in N.near_duplicates(df, 3, 85).collect()) == sorted(con.execute(N.oracle()).fetchall())


@pytest.mark.parametrize("pivots", [16, 2, 0])
def test_crowded_places_and_families_are_cut_in_blocks(spark, docs, monkeypatch, pivots):
    """With small blocks and few pivots most links are left to the second step."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "FAMILY_BLOCK", 6)
    monkeypatch.setattr(N, "PIVOTS", pivots)
    rng = random.Random(9)
    base = ["w%d" % i for i in range(80)]
    rows = [(i, edited(rng, base, rng.choice([1, 2, 3]))) for i in range(60)] + [(100, " ".join(base))] + [(200 + i, " ".join("v%d" % rng.randrange(9999) for _ in range(30))) for i in range(20)]
    _, want = brute(rows, 3, 85)
    out = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs(*rows), 3, 85).collect()}
    assert out == {d: want[i] for i, (d, _) in enumerate(rows)}


def test_unlike_clusters_in_one_place(spark, monkeypatch):
    """One key with clusters that share no signature, cut in blocks without a pivot: what belongs together is joined, and no more."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "PIVOTS", 0)
    rng = np.random.default_rng(4)
    rows, node = [], 1
    for size in (30, 9, 5, 2, 1, 1):
        sig = rng.integers(0, 2**63, 4, dtype=np.uint64)
        for _ in range(size):
            rows.append((node, sig.tobytes(), [77]))
            node += 1
    rng.shuffle(rows := list(rows))
    labels = N._families(spark.createDataFrame(rows, "node bigint, sig binary, bands array<bigint>"), 85).collect()
    assert {r["node"]: r["label"] for r in labels} == {**{i: 1 for i in range(1, 31)}, **{i: 31 for i in range(31, 40)}, **{i: 40 for i in range(40, 45)}, 45: 45, 46: 45}


def test_families_are_cut_by_size_of_sets(spark, docs, monkeypatch):
    monkeypatch.setattr(N, "FAMILY_SHINGLES", 150)
    rng = random.Random(12)
    base = ["w%d" % i for i in range(60)]
    rows = [(i, edited(rng, base, 1)) for i in range(12)]
    _, want = brute(rows, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs(*rows), 3, 85).collect()} == {d: want[i] for i, (d, _) in enumerate(rows)}


def test_one_of_each_group_stays(spark, docs):
    rows = corpus(6) + [(3, None), (4, ""), (None, "null id with enough words to be a text of its own"), (None, "null id with enough words to be a text of its own")]
    rows += [rows[0], rows[0]]
    df = docs(*rows)
    out = N.deduplicated(df, 5, 80)
    assert out.columns == df.columns
    n, want = brute(rows, 5, 80)
    groups = {("id", want[i]) if n[i] else ("row", i) for i in range(len(rows))}
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(kept) == len(groups)
    assert all(d == want[rows.index((d, t))] for d, t in kept if t)
    assert N.deduplicated(df.limit(0)).count() == 0 and N.near_duplicates(df.limit(0)).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            common = rng.integers(0, 2**63, int(400 * share), dtype=np.uint64)
            own = [rng.integers(0, 2**63, 400 - len(common), dtype=np.uint64) for _ in range(2)]
            sets = [np.concatenate([common, o]) for o in own]
            _, packed, _ = N._signatures(np.concatenate(sets), np.array([400, 400]))
            true = len(common) / (800 - len(common))
            errors.append(N._estimates(packed[:1], packed[1:])[0] - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_shingle_sets():
    texts = ["a b c d", "A B C D", "a b", "", None, "a b c a b c", "x"]
    sets, counts = N.shingle_sets(pa.array(texts), 3)
    assert counts.tolist() == [len(shingles(t, 3)) for t in texts]
    assert sorted(sets[:2].tolist()) == sorted(sets[2:4].tolist())


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7)]
    rng.shuffle(edges)
    out = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100, **{500 + i: 500 for i in range(50)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
