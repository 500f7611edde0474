import random
import zlib

import duckdb
import pytest

from tessitura.llm import mixing as M
from tessitura.llm import sharding as S

from .conftest import ODD


def test_shards_are_contiguous_and_near_equal(spark, docs):
    rng = random.Random(3)
    rows = [(i if i % 50 else None, "w" * rng.randint(0, 3000)) for i in range(400)] + [(7, "copy")] * 60
    out = S.byte_shards(docs(*rows), 8).collect()
    assert len(out) == len(rows)
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    ordered = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in out)
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for _, t in rows)


def test_shards_of_odd_rows(spark, docs):
    assert S.byte_shards(docs(*ODD)).count() == len(ODD)
    assert S.byte_shards(docs(*ODD).limit(0)).count() == 0
    assert [(r["shard"], r["slot"]) for r in S.byte_shards(docs((1, "a")), 1).collect()] == [(0, 0)]


def test_shards_equal_sql(spark, docs):
    rng = random.Random(4)
    rows = [(i if i % 9 else None, rng.choice(["", "é漢😀", "w " * rng.randint(0, 90)])) for i in range(200)] + [(5, "copy")] * 3 + [(6, None)]
    df = docs(*rows)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toArrow())
    got = sorted(tuple(r) for r in S.byte_shards(df, 7).select(S.F.coalesce("doc_id", S.F.lit(-1)), "size", "text_crc32", "shard", "slot").collect())
    want = sorted((-1 if r[0] is None else r[0], r[1], r[2], r[4], r[5]) for r in con.execute(S.oracle(7)).fetchall())
    assert got == want


def duck(spark, df):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toPandas())
    return con.execute(M.oracle()).fetchall()


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_sql(spark, docs, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", "Z", None])) for i in range(500)] + [(1, None, "empty"), (2, "x", "tiny")]
    df = docs(*rows)
    got = sorted(tuple(r) for r in M.mixed(df).collect())
    want = sorted(duck(spark, df))
    assert [(g[0], g[1], g[2], round(g[3], 6), g[4]) for g in got] == [(w[0], w[1], w[2], round(w[3], 6), w[4]) for w in want]
    assert sorted(tuple(r) for r in M.mixed(df).collect()) == got


def test_mix_reaches_targets(spark, docs):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(1, 20)), rng.choice("aaabc")) for i in range(3000)]
    out = M.mixed(docs(*rows)).toPandas()
    by = out.assign(source=[dict((r[0], r[2]) for r in rows)[d] for d in out.doc_id]).groupby("source")
    for _, g in by:
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 11 and g.source_size.iloc[0] == g["size"].sum()
    assert (out.taken <= 3 * out["size"]).all() and abs(by.target.first().sum() - out["size"].sum()) < 1e-6


def test_mixed_documents_repeat_rows(spark, docs):
    df = docs(*[(i, "a b c", "a") for i in range(40)], *[(100 + i, "a b c", "b") for i in range(400)], (999, None, None))
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    taken = {r["doc_id"]: r["taken"] // 3 for r in M.mixed(df).collect() if r["size"]}
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in counts.items() if k != 999}
    assert M.mixed(df.limit(0)).count() == 0 and M.mixed_documents(df.limit(0)).count() == 0


def test_no_row_is_taken_more_often_than_the_limit(spark, docs):
    """A source at its limit of three passes has no rest, and its empty documents get none either."""
    df = docs(*[(i, "a b c", "a") for i in range(4)], *[(50 + i, "", "a") for i in range(30)], *[(100 + i, "a b c", "b") for i in range(400)])
    counts = {r["doc_id"]: r["count"] for r in M.mixed_documents(df).groupBy("doc_id").count().collect()}
    assert {counts[i] for i in [*range(4), *range(50, 80)]} == {3} and max(counts.values()) == 3


def test_mix_of_odd_rows(spark, docs):
    assert M.mixed(docs(*ODD)).count() == len(ODD)
