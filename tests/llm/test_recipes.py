import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessitura.llm import recipes as R

from .conftest import ODD


def norm(text):
    return re.sub("[ \t-\r]+", " ", text or "")


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[norm(r[1])].append(r[0])
    out = Counter()
    for whole, ids in by.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            out[i, ids[0], len(ids), k == 0, hashlib.sha256(whole.encode()).hexdigest()] += 1
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    texts = ["", None, " ", "\t\n", "one  two", "one two", "one\x0btwo", " one two", "one two ", "é漢\U0001f600 x"]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(1, 900))) for _ in range(6)]
    texts += [t + " end" for t in texts[-6:]] + ["x" * 50_000, "x" * 50_001, "hot"]
    return [(rng.choice([None, *range(n)]), rng.choice([*texts, "hot", "hot", "hot"])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force_and_sql(spark, docs, seed):
    rows = random_rows(seed, 400)
    df = docs(*rows).repartition(5)
    got = Counter(tuple(r) for r in R.exact_duplicates(df).collect())
    assert got == brute(rows)
    assert Counter(tuple(r) for r in R.exact_duplicates(df, words=2, most=7).collect()) == got
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toArrow())
    assert Counter(con.execute(R.oracle()).fetchall()) == got


def test_chunks_follow_content_and_make_up_the_text(spark, docs):
    rng = random.Random(3)
    a, b = ([f"w{rng.randint(0, 10**6)}" for _ in range(4000)] for _ in "ab")
    rows = [(1, " ".join(a)), (2, " ".join(b[:777] + a)), (3, "y" * 40_000 + " z")]
    cut = {r["doc_id"]: ([bytes(c) for c in r["chunks"]], r["whole"]) for r in R.chunked(docs(*rows), 64, 4096).collect()}
    for chunks, whole in cut.values():
        assert b"".join(chunks).decode() == whole and max(map(len, chunks)) <= 4096
    own, moved = set(cut[1][0]), set(cut[2][0])
    assert len(own) > 30 and len(own - moved) <= 1  # the same passage, moved, has the same chunks but for its first


def test_identifiers_are_verified(spark, docs):
    """Under the first two salts chunks share identifiers; a third is taken, and texts stay apart."""
    tried = []

    def ids(chunk, salt):
        tried.append(salt)
        return F.md5(F.substring(chunk, 1, 1)) if salt == 0 else F.lit("0" * 32) if salt == 1 else R.md5_id(chunk, salt)

    rows = [(1, "a b"), (2, "a c"), (3, "a b"), (4, "d")]
    out = R.exact_duplicates(docs(*rows), ids=ids)
    assert Counter(tuple(r) for r in out.collect()) == brute(rows) and set(tried) == {0, 1, 2}
    with pytest.raises(ValueError, match="share identifiers"):
        R.exact_duplicates(docs(*rows), ids=lambda c, s: F.lit("0" * 32), salts=2)


def test_a_cut_in_a_long_word_differs_from_a_space(spark, docs):
    """'xxxx' + 'yy' cut at four bytes, and the words 'xxxx' and 'yy'."""
    rows = [(1, "xxxxyy"), (2, "xxxx yy"), (3, "xxxx  yy")]
    assert Counter(tuple(r) for r in R.exact_duplicates(docs(*rows), words=1, most=4).collect()) == brute(rows)


def test_store_and_restored_texts(spark, docs, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(random_rows(4, 60))]
    folder = f"file://{tmp_path}/store"
    kept = R.store(docs(*rows), folder, words=8, most=64)
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.distinct().count() == chunks.select("id").distinct().count()
    assert {r["doc_id"]: r["text"] for r in R.restored(kept, chunks).collect()} == {i: norm(t) for i, t in rows}


def test_odd_and_no_rows(spark, docs):
    assert Counter(tuple(r) for r in R.exact_duplicates(docs(*ODD)).collect()) == brute(ODD)
    assert R.exact_duplicates(docs(*ODD).limit(0)).count() == 0


def test_no_python_on_the_path(spark, docs):
    plan = R.exact_duplicates(docs(*ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
