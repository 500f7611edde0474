import random

import pytest

import corpus_pipeline as P
from tessitura.llm import mixing as M

from .conftest import SCHEMA
from .test_decontaminate import brute as leaks
from .test_neardup import brute as groups
from .test_quality import brute as measures
from .test_quality import brute_kept


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(4000)]
    words = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(words(25))) for i in range(4)]
    rows = []
    for i in range(120):
        w = words(rng.randint(60, 160))
        if i % 15 == 0:
            w[30:30] = items[i // 15 % 4][1].split()
        rows.append((i, " ".join(w), "en", f"s{i % 5}", None))
    for i in range(30):  # near copies
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w), "en", "s0", None))
    rows += [(400, "too short", "en", "s1", None), (401, "a b c d e " * 40, "en", "s1", None), (402, None, None, None, None), rows[3], rows[3]]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), rows, items


def test_stages_against_brute_force(spark, folder):
    at, rows, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality rules", "near-duplicates", "decontamination", "source mixing", "sharding"]
    stage = dict(P.STAGES)
    good = stage["quality rules"](spark, docs, at)
    assert good.columns == docs.columns
    want = [r for r in rows if not measures(r[1])[5] and brute_kept(r[1])]
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r[0] for r in want)
    one = stage["near-duplicates"](spark, good, at)
    n, component = groups([(r[0], r[1]) for r in want], 5, 80)
    heads = sorted(set(component.values()))
    assert sorted(r["doc_id"] for r in one.collect()) == heads
    clean = stage["decontamination"](spark, one, at)
    leaked = {d for d, _ in leaks([(r[0], r[1]) for r in want if r[0] in heads], items)}
    assert leaked and sorted(r["doc_id"] for r in clean.collect()) == sorted(set(heads) - leaked)
    mix = stage["source mixing"](spark, clean, at)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in M.mixed(clean).collect()}
    assert sorted(r["doc_id"] for r in mix.collect()) == sorted(d for d, k in taken.items() for _ in range(k))
    assert mix.columns == docs.columns
    shards = stage["sharding"](spark, mix, at).collect()
    assert sorted(r["doc_id"] for r in shards) == sorted(r["doc_id"] for r in mix.collect())
    whole = P.run(spark, at).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, shards))


def test_empty_documents(spark, folder, tmp_path):
    at, *_ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, f in P.STAGES:
        docs = f(spark, docs, at)
    assert docs.count() == 0
