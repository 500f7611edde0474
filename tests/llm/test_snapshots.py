import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessitura.llm import snapshots as S

from .conftest import ODD, SCHEMA

def first_null(v):
    return (v is not None, v if v is not None else 0)


def content_order(row):
    held = ["-" if v is None else f"{len(v.encode())}:{v}" for v in row[1:]]
    return hashlib.sha256("".join(held).encode()).hexdigest()[:32]


def brute(earlier, later):
    """changes() by dictionaries; rows are (key, text, lang, source)."""
    out, gone, come = [], defaultdict(list), defaultdict(list)
    by = defaultdict(lambda: ([], []))
    for side, rows in enumerate((earlier, later)):
        for r in rows:
            by[r[0]][side].append(r)
    sha = lambda r: hashlib.sha256("\n".join("~" if v is None else v for v in r[1:]).encode()).hexdigest()
    for old, new in by.values():
        old.sort(key=content_order)
        new.sort(key=content_order)
        for o, n in zip(old, new):
            changed = ",".join(name for name, a, b in zip(S.COMPARED, o[1:], n[1:]) if a != b)
            out.append((n[0], o[0], "update" if changed else "same", changed, sha(n)))
        for o in old[len(new) :]:
            gone[o[1:]].append(o)
        for n in new[len(old) :]:
            come[n[1:]].append(n)
    for c in gone.keys() | come.keys():
        old = sorted(gone[c], key=lambda r: first_null(r[0]))
        new = sorted(come[c], key=lambda r: first_null(r[0]), reverse=True)
        out += [(n[0], o[0], "rekey", "", sha(n)) for o, n in zip(old, new)]
        out += [(o[0], o[0], "delete", "", None) for o in old[len(new) :]]
        out += [(n[0], None, "insert", "", sha(n)) for n in new[len(old) :]]
    return Counter(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).withColumn("rank", F.lit("clash")).withColumn("key", F.lit("clash"))


def drawn(seed, n, keys):
    rng = random.Random(seed)
    texts = [None, "", "~", "a", "b", "a\nb", "long " * 3000]
    return [(rng.choice([None, *range(keys)]), rng.choice(texts), rng.choice([None, "en", "~"]), rng.choice([None, "s", "t"])) for _ in range(n)]


@pytest.mark.parametrize("seed, n, keys", [(1, 150, 60), (2, 400, 2), (3, 300, 5000)])
def test_changes_equal_brute_force(spark, seed, n, keys):
    earlier, later = drawn(seed, n, keys), drawn(seed + 100, n + 20, keys)
    got = Counter(tuple(r) for r in S.changes(table(spark, earlier), table(spark, later)).collect())
    assert got == brute(earlier, later)


def test_later_documents_and_sql(spark, docs):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "one text", "another", f"own {i}"]), rng.choice(["s", "s", "s", None])) for i in range(500)]
    df = docs(*rows).withColumn("lang", F.when(F.col("doc_id") % 7 != 0, "en"))
    later, plain = [], [(i, t, "en" if i % 7 else None, s) for i, t, s in rows]
    for i, t, lang, s in plain:
        kind = zlib.crc32(str(i).encode()) % 10
        if kind == 1:
            t = (t or "") + "+"
        if kind == 2:
            lang, s = s, lang
        if kind == 5:
            later.append((-1 - i, t, lang, s))
        if kind:
            later.append((-1 - i if kind in (3, 4) else i, t, lang, None if kind == 4 else s))
    got = Counter(tuple(r) for r in S.changes(df, S.later_documents(df)).collect())
    assert got == brute(plain, later) and {r[2] for r in got} == {"same", "update", "rekey", "insert", "delete"}
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang", "source").toArrow())
    assert Counter(con.execute(S.oracle()).fetchall()) == got


def test_one_content_in_all_rows_is_not_ranked_in_one_task(spark):
    """2,000 unpaired rows a side with one content: no task of the ranking holds more than its share."""
    old, new = [(i, "t", "en", "s") for i in range(2000)], [(-1 - i, "t", "en", "s") for i in range(2000)]
    got = {(r["key"], r["old_key"], r["op"]) for r in S.changes(table(spark, old).repartition(4), table(spark, new).repartition(4)).collect()}
    assert got == {(-1 - i, i, "rekey") for i in range(2000)}


def test_odd_rows_and_empty_snapshots(spark, docs):
    df = docs(*ODD)
    n = len(ODD)
    assert [r["op"] for r in S.changes(df, df).collect()] == ["same"] * n
    assert {r["op"] for r in S.changes(df, df.limit(0)).collect()} == {"delete"}
    inserted = S.changes(df.limit(0), df).collect()
    assert len(inserted) == n and {(r["op"], r["old_key"]) for r in inserted} == {("insert", None)}
    assert S.changes(df.limit(0), df.limit(0)).count() == 0
    assert S.changes(df, S.later_documents(df)).count() >= n - 3
