import random

import pytest

from tessitura.llm import decontaminate as D

from .conftest import ODD


def words(rng, n, prefix="w"):
    return ["%s%d" % (prefix, rng.randrange(30000)) for _ in range(n)]


def norm(t):
    return [x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or x for x in (t or "").lower().split()]


def overlap(a, b, shift):
    """Does the rule hold for words a and item b laid on a at shift?  In whole numbers, without the operator's helpers."""
    equal = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
    if 5 * sum(equal) >= 4 * len(b):
        return True
    for i in range(len(b)):
        if equal[i]:
            count = 0
            for j in range(i, len(b)):
                count += equal[j]
                if equal[j] and j - i >= 11 and 5 * count >= 4 * (j - i + 1):
                    return True
    return False


def brute(docs, items, least=5):
    """(doc_id, item_id) that overlap at any shift."""
    out = set()
    for d, text in docs:
        a = norm(text)
        for i, item in items:
            b = norm(item)
            if len(b) >= least and any(overlap(a, b, s) for s in range(1 - len(b), len(a))):
                out.add((d, i))
    return out


@pytest.fixture
def case():
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([15, 20, 40, 30, 6, 11, 3])] + [(50, "  "), (51, None)]
    items.append((60, items[1][1]))  # the same text twice
    rows = []
    for j in range(60):
        w = words(rng, 60)
        if j % 3 == 0:
            p = items[rng.randrange(6)][1].split()
            if j % 2 and len(p) >= 15:
                p[7] = "changed"
            w[20:20] = [x.upper() + "," for x in p] if j % 4 == 0 else p
        rows.append((j, " ".join(w)))
    return rows, items


def test_equals_all_shifts(spark, docs, case):
    rows, items = case
    out = D.contaminated(docs(*rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == brute(rows, items)
    assert all(5 * r["n_equal"] >= 4 * r["n_words"] for r in out)


def test_clean_documents(spark, docs, case):
    rows, items = case
    df = docs(*rows, rows[0], *[(500 + i, t) for i, (_, t) in enumerate(ODD)])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = D.clean_documents(df, bench)
    leaked = {d for d, _ in brute(rows, items)}
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted([d for d, _ in rows if d not in leaked] + ([0] if 0 not in leaked else []) + [500 + i for i in range(len(ODD))])


def test_empty_sides(spark, docs, case):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert D.contaminated(docs(*rows).limit(0), bench).count() == 0
    assert D.contaminated(docs(*rows), bench.limit(0)).count() == 0
    assert D.clean_documents(docs(*rows), bench.limit(0)).count() == len(rows)


def test_one_substitution_is_found(spark, docs):
    rng = random.Random(8)
    item = words(rng, 24)
    rows = []
    for j in range(24):
        p = list(item)
        p[j] = "other"
        rows.append((j, " ".join(words(rng, 20) + p + words(rng, 20))))
    out = D.contaminated(docs(*rows), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert {r["doc_id"] for r in out.collect()} == set(range(24))


def most_equal(masks, longest):
    """For each length the most equal words of a pattern that no mask hits, by all last words that differ for the masks."""
    import numpy as np

    span = max(map(len, masks))
    size = 1 << (span - 1)
    most = np.full(size, -1)
    most[0] = 0
    for _ in range(longest):
        new = np.full(size, -1)
        for b in (0, 1):
            last = np.arange(size) << 1 | b
            good = (most >= 0) & ~np.any([(last & int(m, 2)) == int(m, 2) for m in masks], axis=0)
            np.maximum.at(new, last[good] & (size - 1), most[good] + b)
        most = new
        yield int(most.max())


def test_masks_hit_every_overlap():
    """No pattern of 12 words or more with 4 in 5 equal avoids the masks; without one of them some do."""
    assert (D.LEAST_WORDS, D.LEAST_SHARE) == (12, 0.8)
    assert all(5 * most < 4 * n for n, most in enumerate(most_equal(D.MASKS, 400), 1) if n >= 12)
    for k in range(3):
        rest = [m for i, m in enumerate(D.MASKS) if i != k]
        assert any(5 * most >= 4 * n for n, most in enumerate(most_equal(rest, 60), 1) if n >= 12)


@pytest.mark.parametrize("length", range(5, 12))
def test_masks_of_short_items(length):
    import itertools

    masks = D.short_masks(length)
    for changed in itertools.combinations(range(length), length // 5):
        p = "".join("0" if i in changed else "1" for i in range(length))
        assert any(all(p[s + i] == "1" for i, c in enumerate(m) if c == "1") for m in masks for s in range(length - len(m) + 1))


@pytest.mark.parametrize("length", [5, 8, 10, 11, 12, 13, 16, 20, 24, 40])
def test_all_allowed_substitutions_are_found(spark, docs, length):
    """Items with 0 to as many changed words as the rule allows, at the ends too; and one more."""
    rng = random.Random(length)
    items = [(i, " ".join(words(rng, length, "i"))) for i in range(40)]
    rows = []
    for i, item in items:
        for k in range(length // 5 + 2):
            p = item.split()
            for j in rng.sample(range(length), k):
                p[j] = "other"
            rows.append((100 * i + k, " ".join(words(rng, 9, "x") + p + words(rng, 9, "x"))))
    out = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs(*rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert out == {pair for row in rows for pair in brute([row], [items[row[0] // 100]])}
    assert out >= {(100 * i + k, i) for i, _ in items for k in range(length // 5 + 1)}


def test_items_of_a_few_words(spark, docs):
    bench = spark.createDataFrame([(1, "Yes."), (2, "a b c")], "item_id bigint, text string")
    df = docs((1, "no yes no"), (2, "x a b c"), (3, "a b d c"))
    assert D.contaminated(df, bench).count() == 0
    out = D.contaminated(df, bench, least_item=1).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(1, 1), (2, 2)}


def test_periodic_and_multiple_substitutions(spark, docs):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([60, 300, 16, 18, 11])]
    changed = [[j for j in range(r, 300, period)] for period in range(5, 13) for r in range(period)]
    changed += [rng.sample(range(18), 3) for _ in range(60)] + [[5]]
    # Two runs of 11 words, far from each other, with four words in five equal between them.
    changed.append([11 + j for j in range(0, 270, 5)])
    rows = []
    for j, at in enumerate(changed):
        for i, item in items if j < len(changed) - 62 else items[2:] if j < len(changed) - 1 else items[1:2]:
            p = ["other" if k in at else w for k, w in enumerate(item.split())]
            rows.append((10 * j + i, " ".join(words(rng, 5, "x") + p + words(rng, 5, "x"))))
    out = D.contaminated(docs(*rows), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == {pair for row in rows for pair in brute([row], [items[row[0] % 10]])}


def test_any_amount_of_punctuation_is_cut(spark, docs):
    rng = random.Random(10)
    item = words(rng, 15)
    marked = ["(" * 7 + w + "." * j for j, w in enumerate(item)]
    rows = [(1, " ".join(marked)), (2, " ".join(["-" * 9] * 20)), (3, "." * 50_000)]
    out = D.contaminated(docs(*rows), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert [(r["doc_id"], r["n_equal"]) for r in out.collect()] == [(1, 15)]
