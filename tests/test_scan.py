"""Two-pass scans against plain loops: groups and ties across ranges, hot groups, nulls, empty tables."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessitura.operators.scan import running

SCHEMA = "g string, h int, v double, n long, id long"


def made(spark, rows, parts=8):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def rows_of(seed, n=600):
    rng = random.Random(seed)
    names = ["hot"] * 6 + ["a", "b", "c", None]
    return [(rng.choice(names), rng.choice([1, 1, 1, 2, None]), float(rng.randint(-9, 9)), rng.randint(0, 5), i) for i in range(n)]


def null_first(v):
    return (v is not None, v if v is not None else 0)


@pytest.mark.parametrize("parts", [1, 3, 8, 40])
@pytest.mark.parametrize("by", [(), ("g",), ("g", "h")])
def test_running_sums_equal_a_loop(spark, parts, by):
    rows = rows_of(parts)
    out = running(made(spark, rows), [F.desc("v"), F.asc("id")], {"total": F.col("n"), "place": F.lit(1).cast("long")}, by, parts).collect()
    want, sums = {}, defaultdict(lambda: [0, 0])
    for g, h, v, n, i in sorted(rows, key=lambda r: (-r[2], r[4])):
        s = sums[tuple({"g": g, "h": h}[b] for b in by)]
        s[0] += n
        s[1] += 1
        want[i] = (s[0], s[1])
    assert {r["id"]: (r["total"], r["place"]) for r in out} == want and len(out) == len(rows)


def test_ties_across_ranges_get_each_place_once(spark):
    rows = [("same", 1, 0.0, 1, 7)] * 500 + [("same", 1, 1.0, 1, 8)] * 300
    out = running(made(spark, rows), [F.desc("v")], {"place": F.lit(1).cast("long")}, ("g",), 8).collect()
    assert sorted(r["place"] for r in out) == list(range(1, 801))
    assert {r["place"] for r in out if r["v"] == 1.0} == set(range(1, 301))


def test_doubles_empty_tables_and_taken_names(spark):
    rows = [(None, None, None, None, i) for i in range(10)]
    out = running(made(spark, rows), [F.col("id")], {"share": F.lit(0.5)}, ("g",), 4).orderBy("id").collect()
    assert [r["share"] for r in out] == [0.5 * (i + 1) for i in range(10)]
    assert running(made(spark, rows).limit(0), [F.col("id")], {"share": F.lit(0.5)}).count() == 0
    with pytest.raises(ValueError, match="scan_x"):
        running(made(spark, rows).withColumn("scan_x", F.lit(1)), [F.col("id")], {"share": F.lit(0.5)})


def test_no_window_orders_rows_in_one_task(spark):
    """The only window without a partition is over one row a range."""
    out = running(made(spark, rows_of(1)), [F.col("v")], {"total": F.col("n")}, (), 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    singles = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert all("scan_part" in plan[plan.index(line) - 4000 : plan.index(line)] for line in singles) and len(singles) <= 2
