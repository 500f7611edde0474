"""Distributed linear machines against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.ml import estimators as E
from tessitura.ml import linear, search


def made(spark, n=240, d=8, holes=True, seed=0, parts=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(0, 1, (n, d)) * np.arange(1, d + 1) + np.where(np.arange(d) % 2, y[:, None] * 1.2, 0) * np.arange(1, d + 1) + 10
    if holes:
        x[rng.random((n, d)) < 0.05] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in x[i]], int(y[i]), [int(i % 3)]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id int, x array<double>, target int, parts array<int>").repartition(parts), x, y


CONFIGS = [(0, "svm_linear", 100, 0.1, None, None, None, None, None, 0, 0), (1, "svm_linear", 50, 1.0, None, None, None, None, None, 0, 0), (2, "svm_linear", 50, 10.0, None, None, None, None, None, 0, 0)]


def exact(x, y, fit, percentile, c, columns):
    wide = x[:, columns]
    pre = E.Preprocess(percentile).fit(wide[fit], y[fit])
    z = pre(wide[fit])
    m = E.SVM(c, tol=1e-5).fit(z, y[fit])
    w = m.weight @ m.support
    s = np.where(y[fit] == 1, 1, -1)
    loss = (c * E.class_weights(y[fit]) * np.maximum(0, 1 - s * m.score(z))).sum()
    return w @ w / 2 + loss, [E.balanced_accuracy(y[p], m.predict(pre(wide[p]))) for p in (fit, ~fit)]


@pytest.mark.parametrize("holes", [True, False])
def test_objectives_equal_the_exact_machines(spark, holes):
    rows, x, y = made(spark, holes=holes)
    columns = {"all": list(range(8)), "few": [1, 3, 4]}
    configs = search.configurations(spark, CONFIGS)
    units = spark.createDataFrame([(0, s, c, f) for s in columns for c in range(3) for f in range(3)], "split int, scenario string, candidate int, fold int")
    out = linear.fit_units(rows, units, configs, columns).collect()
    assert len(out) == 18
    for r in out:
        c = CONFIGS[r["candidate"]]
        want, scores = exact(x, y, np.arange(240) % 3 != r["fold"], c[2], c[3], columns[r["scenario"]])
        assert want * (1 - 1e-4) <= r["objective"] <= want * 1.01, (r, want)
        assert [r["train_score"], r["valid_score"]] == pytest.approx(scores, abs=0.05)


def test_partitions_do_not_matter(spark):
    rows, _, _ = made(spark, holes=False)
    configs = search.configurations(spark, CONFIGS[:1])
    units = spark.createDataFrame([(0, "all", 0, 0)], "split int, scenario string, candidate int, fold int")
    one, many = (linear.fit_units(rows.repartition(k), units, configs).first()["objective"] for k in (1, 9))
    assert one == pytest.approx(many, rel=1e-3)


def test_training_goes_on_beyond_what_a_task_may_hold(spark, monkeypatch):
    """With the limit set below the table, a linear search runs whole, and equals the exact one; one of networks runs whole too."""
    from tests.test_plans import CONFIG, SMALL, features
    from tessitura.plans import runner

    rows = features(spark)
    exact_run = runner.single(rows, CONFIG, SMALL[:1])
    want = {(r["scenario"], r["fold"]): r["valid_score"] for r in exact_run.cv.collect()}
    monkeypatch.setattr(search, "MOST_BYTES", 100)
    run = runner.single(rows, CONFIG, SMALL[:1])
    got = {(r["scenario"], r["fold"]): r["valid_score"] for r in run.cv.collect()}
    assert got.keys() == want.keys() and np.mean([abs(got[k] - want[k]) for k in got]) < 0.05
    assert run.predictions.count() == exact_run.predictions.count() and run.metrics.first()["balanced_accuracy"] > 0.6
    networks = runner.single(rows, CONFIG, SMALL[2:])
    assert {(r["scenario"], r["fold"]) for r in networks.cv.collect()} == want.keys() and networks.predictions.count() == exact_run.predictions.count()
