import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import text
from tessitura.operators import metrics as E
from tessitura.operators import reports as R
from tessitura.operators import selection as Z
from tessitura.operators import splits as S
from tessitura.operators import transforms as X


def test_selection_case(spark):
    rows = [(0, "g", 0.800, 0.050, 10.0, 50), (1, "g", 0.799, 0.040, 0.1, 25), (2, "g", 0.750, 0.010, 0.01, 10)]
    df = spark.createDataFrame(rows, "candidate int, grid string, mean_score double, std_score double, c double, percentile int")
    out = Z.select_grid(df, ("grid",), 5, 0.005).first()
    assert (out["selected"], out["numerical_best"], out["eligible"]) == (1, 0, 2)
    assert math.isclose(out["standard_error"], 0.05 / math.sqrt(5)) and math.isclose(out["threshold"], 0.8 - 0.05 / math.sqrt(5))


def test_named_gamma_is_most_complex(spark):
    df = spark.createDataFrame([(0, "g", 0.8, 0.1, "scale"), (1, "g", 0.8, 0.1, "0.01"), (2, "g", float("nan"), 0.1, "0.001")], "candidate int, grid string, mean_score double, std_score double, gamma string")
    assert Z.select_grid(df, ("grid",)).first()["selected"] == 1


def test_global_choice_falls_back(spark):
    rows = [(0, 0.70, 0.9, 0.0, 0.05, 0.1, 50, 100), (1, 0.72, 0.8, 0.0, 0.01, 0.1, 50, 100)]
    df = spark.createDataFrame(rows, "candidate int, mean_score double, best_score double, standard_error double, std_score double, gap double, percentile int, n_features int")
    out = Z.select_source(df).first()
    assert out["selected"] == 0 and out["eligible"] == 0


def scores(y, s, p=None):
    return [(int(a), int(b > 0.5 if p is None else c), float(b), i % 5) for i, (a, b, c) in enumerate(zip(y, s, p if p is not None else s))]


SCHEMA = "y_true int, y_pred int, y_score double, group int"


def test_metrics_against_definitions(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    out = E.evaluate(spark.createDataFrame(scores(y, s), SCHEMA)).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, recall = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        held = s >= t
        r, p = (held & (y == 1)).sum() / (y == 1).sum(), (held & (y == 1)).sum() / held.sum()
        ap, recall = ap + (r - recall) * p, r
    assert math.isclose(out["roc_auc"], auc) and math.isclose(out["average_precision"], ap)
    tp, tn, fp, fn = (out[k] for k in ("tp", "tn", "fp", "fn"))
    assert tp + tn + fp + fn == 200 and math.isclose(out["balanced_accuracy"], (tp / (tp + fn) + tn / (tn + fp)) / 2)


def test_one_class(spark):
    out = E.evaluate(spark.createDataFrame([(1, 1, 0.9, 0), (1, 0, 0.1, 1)], SCHEMA)).first()
    assert out["specificity"] is None and out["roc_auc"] is None and out["balanced_accuracy"] == 0.5 and out["uar"] == 0.25 and out["mcc"] == 0


def test_bootstrap_of_perfect_predictions(spark):
    rows = [(i % 2, i % 2, float(i % 2), i // 2) for i in range(20)]
    out = {r["metric"]: r for r in E.bootstrap(spark.createDataFrame(rows, SCHEMA), "group", 100).collect()}
    assert (out["balanced_accuracy"]["ci_lower"], out["balanced_accuracy"]["ci_upper"]) == (1.0, 1.0) and out["balanced_accuracy"]["valid_iterations"] > 0


def test_scopes(spark):
    rows = [(*r, "aiu"[i % 3]) for i, r in enumerate(scores([0, 1, 1, 0, 1, 0], [0.1, 0.9, 0.8, 0.7, 0.2, 0.3]))]
    out = {r["evaluation_scope"]: r for r in E.evaluate_scopes(spark.createDataFrame(rows, SCHEMA + ", vowel string"), "vowel").collect()}
    assert set(out) == {"overall", "vowel:a", "vowel:i", "vowel:u", "vowel:macro"}
    assert out["vowel:macro"]["tp"] is None and math.isclose(out["vowel:macro"]["accuracy"], np.mean([out[f"vowel:{v}"]["accuracy"] for v in "aiu"]))


@pytest.fixture
def grouped(spark):
    return spark.createDataFrame([(f"s{g}_{k}", f"g{g:02d}", "pathological" if g % 2 else "healthy", g % 2) for g in range(40) for k in range(2)], "sample_id string, speaker string, label string, target int")


def test_group_holdout(grouped):
    out = S.group_holdout(grouped, "speaker", "label", "target", 0.25)
    S.check_split(out, "speaker", "label", "target")
    n = {r["partition"]: r["count"] for r in out.groupBy("partition").count().collect()}
    assert n["train"] + n["test"] == 80 and 12 <= n["test"] <= 28
    assert sorted(out.collect()) == sorted(S.group_holdout(grouped, "speaker", "label", "target", 0.25).collect())


def test_folds_keep_groups_whole(grouped):
    out = S.with_folds(grouped, "speaker", "label", 4)
    assert out.groupBy("speaker").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    assert out.groupBy("fold").agg(F.count_distinct("label").alias("n")).filter("n < 2").isEmpty() and out.select("fold").distinct().count() == 4
    with pytest.raises(ValueError):
        S.group_folds(grouped, "speaker", "label", 1)


def test_subsample_keeps_strata(spark):
    groups = ["mixed-a", "mixed-b", "healthy-a", "healthy-b", "pathological-a", "pathological-b"]
    rows = [(g, s) for g in groups for s in ((0, 1) if g.startswith("mixed") else (0,) if g.startswith("healthy") else (1,))]
    df = spark.createDataFrame(rows, "g string, stratum int")
    out = S.group_subsample(df, "g", "stratum", 0.5)
    assert out.select("g").distinct().count() == 3 and out.select("stratum").distinct().count() == 2
    assert out.groupBy("g").count().join(df.groupBy("g").count(), ["g", "count"]).count() == 3
    assert S.group_subsample(df, "g", "stratum", 1.0).count() == len(rows)


def test_demographics(spark):
    rows = [("D1", "s1", "healthy", 20.0, "female", None), ("D1", "s2", "healthy", 30.0, "male", None), ("D1", "s3", "healthy", 40.0, None, None)]
    out = {r["label"]: r for r in R.demographics(spark.createDataFrame(rows, "base string, speaker_id string, label string, age double, sex string, pathology string")).collect()}
    assert set(out) == {"all", "healthy"}
    r = out["all"]
    assert (r["n_samples"], r["age_median"], r["female_samples"], r["male_samples"], r["sex_missing_or_other"]) == (3, 30.0, 1, 1, 1)


def test_transforms(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (4.0, 5.0), (7.0, 5.0)], "a double, b double")
    held = X.medians(df, ["a", "b"])
    assert held == {"a": 4.0, "b": 5.0}
    z = X.standardized(X.imputed(df, ["a", "b"], held), ["a", "b"]).collect()
    assert all(r["b"] == 0 for r in z) and math.isclose(sum(r["a"] ** 2 for r in z), 4)
    with pytest.raises(ValueError):
        X.common_features(["a"], ["b"])
    assert X.scenario_features(["mfcc_1", "zcr_1", "glottal_x"], ("mfcc", "zcr_")) == ["mfcc_1", "zcr_1"]
    assert X.numeric_features(spark.createDataFrame([(1, 2.0, "x", 3.0)], "age int, mfcc_1 double, label string, target double")) == ["mfcc_1"]
    assert {r["target"]: r["weight"] for r in X.class_weights(spark.createDataFrame([(0,), (0,), (0,), (1,)], "target int")).collect()} == {0: 4 / 6, 1: 2.0}


def test_top_k_and_shares(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "x string")
    assert [tuple(r) for r in R.top_k(df, "x", 1).collect()] == [("b", 2)]
    assert {r["x"]: r["share"] for r in R.shares(df, "x", ("a", "z")).collect()} == {"a": 0.25, "z": 0.0}
    assert [(r["bin"], r["n"]) for r in R.histogram(spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "v double"), "v", 3).orderBy("bin").collect()] == [(0, 1), (1, 1), (2, 1)]


def test_normalization_folds_compatibility_forms_and_white_space(spark):
    rows = [("ﬁn",), ("Ａb",), ("½x",), ("Ünï ﬂ\u00a0",), ("\t a \n",), ("①Ⅷ",), ("…",), (None,), ("𝔘x ㎏",), ("漢",)]
    df = spark.createDataFrame(rows, "v string")
    got = [r[0] for r in df.select(text.normalize_text(F.col("v"))).collect()]
    assert got == ["fin", "ab", "1_2x", "uni_fl", "a", "1viii", "", "", "ux_kg", ""]
    ids = spark.createDataFrame([("12.0\n",), ("\u00a07.0\t",), (" x ",)], "v string").select(text.normalize_recording_id(F.col("v"))).collect()
    assert [r[0] for r in ids] == ["12", "7", "x"]
    assert [r[0] for r in spark.createDataFrame([("\t",), ("\u2003",), ("a",), (None,)], "v string").select(text.missing(F.col("v"))).collect()] == [True, True, False, True]


def test_bootstrap_has_intervals_of_ranks_and_needs_groups(spark):
    rows = [(i % 2, i % 2, 0.9 if i % 2 else 0.1, f"g{i // 2}") for i in range(20)]
    df = spark.createDataFrame(rows, "y_true int, y_pred int, y_score double, group string")
    out = {r["metric"]: r for r in E.bootstrap(df, iterations=50).collect()}
    assert set(out) == set(E.MACRO)
    assert all((out[m]["ci_lower"], out[m]["ci_upper"]) == (1.0, 1.0) and out[m]["valid_iterations"] > 0 for m in ("balanced_accuracy", "roc_auc", "average_precision"))
    assert E.bootstrap(df.withColumn("group", F.lit("one")), iterations=50).count() == 0
