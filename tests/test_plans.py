import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.ml import estimators as M
from tessitura.ml import search
from tessitura.operators import cohort as C
from tessitura.plans import protocol as P
from tessitura.plans import runner as R
from tessitura.plans.settings import Dataset, Direction, Request, RunFolder, Stage, TrainingConfig, parse, slug
from tessitura.sources import sinks
from tessitura.streaming import counters

SMALL = [(0, "svm_linear", 50, 0.1, None, None, None, None, None, 0, 0), (1, "svm_rbf", 50, 1.0, "scale", None, None, None, None, 0, 0), (2, "mlp", 50, None, None, [8], 0.001, 0.0, 10, 8, 1)]


def features(spark, base="D1", speakers=24, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(speakers):
        for k in range(2):
            y = g % 2
            rows.append((f"{base}_{g}_{k}", base, f"sp{g}", "pathological" if y else "healthy", "ok", "aiu"[(g // 2 + k) % 3], float(30 + g), *(float(v) for v in rng.normal(y * 1.5, 1, 4)), float(rng.normal())))
    return spark.createDataFrame(rows, "sample_id string, base string, speaker_id string, label string, status string, vowel string, age double, mfcc_01_mean double, mfcc_02_mean double, mfcc_03_mean double, mfcc_04_mean double, zcr_total double")


CONFIG = TrainingConfig(cv_folds=3, bootstrap_iterations=50, test_size=0.25)


def test_svm_and_mlp_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (160, 2))
    y = ((x**2).sum(axis=1) > 1.4).astype(int)
    assert M.balanced_accuracy(y, M.SVM(10.0, "scale").fit(x, y).predict(x)) > 0.95
    line = (x[:, 0] > 0).astype(int)
    assert M.balanced_accuracy(line, M.SVM(1.0).fit(x, line).predict(x)) > 0.95
    a, b = (M.MLP((16,), epochs=60, rate=0.01, seed=3).fit(x, y) for _ in range(2))
    assert M.balanced_accuracy(y, a.predict(x)) > 0.9 and np.array_equal(a.probability(x), b.probability(x))
    with pytest.raises(ValueError):
        M.MLP(()).fit(x, y)
    with pytest.raises(ValueError):
        M.MLP((4,)).fit(x, np.ones(160, int))


def test_svm_meets_its_conditions():
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, (60, 3)), rng.integers(0, 2, 60)
    m = M.SVM(1.0, 0.5, tol=1e-6).fit(x, y)
    s, bound = np.where(y == 1, 1, -1), M.class_weights(y)
    margin = s * m.score(x)
    a = np.zeros(60)
    for v, w in zip(m.support, m.weight):
        a[np.flatnonzero((x == v).all(axis=1))[0]] = abs(w)
    free = (a > 1e-6) & (a < bound - 1e-6)
    assert np.allclose(margin[free], 1, atol=1e-3) and (margin[a < 1e-9] >= 1 - 1e-3).all() and (margin[a > bound - 1e-9] <= 1 + 1e-3).all() and abs(m.weight.sum()) < 1e-9


def test_default_grid():
    grid = search.default_grid()
    assert len(grid) == 120 and [sum(r[1] == m for r in grid) for m in ("svm_linear", "svm_rbf", "mlp")] == [12, 48, 60]


def test_single_run(spark):
    out = R.single(features(spark), CONFIG, SMALL)
    assert out.selected.count() == 1 and out.metrics.count() == 1
    assert out.predictions.count() >= 8 and out.metrics.first()["balanced_accuracy"] > 0.6
    assert out.cv.count() == 4 * 3 * 3  # four scenarios with features, three configurations, three folds


def test_resumed_search_fits_nothing_again(spark):
    rows = features(spark)
    first = R.single(rows, CONFIG, SMALL)
    again = R.train(R.modeling_rows(rows), CONFIG, R.scenarios_of(rows), SMALL, done=first.cv)
    assert sorted(map(tuple, again.cv.collect())) == sorted(map(tuple, first.cv.collect()))
    assert again.selected.first()["candidate"] == first.selected.first()["candidate"]


def test_cross_and_pooled_runs(spark):
    a, b = features(spark), features(spark, "D2", 16, 1).drop("zcr_total").withColumn("mfcc_99_mean", F.lit(1.0))
    out = R.cross(a, b, CONFIG, SMALL[:1], subgroup="vowel")
    assert out.predictions.count() == 32
    assert {r["evaluation_scope"] for r in out.metrics.collect()} == {"overall", "vowel:a", "vowel:i", "vowel:u", "vowel:macro"}
    flipped = b.withColumn("label", F.when(F.col("sample_id") == "D2_0_0", "pathological").otherwise(F.col("label")))
    trained, mixed = R.pooled(a, flipped, CONFIG, SMALL[:1])
    m = mixed.collect()
    assert [(r["pooled_group"], r["n_samples"]) for r in m] == [("D2::sp0", 2)]
    assert {r["evaluation_scope"] for r in trained.metrics.collect()} == {"overall", "base:D1", "base:D2", "base:macro"}


def test_request():
    r = parse(["--dataset", "d2", "--vowels", "u", "a", "--stage", "train"])
    assert r.vowels == ("a", "u") and r.stage is Stage.TRAIN and Stage.TRAIN >= Stage.FEATURES and r.name.startswith("d2_")
    for bad in ({"vowels": ()}, {"vowels": ("a", "a")}, {"vowels": ("x",)}, {"direction": Direction.FIRST_TO_SECOND}, {"resume": "x"}):
        with pytest.raises(ValueError):
            Request(Dataset.SECOND, **bad)
    assert Direction.BOTH.pairs() == (("d1", "d2"), ("d2", "d1")) and slug(" A b! ") == "a_b"


def test_training_config():
    for bad in ({"test_size": 1.0}, {"cv_folds": 1}, {"fractions": (0.5, 0.2)}, {"tolerance": -1}, {"positive_label": "healthy"}, {"nested_repeats": 0}):
        with pytest.raises(ValueError):
            TrainingConfig(**bad)


def test_protocol():
    a = P.protocol(TrainingConfig(), {"mfcc": ("mfcc",)}, SMALL)
    assert P.digest(a) == P.digest(P.protocol(TrainingConfig(), {"mfcc": ("mfcc",)}, SMALL)) != P.digest(P.protocol(TrainingConfig(seed=1), {"mfcc": ("mfcc",)}, SMALL))
    assert P.document(a, {"python": "x"})["sha256"] == P.document(a)["sha256"] and P.digest(a) in P.readable(a)
    with pytest.raises(ValueError):
        P.protocol(TrainingConfig(), {}, [], confirmatory=True, percentiles=(10,))
    with pytest.raises(ValueError, match="dataset"):
        P.check_resumed({"dataset": "d1"}, {"dataset": "d2"})


def test_sinks(spark, tmp_path):
    at = str(tmp_path)
    df = spark.createDataFrame([("s", "m", 1, 0.5)], "scenario string, model string, y_true int, y_score double")
    sinks.write_metrics(df, df, at)
    assert sinks.read_predictions(spark, at, "s", "m").count() == 1 and sinks.read_predictions(spark, at, "x", "m") is None
    sinks.write_model(spark, "a", M.SVM(2.0), "hash", at)
    assert sinks.read_model(spark, "a", "hash", at).c == 2.0
    with pytest.raises(ValueError):
        sinks.read_model(spark, "a", "other", at)
    sinks.write_json(spark, {"é": 1}, f"{at}/c.json")
    assert "é" in sinks.read_text(spark, f"{at}/c.json")


def test_whole_run_and_resume(spark, tmp_path):
    rng = np.random.default_rng(0)
    t = np.arange(3200) / 16000
    rows = [(f"s{i}", "D2", f"f{i}", str(i), f"p{i // 2}", "pathological" if i // 2 % 2 else "healthy", "a", "n", "G", "g", "x", "ok", 40.0, 1.0, f"h{i}", (0.3 * np.sin(2 * np.pi * (120 + 90 * (i // 2 % 2)) * t) + 0.01 * rng.normal(size=3200)).tolist(), 16000) for i in range(24)]
    schema = "sample_id string, base string, filepath string, recording_id string, speaker_id string, label string, vowel string, condition string, pathology_group string, pathology_group_key string, pathology string, audio_read_status string, age double, duration double, file_sha256 string, signal array<float>, sr int"
    manifest = spark.createDataFrame(rows, schema)
    out = R.run(spark, Request(Dataset.SECOND, Stage.FEATURES), {"d2": manifest}, str(tmp_path))
    folder: RunFolder = out["folder"]
    assert out["d2_features"].filter("status = 'ok'").count() == 24 and folder.reports.endswith("/reports")
    again = R.run(spark, Request(Dataset.SECOND, Stage.FEATURES, resume=folder.root), {"d2": manifest.limit(24)}, str(tmp_path))
    assert again["d2_features"].count() == 24
    with pytest.raises(ValueError, match="differs"):
        R.run(spark, Request(Dataset.SECOND, Stage.FEATURES, vowels=("i",), resume=folder.root), {"d2": manifest}, str(tmp_path))
    assert list(sinks.summary_lines(out["d2_cohort"]))


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ok", 1, 1, 0), (2, "bad", 0, 1, 0), (3, "ok", 1, 0, 0)], "id int, audio_read_status string, y_true int, y_pred int, epoch int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, mode):
        q = df.writeStream.format("memory").queryName(f"q_{mode}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(f"q_{mode}").collect()

    assert sum(r["exclusion_reason"] == "audio_read_error" for r in run(counters.audited_stream(stream, [C.audio_rule()]), "append")) == 1
    r = run(counters.confusion_counts(stream), "complete")[0]
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (0, 1, 1, 1) and abs(r["accuracy"] - 1 / 3) < 1e-9
