"""Queries that SQL can't express: scans of files, signal features, estimators, runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..features import extract as X
from ..ml import cascade, linear, nested, network, search
from ..operators import splits as S
from ..operators import transforms as T
from ..plans import protocol, runner
from ..plans.settings import TrainingConfig
from ..sources import audio, sinks
from ..views import CV_DUCK, cv_results, signals, vectors
from .registry import query


def folded(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return v.join(S.group_folds(v, "group", "target", 3), "group")


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """Event series as signals at 1 kHz, long enough for spectra."""
    return signals(spark, d).select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("sample_id"), F.transform("x", lambda v: v.cast("float")).alias("signal"), F.lit(1000).alias("sr"))


@query()
def g01_preprocess(spark, d):
    return X.profile(spoken(spark, d), 1000)


@query()
def g05_resample(spark, d):
    return X.profile(spoken(spark, d), 2000)


@query()
def g14_harmonics(spark, d):
    f = X.extract(spoken(spark, d), 8000, families=("harmonic_",))
    return f.select("sample_id", "status", *[c for c in f.columns if c.startswith("harmonic_")])


@query()
def g15_mfcc(spark, d):
    f = X.extract(spoken(spark, d), 8000, families=("mfcc",))
    return f.select("sample_id", "status", *[c for c in f.columns if c.startswith("mfcc")])


@query()
def g16_voice_quality(spark, d):
    f = X.extract(spoken(spark, d), 8000, families=("glottal_",))
    return f.select("sample_id", "status", *[c for c in f.columns if c.startswith("glottal_")])


@query()
def g17_feature_rows(spark, d):
    return X.extract(spoken(spark, d), 8000)


@query("""SELECT CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, CASE WHEN bad THEN 'sample rate must be positive' END AS error, count(*) AS n
    FROM (SELECT DISTINCT user_id, md5('user_' || user_id) < '8' AS bad FROM events) GROUP BY 1, 2""")
def g18_fault_isolation(spark, d):
    bad = spoken(spark, d).withColumn("sr", F.when(F.md5("sample_id") < "8", 0).otherwise(F.col("sr")))
    return X.profile(bad, 1000).groupBy("status", "error").agg(F.count("*").alias("n"))


@query()
def m06_linear_svm(spark, d):
    """Four linear machines in each fold, fitted on rows that stay distributed."""
    rows = folded(spark, d).withColumn("parts", F.array("fold"))
    configs = search.configurations(spark, [(i, "svm_linear", p, c, None, None, None, None, None, 0, 0) for i, (p, c) in enumerate([(50, 0.1), (50, 1.0), (100, 0.1), (100, 1.0)])])
    units = configs.select(F.lit(0).alias("split"), F.lit("all").alias("scenario"), "candidate").crossJoin(rows.select("fold").distinct())  # the work itself
    return linear.fit_units(rows, units, configs).select("scenario", "candidate", "fold", "train_score", "valid_score")


@query()
def m07_kernel_svm(spark, d):
    return search.cross_validate(folded(spark, d), search.configurations(spark, [(0, "svm_rbf", 50, 1.0, "scale", None, None, None, None, 0, 0)]))


@query()
def m07_kernel_cascade(spark, d):
    """Two kernel machines in each fold by a cascade, rows dealt into parts of 512."""
    rows = folded(spark, d).withColumn("parts", F.array("fold"))
    configs = search.configurations(spark, [(i, "svm_rbf", 50, c, "scale", None, None, None, None, 0, 0) for i, c in enumerate([0.1, 1.0])])
    units = configs.select(F.lit(0).alias("split"), F.lit("all").alias("scenario"), "candidate").crossJoin(rows.select("fold").distinct())  # the work itself
    return cascade.fit_units(rows, units, configs, part_rows=512).select("scenario", "candidate", "fold", "train_score", "valid_score")


@query()
def m08_mlp(spark, d):
    return search.cross_validate(folded(spark, d), search.configurations(spark, [(0, "mlp", 50, None, None, [8], 0.001, 0.0, 10, 8, 1)]))


@query()
def m08_network_rounds(spark, d):
    """Two networks in each fold by rounds of averaged updates over shards."""
    rows = folded(spark, d).withColumn("parts", F.array("fold"))
    configs = search.configurations(spark, [(i, "mlp", 50, None, None, layers, 0.001, 0.0, 10, sum(layers), len(layers)) for i, layers in enumerate([[8], [16]])])
    units = configs.select(F.lit(0).alias("split"), F.lit("all").alias("scenario"), "candidate").crossJoin(rows.select("fold").distinct())  # the work itself
    return network.fit_units(rows, units, configs).select("scenario", "candidate", "fold", "train_score", "valid_score")


@query()
def m09_grid_search(spark, d):
    """All configurations of the default grid."""
    configs = search.configurations(spark)
    return search.results(search.cross_validate(folded(spark, d), configs), configs)


@query()
def m14_strict_evaluation(spark, d):
    held = S.group_holdout(vectors(spark, d), "group", "target", "target", 0.25)
    config = {"model": "svm_rbf", "percentile": 50, "c": 1.0, "gamma": "scale"}
    return search.fit_final(held.filter("partition = 'train'"), held.filter("partition = 'test'"), config)


@query()
def d01_learning_curve(spark, d):
    config = {"model": "svm_linear", "percentile": 50, "c": 0.1}
    return search.learning_points(folded(spark, d), config, (0.25, 0.5, 1.0))


@query()
def d02_epoch_history(spark, d):
    r = folded(spark, d)
    config = {"model": "mlp", "percentile": 50, "layers": [8], "epochs": 10, "alpha": 0.001}
    return search.epoch_history(r.filter("fold <> 0"), r.filter("fold = 0"), config)


@query()
def m13_distributed_scores(spark, d):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors(spark, d)
    model = search.distributed_svm(v, 0.1)
    out = model.transform(v.withColumn("vector", array_to_vector("x")))
    return out.select("vec_id", "target", F.col("prediction").cast("int").alias("y_pred"), vector_to_array("rawPrediction")[1].alias("y_score"))


@query("SELECT lang AS folder, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def s01_list_files(spark, d):
    """Files with one suffix below a folder that has others, and their bytes: texts in a folder for each language."""
    docs, at = spark.read.parquet(f"{d}/documents.parquet").filter("lang IS NOT NULL"), sinks.scratch(spark)
    docs.select("lang", "text").write.partitionBy("lang").text(at)
    docs.select("lang", "doc_id").write.mode("append").partitionBy("lang").parquet(at)
    found = audio.list_files(spark, at, "*.txt").withColumn("folder", F.regexp_extract("path", "/lang=([^/]+)/", 1))
    return found.groupBy("folder").agg(F.sum("length").alias("bytes"))


# ------------------------------------------------------------------ runs over feature rows

SMALL = [(0, "svm_linear", 50, 0.1, None, None, None, None, None, 0, 0), (1, "svm_rbf", 50, 1.0, "scale", None, None, None, None, 0, 0), (2, "mlp", 50, None, None, [8], 0.001, 0.0, 10, 8, 1)]
SETTINGS = TrainingConfig(cv_folds=3, bootstrap_iterations=100)


def feature_rows(spark: SparkSession, d: str, base: str | None = None) -> DataFrame:
    """Vectors as feature rows of two databases: half of the dimensions as one family, half as another."""
    v = vectors(spark, d)
    out = v.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("sample_id"),
        F.when(F.col("vec_id") % 2 == 0, "D1").otherwise("D2").alias("base"),
        F.col("group").cast("string").alias("speaker_id"),
        F.when(F.col("target") == 1, "pathological").otherwise("healthy").alias("label"),
        F.lit("ok").alias("status"),
        F.element_at(F.array(F.lit("a"), F.lit("i"), F.lit("u")), (F.col("vec_id") % 3 + 1).cast("int")).alias("vowel"),
        *[F.col("x")[i].alias(f"mfcc_{i + 1:02d}_mean" if i < 32 else f"harmonic_{i - 31:02d}_amp") for i in range(64)],
    )
    return out if base is None else out.filter(F.col("base") == base)


FEATURES = "SELECT unnest(range(1, 33)) AS i, 'mfcc' AS family UNION ALL SELECT unnest(range(1, 33)), 'harmonic'"
NAMED = f"SELECT family, CASE family WHEN 'mfcc' THEN printf('mfcc_%02d_mean', i) ELSE printf('harmonic_%02d_amp', i) END AS feature FROM ({FEATURES})"


@query(f"SELECT feature FROM ({NAMED})")
def p21_numeric_features(spark, d):
    return spark.createDataFrame([(c,) for c in T.numeric_features(feature_rows(spark, d))], "feature string")


@query(f"""SELECT unnest(['all_with_glottal', 'all_without_glottal']) AS scenario, feature FROM ({NAMED}) UNION ALL
    SELECT CASE family WHEN 'mfcc' THEN 'mfcc' ELSE 'harmonics' END, feature FROM ({NAMED})""")
def p22_scenarios(spark, d):
    return spark.createDataFrame([(n, c) for n, columns in runner.scenarios_of(feature_rows(spark, d)).items() for c in columns], "scenario string, feature string")


@query()
def o04_single_run(spark, d):
    return runner.single(feature_rows(spark, d), SETTINGS, SMALL).metrics


@query()
def o05_cross_run(spark, d):
    return runner.cross(feature_rows(spark, d, "D1"), feature_rows(spark, d, "D2"), SETTINGS, SMALL[:2], subgroup="vowel").metrics


@query()
def o06_pooled_run(spark, d):
    return runner.pooled(feature_rows(spark, d, "D1"), feature_rows(spark, d, "D2"), SETTINGS, SMALL[:2])[0].metrics


@query()
def x07_nested_search(spark, d):
    """Two repeats of three outer folds, the whole search of three configurations in two scenarios inside each."""
    rows = vectors(spark, d)
    n = len(rows.first()["x"])
    scenarios = {"all": list(range(n)), "half": list(range(n // 2))}
    configs = search.configurations(spark, SMALL)
    return nested.nested_search(rows, configs, scenarios, "vec_id", 3, 2, 3).results.select(
        "repeat", "outer_fold", "scenario", "model", "candidate", "n_outer_train_samples", "n_outer_validation_samples", "inner_score", "outer_train_balanced_accuracy", "balanced_accuracy", "roc_auc", "outer_gap"
    )


@query()
def m15_evaluate_all(spark, d):
    """Every scenario and model on the held-out groups."""
    return runner.evaluate_all(feature_rows(spark, d), SETTINGS, SMALL)


@query()
def d05_champion_report(spark, d):
    """The best configuration of each family by its cross-validation score."""
    out = runner.single(feature_rows(spark, d), SETTINGS, SMALL)
    return runner.champions(out.cv, search.configurations(spark, SMALL))


# ------------------------------------------------------------------ recordings made from series


def recordings(spark: SparkSession, d: str, suffix: str) -> DataFrame:
    """Series as files of the given format: path, relative_path, content; each tenth is broken."""

    def run(signals: pa.Array) -> pa.Array:
        encode = audio.encode_wav if suffix == "wav" else audio.encode_nsp
        return pa.array([encode(np.array(x, float) / max(1e-9, np.abs(x).max()), 16000) for x in signals.to_pylist()], pa.binary())

    s = signals(spark, d)
    content = F.when(F.col("user_id") % 10 == 0, F.lit(b"broken")).otherwise(F.arrow_udf(run, "binary")("x"))
    user = F.col("user_id").cast("string")
    if suffix == "wav":
        name = F.concat(F.when(F.col("user_id") % 2 == 0, "Normales/").otherwise("Patologicos/"), user, F.lit(".wav"))
    else:
        name = F.concat(F.when(F.col("user_id") % 2 == 0, "Gesund/").otherwise("Dysphonie/"), user, F.lit("/vowels/"), user, F.lit("-a_n.nsp"))
    return s.select(F.concat(F.lit("/data/"), name).alias("path"), name.alias("relative_path"), content.alias("content"))


#: The files in SQL: u, place (relative path), bad, n (samples).
WAVS = "SELECT CASE user_id % 2 WHEN 0 THEN 'Normales/' ELSE 'Patologicos/' END || user_id || '.wav' AS place, user_id AS u, user_id % 10 = 0 AS bad, count(*) AS n FROM events GROUP BY user_id"
NSPS = "SELECT CASE user_id % 2 WHEN 0 THEN 'Gesund/' ELSE 'Dysphonie/' END || user_id || '/vowels/' || user_id || '-a_n.nsp' AS place, user_id AS u, user_id % 10 = 0 AS bad, count(*) AS n FROM events GROUP BY user_id"
READ = "SELECT place AS relative_path, CASE WHEN NOT bad THEN 16000 END AS sr, CASE WHEN NOT bad THEN n END AS frames, CASE WHEN NOT bad THEN n END::INTEGER AS n, CASE WHEN bad THEN 'error' ELSE 'ok' END AS audio_read_status FROM ({})"
INDEXED = """place AS relative_path, TRUE AS hashed, CASE WHEN NOT bad THEN 1 END AS channels, CASE WHEN NOT bad THEN n END AS frames, CASE WHEN bad THEN 'error' ELSE 'ok' END AS audio_read_status, bad AS has_error,
    '/data/' || place AS filepath, 'a' AS vowel, CASE u % 2 WHEN 0 THEN 'healthy' ELSE 'pathological' END AS label, CASE WHEN NOT bad THEN round(n / 16000.0::DOUBLE, 9) END AS duration, CASE WHEN NOT bad THEN 16000 END AS samplerate"""


def indexed(rows: DataFrame, *more: str) -> DataFrame:
    hashed, error = F.length("file_sha256") == 64, F.col("audio_read_error").isNotNull()
    return rows.select(
        "relative_path", hashed.alias("hashed"), "channels", "frames", "audio_read_status", error.alias("has_error"), "filepath", "vowel", "label", F.round("duration", 9).alias("duration"), "samplerate", *more
    )


@query(f"""SELECT '/data/' || place AS path, CASE WHEN NOT bad THEN 16000 END AS sr, CASE WHEN NOT bad THEN 1 END AS channels, CASE WHEN NOT bad THEN n END AS frames,
    CASE WHEN NOT bad THEN n / 16000.0::DOUBLE END AS file_duration, CASE WHEN bad THEN 'AudioReadError: not a readable WAV file: ' END AS error FROM ({WAVS})""")
def s03_audio_summary(spark, d):
    return audio.summarized(audio.decoded(recordings(spark, d, "wav"), keep_signal=False))


@query(f"""SELECT '/data/' || place AS path, CASE WHEN NOT bad THEN 16000 END AS sr, CASE WHEN NOT bad THEN 1 END AS channels, CASE WHEN NOT bad THEN n END AS frames,
    CASE WHEN NOT bad THEN n / 16000.0::DOUBLE END AS file_duration, CASE WHEN bad THEN 'AudioReadError: not a readable WAV file: ' END AS error FROM ({WAVS})""")
def s03_header_summary(spark, d):
    """The same from files on disk, by the data source: headers alone are read."""
    at = sinks.scratch(spark)
    audio.write_files(recordings(spark, d, "wav"), at)
    rows = audio.audio_summary(spark, at)
    return rows.withColumn("path", F.concat(F.lit("/data/"), F.regexp_extract("path", "[^/]+/[^/]+$", 0)))


@query(READ.format(WAVS))
def s04_read_wav(spark, d):
    return audio.decoded(recordings(spark, d, "wav")).select("relative_path", "sr", "frames", F.size("signal").alias("n"), "audio_read_status")


@query(READ.format(NSPS))
def s05_read_nsp(spark, d):
    return audio.decoded(recordings(spark, d, "nsp")).select("relative_path", "sr", "frames", F.size("signal").alias("n"), "audio_read_status")


@query(f"""SELECT {INDEXED}, 'd1_' || CASE u % 2 WHEN 0 THEN 'normales_' ELSE 'patologicos_' END || u AS sample_id, 'D1' AS base, u || '.wav' AS filename, u::VARCHAR AS file_stem, u::VARCHAR AS file_key,
    CASE u % 2 WHEN 0 THEN 'Normales' ELSE 'Patologicos' END AS folder, NULL::VARCHAR AS pitch, 'd1_' || CASE u % 2 WHEN 0 THEN 'normales_' ELSE 'patologicos_' END || u AS speaker_id,
    'assumed_unique_acoustic_sample' AS speaker_id_source FROM ({WAVS})""")
def s08_index_by_path(spark, d):
    rows = audio.index_by_path(audio.decoded(recordings(spark, d, "wav"), keep_signal=False))
    return indexed(rows, "sample_id", "base", "filename", "file_stem", "file_key", "folder", "pitch", "speaker_id", "speaker_id_source")


@query(f"""SELECT {INDEXED}, 'd2_' || lower(g) || '_' || u || '_vowels_' || u || '_a_n' AS sample_id, 'D2' AS base, u::VARCHAR AS recording_id, 'n' AS "condition", 'n' AS pitch, g AS pathology_group,
    lower(g) AS pathology_group_key, TRUE AS recording_id_matches_folder FROM (SELECT *, CASE u % 2 WHEN 0 THEN 'Gesund' ELSE 'Dysphonie' END AS g FROM ({NSPS}))""")
def s09_index_by_recording(spark, d):
    rows = audio.index_by_recording(audio.decoded(recordings(spark, d, "nsp"), keep_signal=False))
    return indexed(rows, "sample_id", "base", "recording_id", "condition", "pitch", "pathology_group", "pathology_group_key", "recording_id_matches_folder")


@query()
def k07_protocol_hash(spark, d):
    content = protocol.protocol(SETTINGS, T.SCENARIOS, search.default_grid())
    return spark.createDataFrame([(protocol.digest(content), len(protocol.readable(content)))], "sha256 string, characters int")


@query(f"""WITH r AS (SELECT DISTINCT scenario, model, fold FROM ({CV_DUCK})) SELECT f.fold, m.scenario, m.model FROM (SELECT DISTINCT fold FROM r) f, (SELECT DISTINCT scenario, model FROM r) m
    WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.fold = f.fold AND r.scenario = m.scenario AND r.model = m.model AND NOT (r.scenario = 'scenario_1' AND r.fold = 2))""")
def c11_resume_contract(spark, d):
    """Folds of a checkpoint that are repeated, or missing from one scenario."""
    rows = cv_results(spark, d).select("scenario", "model", "fold").distinct()
    whole = rows.select("fold").distinct().crossJoin(rows.select("scenario", "model").distinct())  # folds x models
    return whole.join(rows.filter("NOT (scenario = 'scenario_1' AND fold = 2)"), ["scenario", "model", "fold"], "left_anti")


LONG = "SELECT vec_id, CAST(label < 5 AS INT) AS target, generate_subscripts(embedding, 1) AS feature, CAST(unnest(embedding) AS DOUBLE) AS raw FROM embeddings"
HOLES = f"SELECT vec_id, target, feature, CASE WHEN (vec_id + feature) % 11 > 0 THEN raw END AS x FROM ({LONG})"
FILLED = f"SELECT vec_id, target, feature, coalesce(x, median(x) OVER (PARTITION BY feature)) AS x FROM ({HOLES})"


@query(f"""WITH v AS ({FILLED}), s AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS d FROM v GROUP BY 1),
    f AS (SELECT feature, ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / nullif((sum(q) - sum(s * s / n)) / (sum(n) - count(*)), 0) AS f
      FROM (SELECT feature, target, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM v GROUP BY 1, 2) GROUP BY 1),
    k AS (SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY f DESC NULLS LAST, feature) AS rn, count(*) OVER () AS n FROM f) WHERE rn <= floor(n * 0.25))
    SELECT vec_id, feature, round(coalesce((x - m) / nullif(d, 0), 0), 5) AS z FROM v JOIN s USING (feature) JOIN k USING (feature)""")
def m01_pipeline(spark, d):
    """Imputed, standardized and selected features of each vector, in long form; a part of the values is missing."""
    v = vectors(spark, d).select("vec_id", "target", F.posexplode("x").alias("i", "raw")).withColumn("feature", (F.col("i") + 1).cast("long"))
    holes = v.select("vec_id", "target", "feature", F.when((F.col("vec_id") + F.col("feature")) % 11 > 0, F.col("raw")).alias("x"))
    return T.fitted_long(holes, 25).select("vec_id", "feature", F.round("z", 5).alias("z"))
