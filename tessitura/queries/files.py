"""Queries that write and read again: sheets, configurations, manifests, metrics, models, summaries, runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml import search
from ..operators import cohort as C
from ..operators import metrics as E
from ..plans import runner
from ..plans.settings import Dataset, Request, RunFolder, Stage, TrainingConfig, parse
from ..sources import metadata, sinks
from ..views import MANIFEST_SQL, PREDICTION_SQL, manifest, predictions, table, vectors
from .models import BY_VOWEL, div
from .registry import query, r6

M, P = f"({MANIFEST_SQL}) m", f"({PREDICTION_SQL}) p"


def values(rows: list[tuple], *names: str) -> str:
    """SQL of a table of constants."""
    literal = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({', '.join(names)})"


# ------------------------------------------------------------------ sources


@query("""SELECT 'Supplier ' || s_suppkey || '.wav' AS metadata_filename, 'supplier_' || s_suppkey AS metadata_file_key, CASE WHEN s_suppkey % 7 > 0 THEN (s_suppkey % 90)::DOUBLE END AS age,
    CASE s_suppkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'x' END AS sex, 'healthy' AS label FROM supplier""")
def s10_read_sheet(spark, d):
    """The export of a sheet, with its own column names, numbers that are none and codes in both cases."""
    key = F.col("s_suppkey")
    sheet = table(spark, d, "supplier").select(
        F.concat(F.lit("Supplier "), key.cast("string"), F.lit(".wav")).alias("Archivo"),
        F.when(key % 7 == 0, "n/a").otherwise((key % 90).cast("string")).alias("edad"),
        F.when(key % 3 == 0, " h ").when(key % 3 == 1, "M").otherwise("x").alias("sexo"),
    )
    at = f"{sinks.scratch(spark)}/sheet.csv"
    sheet.write.option("header", True).csv(at)
    return metadata.read_sheet(spark, at, "healthy").select("metadata_filename", "metadata_file_key", "age", "sex", "label")


SETTINGS = {"dataset": "d1", "vowels": ["a", "i"], "seed": 42, "strict": True, "name": "tést"}


@query(values([("dataset", "d1"), ("vowels", '["a","i"]'), ("seed", "42"), ("strict", "true"), ("name", "tést")], "key", "value"))
def s14_json_config(spark, d):
    at = f"{sinks.scratch(spark)}/config.json"
    sinks.write_json(spark, SETTINGS, at)
    return metadata.read_config(spark, at)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).withColumns({"scenario": F.concat(F.lit("mfcc_"), "vowel"), "model": F.when(F.col("doc_id") % 2 == 0, "svm_rbf").otherwise("mlp")})


@query(f"SELECT doc_id, y_true, y_pred, 'exact' AS way FROM {P} WHERE vowel = 'en' AND doc_id % 2 = 0 UNION ALL SELECT doc_id, y_true, y_pred, 'contained' FROM {P} WHERE vowel = 'fr' AND doc_id % 2 = 1")
def s15_prediction_lookup(spark, d):
    folder = sinks.scratch(spark)
    rows = scored(spark, d)
    sinks.write_metrics(E.evaluate(rows), rows, folder)
    ways = (("exact", "mfcc_en", "svm_rbf"), ("contained", "fr", "mlp"))
    found = [sinks.read_predictions(spark, folder, s, m).select("doc_id", "y_true", "y_pred", F.lit(way).alias("way")) for way, s, m in ways]
    return found[0].unionByName(found[1])


# ------------------------------------------------------------------ sinks


def cohort(spark: SparkSession, d: str) -> C.Cohort:
    """Rows with a label train; the others are excluded."""
    rows = manifest(spark, d).withColumn("exclusion_reason", F.when(F.col("label").isNull(), "missing_label"))
    kept = rows.filter(F.col("label").isNotNull()).drop("exclusion_reason").withColumn("source_count", F.lit(1))
    copies = kept.filter("doc_id % 10 = 0").select("sample_id", F.col("sample_id").alias("canonical_sample_id"))
    return C.Cohort(kept, rows.filter(F.col("label").isNull()), copies, C.summary(rows, kept, copies))


@query(f"""SELECT 'training.parquet' AS file, label AS name, count(*) AS n FROM {M} WHERE label IS NOT NULL GROUP BY 2 UNION ALL SELECT 'training.csv', label, count(*) FROM {M} WHERE label IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'exclusions.csv', 'missing_label', count(*) FROM {M} WHERE label IS NULL UNION ALL SELECT 'duplicates.csv', 'copies', count(*) FROM {M} WHERE label IS NOT NULL AND doc_id % 10 = 0""")
def k01_cohort_files(spark, d):
    folder = sinks.scratch(spark)
    sinks.write_cohort(cohort(spark, d), folder)
    csv = spark.read.option("header", True)
    parts = (
        ("training.parquet", spark.read.parquet(f"{folder}/training_manifest.parquet"), F.col("label")),
        ("training.csv", csv.csv(f"{folder}/training_manifest.csv"), F.col("label")),
        ("exclusions.csv", csv.csv(f"{folder}/exclusions.csv"), F.col("exclusion_reason")),
        ("duplicates.csv", csv.csv(f"{folder}/duplicates.csv"), F.lit("copies")),
    )
    out = None
    for file, rows, name in parts:
        one = rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(file).alias("file"), "name", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT format, base, count(*) AS n, sum(doc_id)::BIGINT AS ids, count(label) AS labels FROM {M} CROSS JOIN (VALUES ('csv'), ('parquet')) f(format) GROUP BY 1, 2")
def k02_table_files(spark, d):
    """The raw manifest as Parquet and as CSV; a list goes to CSV as JSON."""
    at = f"{sinks.scratch(spark)}/raw_manifest"
    sinks.write_table(manifest(spark, d).withColumn("both", F.array("base", "sample_id")), at)
    plain = spark.read.parquet(f"{at}.parquet").select(F.lit("parquet").alias("format"), F.col("both")[0].alias("base"), "doc_id", "label")
    text = spark.read.option("header", True).csv(f"{at}.csv")
    text = text.select(F.lit("csv").alias("format"), F.from_json("both", "array<string>")[0].alias("base"), F.col("doc_id").cast("long"), "label")
    return plain.unionByName(text).groupBy("format", "base").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.count("label").alias("labels"))


@query(f"SELECT vowel, round({div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, tp FROM ({BY_VOWEL})")
def k03_metric_files(spark, d):
    folder, rows = sinks.scratch(spark), scored(spark, d)
    sinks.write_metrics(E.evaluate(rows, ("vowel",)), rows, folder)
    return spark.read.parquet(f"{folder}/metrics.parquet").select("vowel", r6("accuracy").alias("accuracy"), "tp")


@query(values([("same protocol", "0.25"), ("other protocol", "model svm was fitted under another protocol")], "step", "result"))
def k04_model_files(spark, d):
    folder = sinks.scratch(spark)
    sinks.write_model(spark, "svm", {"weight": 0.25}, "p1", folder)
    rows = [("same protocol", str(sinks.read_model(spark, "svm", "p1", folder)["weight"]))]
    try:
        sinks.read_model(spark, "svm", "p2", folder)
    except ValueError as refused:
        rows.append(("other protocol", str(refused)))
    return spark.createDataFrame(rows, "step string, result string")


@query(f"""WITH m AS ({MANIFEST_SQL}), l AS (SELECT label, count(*) AS n FROM m WHERE label IS NOT NULL GROUP BY 1)
    SELECT unnest(['input_rows: ' || count(*), 'excluded_rows: ' || count_if(label IS NULL), 'candidate_rows: ' || count(label), 'training_rows: ' || count(label), 'exclusions_by_reason:',
      '  missing_label: ' || count_if(label IS NULL), 'unique_speakers: ' || count(DISTINCT CASE WHEN label IS NOT NULL THEN speaker_id END), 'collapsed_rows: 0', 'class_distribution:',
      'duplicate_groups: ' || count_if(label IS NOT NULL AND doc_id % 10 = 0), 'duplicate_rows: ' || count_if(label IS NOT NULL AND doc_id % 10 = 0)]) AS line FROM m
    UNION ALL SELECT '  ' || label || ': ' || n FROM l""")
def k05_summary_text(spark, d):
    at = f"{sinks.scratch(spark)}/summary.txt"
    sinks.write_text(spark, "\n".join(sinks.summary_lines(cohort(spark, d))), at)
    return spark.read.text(at).select(F.col("value").alias("line"))


FOLDER = "/data/D_1/experiments/20240102_030405_d_1_my_run"


@query(values([("root", FOLDER), ("config", f"{FOLDER}/config.json")] + [(x, f"{FOLDER}/{x}") for x in ("manifests", "profiles", "features", "figures", "reports")], "part", "path"))
def k06_run_folder(spark, d):
    folder = RunFolder.create("/data/", "D 1", "My run!", datetime(2024, 1, 2, 3, 4, 5))
    return spark.createDataFrame([("root", folder.root), ("config", folder.config), *((x, getattr(folder, x)) for x in folder.parts)], "part string, path string")


# ------------------------------------------------------------------ settings, requests, runs

BAD = {
    "protocol_version": (" ", "protocol_version is blank"), "negative_label": ("pathological", "labels must differ"), "test_size": (1.0, "test_size must lie between 0 and 1"),
    "cv_folds": (1, "cv_folds must be at least 2"), "tolerance": (-1.0, "tolerance must not be negative"), "bootstrap_iterations": (-1, "bootstrap_iterations must not be negative"),
    "confidence": (0.0, "confidence must lie between 0 and 1"), "nested_folds": (1, "nested_folds must be at least 2"), "nested_repeats": (0, "nested_repeats must be at least 1"),
    "fractions": ((0.5, 0.2), "fractions must be sorted and unique"),
}


@query(values([(k, m) for k, (_, m) in BAD.items()] + [("none", "valid")], "setting", "result"))
def c12_settings(spark, d):
    """What each wrong setting is refused with."""
    rows = [("none", "valid")] if TrainingConfig() else []
    for name, (value, _) in BAD.items():
        try:
            TrainingConfig(**{name: value})
        except ValueError as refused:
            rows.append((name, str(refused)))
    return spark.createDataFrame(rows, "setting string, result string")


@query("SELECT count(*) AS n, max(len(embedding)) AS features, count_if(label < 5) AS positive, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 3) AS total FROM embeddings")
def m05_host_matrix(spark, d):
    """The matrix that estimators take, after a check of its size."""
    held = search.matrix(vectors(spark, d), "x", "target")
    total = round(float(sum(sum(x) for x in held["x"])), 3)
    return spark.createDataFrame([(len(held), len(held["x"][0]), int(held["target"].sum()), total)], "n bigint, features bigint, positive bigint, total double")


@query(values([("pooled", "TRAIN", "run", "a,u", "both"), ("cross", "PREPARE", "cross_pre16k_rms20_fullsignal_features_v1", "a", "d2_to_d1")], "dataset", "stage", "name", "vowels", "direction"))
def o01_request(spark, d):
    given = (["--dataset", "pooled", "--stage", "train", "--vowels", "u", "a", "--experiment-name", "run"], ["--dataset", "cross", "--direction", "d2_to_d1"])
    rows = [(r.dataset.value, r.stage.name, r.name, ",".join(r.vowels), r.direction.value) for r in map(parse, given)]
    return spark.createDataFrame(rows, "dataset string, stage string, name string, vowels string, direction string")


@query(f"""SELECT count(*) AS input_rows, count_if(reason = 'kept') AS training_rows FROM (SELECT CASE WHEN NOT coalesce(lower(trim(audio_read_status)) = 'ok', false) THEN 'audio_read_error' WHEN label IS NULL THEN 'missing_label'
    WHEN trim(speaker_id) = '' THEN 'missing_speaker_id' WHEN age IS NULL THEN 'missing_age' WHEN age < 18 THEN 'age_below_minimum' WHEN duration < 0.5 THEN 'duration_below_minimum' ELSE 'kept' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY file_sha256 ORDER BY doc_id) AS rn FROM {M}) WHERE rn = 1)""")
def o02_prepared_run(spark, d):
    """A whole run up to its first stage; the manifests that it wrote are read again."""
    rows = C.first_of(manifest(spark, d), ("file_sha256",), ("doc_id",))
    rows = rows.withColumns({"filepath": F.col("relative_path"), "audio_read_error": F.lit(None).cast("string")})
    out = runner.run(spark, Request(Dataset.FIRST, Stage.PREPARE), {"d1": rows}, sinks.scratch(spark))
    folder = out["folder"]
    raw = spark.read.parquet(f"{folder.manifests}/raw_manifest.parquet").agg(F.count("*").alias("input_rows"))
    return raw.crossJoin(spark.read.parquet(f"{folder.manifests}/training_manifest.parquet").agg(F.count("*").alias("training_rows")))  # one row each


@query(values([("prepare", True, False, False), ("features", True, True, False), ("train", True, True, True)], "last", "prepares", "extracts", "trains"))
def o03_stages(spark, d):
    rows = [(s.name.lower(), *(s >= t for t in Stage)) for s in map(Stage.named, ("prepare", "features", "train"))]
    return spark.createDataFrame(rows, "last string, prepares boolean, extracts boolean, trains boolean")


@query(f"""SELECT y_score, round(fp / sum(neg) OVER (), 6) AS fpr, round(tp / sum(pos) OVER (), 6) AS tpr, round(tp / (tp + fp), 6) AS precision
    FROM (SELECT *, (sum(pos) OVER w)::DOUBLE AS tp, (sum(neg) OVER w)::DOUBLE AS fp FROM (SELECT y_score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM {P} GROUP BY 1) WINDOW w AS (ORDER BY y_score DESC))""")
def d06_curves(spark, d):
    """What the curve figures show, as tables."""
    return E.curves(predictions(spark, d)).select("y_score", *[r6(c).alias(c) for c in ("fpr", "tpr", "precision")])
