"""The supplied test tables seen as recordings, signals, features and predictions.

Each view comes twice: as a DataFrame, and as DuckDB SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One text for both engines: they agree on every function in it.
MANIFEST_COLUMNS = """
    concat('doc_', CAST(d.doc_id AS STRING)) AS sample_id,
    CASE WHEN d.doc_id % 2 = 0 THEN 'D1' ELSE 'D2' END AS base,
    concat(d.source, '/', CASE WHEN d.doc_id % 4 = 1 THEN 'Patológicos' WHEN d.doc_id % 4 = 2 THEN 'Normales' ELSE 'misc' END, '/', CAST(d.doc_id AS STRING), '-',
           CASE d.doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'i' WHEN 2 THEN 'u' ELSE 'x' END, '_', CASE WHEN d.doc_id % 5 = 0 THEN 'h' ELSE 'n' END, '.NSP') AS relative_path,
    CAST(d.doc_id % 700 AS STRING) AS recording_id,
    CASE WHEN d.doc_id % 97 = 0 THEN '  ' ELSE d.source END AS speaker_id,
    d.lang AS vowel,
    CASE WHEN d.doc_id % 5 = 0 THEN 'h' ELSE 'n' END AS "condition",
    CASE l.quality WHEN 0 THEN 'pathological' WHEN 1 THEN 'healthy' END AS label,
    CASE WHEN d.doc_id % 31 = 0 THEN NULL ELSE CAST(10 + d.doc_id % 70 AS DOUBLE) END AS age,
    d.n_chars / 1000.0e0 AS duration,
    CASE WHEN d.doc_id % 53 = 0 THEN 'error' WHEN d.doc_id % 3 = 0 THEN ' OK ' WHEN d.doc_id % 59 = 0 THEN NULL ELSE 'ok' END AS audio_read_status,
    CASE d.doc_id % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS sex,
    concat('Group ', CAST(d.doc_id % 7 AS STRING)) AS pathology_group,
    concat('group_', CAST(d.doc_id % 7 AS STRING)) AS pathology_group_key,
    CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE concat('Finding ', CAST(d.doc_id % 5 AS STRING)) END AS pathology,
    16000 + d.doc_id % 2 AS samplerate,
    l.toxic AS toxic,
    d.n_chars AS n_chars,
    d.doc_id AS doc_id"""

MANIFEST_SQL = f"SELECT {MANIFEST_COLUMNS.replace('AS STRING', 'AS VARCHAR')}, sha256(d.text) AS file_sha256 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw manifest: documents as recordings, labels as their metadata.  Only columns in use are read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sql = f"SELECT {MANIFEST_COLUMNS.replace(chr(34), chr(96))}, sha2(d.text, 256) AS file_sha256 FROM {{d}} d LEFT JOIN {{l}} l ON l.doc_id = d.doc_id"
    return spark.sql(sql, d=docs, l=labels)


CANDIDATES_SQL = f"SELECT * FROM ({MANIFEST_SQL}) WHERE label IS NOT NULL"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of the manifest."""
    return manifest(spark, sf_dir).filter(F.col("label").isNotNull())


SIGNAL_SQL = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS v FROM events"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and its values in order of time, as an array."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return rows.select("user_id", F.transform("s", lambda x: x["value"]).alias("x"))


VECTOR_SQL = "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v, label FROM embeddings"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, x (array), target, group: vectors as feature rows."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") < 5).cast("int").alias("target"), (F.col("vec_id") % 40).alias("group"))


PREDICTION_SQL = """SELECT l.doc_id, d.lang AS vowel, l.quality AS y_true, 1 - l.toxic AS y_pred, CAST(d.n_chars AS DOUBLE) AS y_score, d.source AS "group"
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, vowel, y_true, y_pred, y_score, group: labels as predictions."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return spark.sql(PREDICTION_SQL.replace(chr(34), chr(96)).replace("FROM labels", "FROM {l}").replace("JOIN documents", "JOIN {d}"), l=labels, d=docs)


#: A table of search results: made from part, one row a configuration.
CV_SQL = """
    SELECT p_partkey AS candidate, concat('scenario_', CAST(p_size % 3 AS STRING)) AS scenario,
           CASE p_partkey % 3 WHEN 0 THEN 'svm_linear' WHEN 1 THEN 'svm_rbf' ELSE 'mlp' END AS model,
           0.6e0 + CAST(p_partkey * 7919 % 997 AS DOUBLE) / 4096e0 AS mean_score, 0.01e0 + CAST(p_partkey * 31 % 64 AS DOUBLE) / 1024e0 AS std_score,
           CAST(p_partkey * 17 % 128 AS DOUBLE) / 1024e0 - 0.0625e0 AS gap,
           CASE p_partkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 25 WHEN 2 THEN 50 ELSE 100 END AS percentile,
           CASE p_size % 4 WHEN 0 THEN 0.01e0 WHEN 1 THEN 0.1e0 WHEN 2 THEN 1e0 ELSE 10e0 END AS c,
           CASE p_size % 5 WHEN 0 THEN 'scale' WHEN 1 THEN '0.0001' WHEN 2 THEN '0.001' WHEN 3 THEN '0.01' END AS gamma,
           p_size % 2 * 8 + 8 AS neurons, 1 + p_size % 2 AS depth, 5 * (1 + p_size % 6) AS epochs,
           CASE p_size % 2 WHEN 0 THEN 0.001e0 ELSE 0.01e0 END AS alpha, 0.1e0 * (p_size % 3) AS dropout, p_partkey % 5 AS fold, 100 + p_size AS n_features
    FROM part"""


def cv_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CV_SQL.replace("FROM part", "FROM {p}"), p=table(spark, sf_dir, "part"))


CV_DUCK = CV_SQL.replace("AS STRING", "AS VARCHAR")
