"""Writing tables, models and text of a run."""

from __future__ import annotations

import atexit
import json
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cohort import Cohort


_made: list[tuple[SparkSession, str]] = []


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@atexit.register
def _clean() -> None:
    """Remove what kept() wrote, when the driver ends."""
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone; the folder is the cluster's own to clean
            continue


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors reach: in spark.checkpoint.dir, or where that is unset a temporary one of this
    machine, which is an error if there are others."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = f"file://{tempfile.mkdtemp(prefix='tessitura-')}"
    return f"{held.rstrip('/')}/{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """The rows written and read again, so that what made them runs once."""
    at = scratch(rows.sparkSession)
    _made.append((rows.sparkSession, at))
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def dropped(rows: DataFrame) -> None:
    """Remove what kept() wrote, once nothing reads it any more."""
    for f in rows.inputFiles()[:1]:
        for spark, path in [m for m in _made if m[1].split("/")[-1] in f.split("/")]:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            _made.remove((spark, path))


def flat(rows: DataFrame) -> DataFrame:
    """Arrays and maps as JSON text, for formats without them."""
    return rows.select([F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in rows.schema])


def write_table(rows: DataFrame, path: str, csv: bool = True, by: tuple[str, ...] = ()) -> None:
    """Parquet, and CSV beside it."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}.parquet")
    if csv:
        flat(rows).write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_cohort(cohort: Cohort, folder: str) -> None:
    write_table(cohort.training, f"{folder}/training_manifest")
    for name in ("exclusions", "duplicates"):
        flat(getattr(cohort, name)).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    cohort.summary.write.mode("overwrite").json(f"{folder}/summary.json")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file, on any store Spark reaches."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    write_text(spark, json.dumps(value, indent=1, ensure_ascii=False, sort_keys=True), path)


def write_metrics(metrics: DataFrame, predictions: DataFrame, folder: str) -> None:
    """Metrics, and predictions in folders by scenario and model so that one pair is read alone."""
    write_table(metrics, f"{folder}/metrics")
    predictions.write.mode("overwrite").partitionBy("scenario", "model").parquet(f"{folder}/predictions")


def read_predictions(spark: SparkSession, folder: str, scenario: str, model: str) -> DataFrame | None:
    """The predictions of exactly this scenario and model, else of the first whose names contain them, else None."""
    rows = spark.read.parquet(f"{folder}/predictions")
    exact = rows.filter((F.col("scenario") == scenario) & (F.col("model") == model))
    if not exact.isEmpty():
        return exact
    like = rows.select("scenario", "model").distinct().filter(F.col("scenario").contains(scenario) & F.col("model").contains(model)).orderBy("scenario", "model").first()
    return rows.filter((F.col("scenario") == like[0]) & (F.col("model") == like[1])) if like else None


def write_model(spark: SparkSession, name: str, model: Any, protocol: str, folder: str) -> None:
    """A fitted model as a binary column, with the hash of its protocol."""
    spark.createDataFrame([(name, protocol, bytearray(pickle.dumps(model)))], "name string, protocol string, model binary").write.mode("overwrite").parquet(f"{folder}/{name}")


def read_model(spark: SparkSession, name: str, protocol: str, folder: str) -> Any:
    row = spark.read.parquet(f"{folder}/{name}").first()
    if row["protocol"] != protocol:
        raise ValueError(f"model {name} was fitted under another protocol")
    return pickle.loads(bytes(row["model"]))


def summary_lines(cohort: Cohort) -> Iterator[str]:
    """A readable summary from the one-row table."""
    for name, value in cohort.summary.first().asDict().items():
        if isinstance(value, dict):
            yield f"{name}:"
            yield from (f"  {k}: {v}" for k, v in sorted(value.items()))
        else:
            yield f"{name}: {value}"
