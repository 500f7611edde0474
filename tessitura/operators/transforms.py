"""Feature transforms fitted by aggregates: median imputation, standardization, ANOVA-F selection, class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that are never features.
METADATA = (
    "sample_id", "base", "filepath", "label", "speaker_id", "speaker_id_source", "recording_id", "sex", "age", "pathology", "pathology_code", "pathology_group",
    "pathology_groups", "vowel", "condition", "pitch", "sr", "duration", "file_sha256", "source_count", "is_consolidated_duplicate", "metadata_conflict_columns",
    "status", "error",
)
# Scenarios as column prefixes to include and exclude.
SCENARIOS = {
    "mfcc": (("mfcc",), ()),
    "harmonics": (("harmonic_",), ()),
    "energy_entropy_zcr": (("energy_area_", "entropy_c2_", "zcr_"), ()),
    "all_without_glottal": (("harmonic_", "energy_area_", "entropy_c2_", "zcr_", "mfcc"), ("glottal_",)),
    "glottal": (("glottal_",), ()),
    "all_with_glottal": (("harmonic_", "energy_area_", "entropy_c2_", "zcr_", "mfcc", "glottal_"), ()),
}


def numeric_features(rows: DataFrame, *more: str) -> list[str]:
    """Numeric columns that are no metadata, target or one of more."""
    out = {*METADATA, "target", *more}
    return [f.name for f in rows.schema if isinstance(f.dataType, T.NumericType) and f.name not in out]


def scenario_features(columns: Sequence[str], include: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    found = [c for c in columns if c.startswith(tuple(include)) and not (exclude and c.startswith(tuple(exclude)))]
    if not found:
        raise ValueError("the scenario has no feature")
    return found


def common_features(left: Sequence[str], right: Sequence[str]) -> list[str]:
    held = set(right)
    found = [c for c in left if c in held]
    if not found:
        raise ValueError("no common feature")
    return found


def feature_availability(left: DataFrame, right: DataFrame) -> DataFrame:
    """feature, in_left, in_right: full outer join of two small tables of names."""
    a = left.select(F.col("feature")).distinct().withColumn("in_left", F.lit(True))
    b = right.select(F.col("feature")).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, "feature", "full").select("feature", F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def medians(rows: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return rows.agg(*[F.median(c).alias(c) for c in columns]).first().asDict()


def imputed(rows: DataFrame, columns: Sequence[str], held: dict[str, float]) -> DataFrame:
    values = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(held[c])) for c in columns}
    return rows.select([values[c].alias(c) if c in values else F.col(c) for c in rows.columns])


def standard_score(c: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / population std; a constant gives 0."""
    return F.coalesce((c - mean) / F.nullif(std, F.lit(0.0)), F.lit(0.0))


def standardized(rows: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    stats = (rows if fit is None else fit).agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    values = {c: standard_score(F.col(c), F.lit(stats[c]["m"]), F.lit(stats[c]["s"])) for c in columns}
    return rows.select([values[c].alias(c) if c in values else F.col(c) for c in rows.columns])


def f_scores(long: DataFrame, feature: str = "feature", value: str = "value", target: str = "target") -> DataFrame:
    """feature, f: one-way ANOVA F of each feature from group sums; long: one row a feature and sample."""
    v = F.col(value).cast("double")
    by = long.groupBy(feature, target).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    all_ = by.groupBy(feature).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("k")
    )
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    return all_.select(feature, ((between / (F.col("k") - 1)) / F.nullif(within / (F.col("n") - F.col("k")), F.lit(0.0))).alias("f"))


def selected_percentile(scores: DataFrame, percentile: int, feature: str = "feature") -> DataFrame:
    """The features whose F is in the best percentile; ties by name."""
    n = F.count("*").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("f"), feature))
    return scores.withColumns({"place": place, "keep": F.greatest(F.lit(1), F.floor(n * percentile / 100))}).filter("place <= keep").select(feature, "f")


def fitted_long(rows: DataFrame, percentile: int, key: str = "vec_id") -> DataFrame:
    """key, feature, z: medians filled in, standardized, the best percentile of features by ANOVA F.

    rows: key, target, feature, x.  Every statistic is an aggregate by feature, so rows of any number do.
    """
    middle = rows.groupBy("feature").agg(F.median("x").alias("middle"))
    filled = rows.join(middle, "feature").withColumn("value", F.coalesce("x", "middle"))
    stats = filled.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    kept = selected_percentile(f_scores(filled), percentile).select("feature")
    return filled.join(stats, "feature").join(kept, "feature").select(key, "feature", standard_score(F.col("value"), F.col("mean"), F.col("std")).alias("z"))


def class_weights(rows: DataFrame, target: str = "target") -> DataFrame:
    """target, weight: n / (classes * n of the class), a row a class, for joining to many rows."""
    by = rows.groupBy(target).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # a row a class
    return by.select(target, (F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n"))).alias("weight"))
