"""Tables behind reports: counts, crosstabs, descriptions, demographics, histograms, learning curves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def value_counts(rows: DataFrame, column: str, nulls: bool = True) -> DataFrame:
    held = rows if nulls else rows.filter(F.col(column).isNotNull())
    return held.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))


def shares(rows: DataFrame, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """Relative frequency of each value; the listed values that are absent get 0."""
    n = rows.groupBy(column).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).select(column, "share")
    if values is None:
        return n
    listed = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return listed.join(n, column, "left").select(column, F.coalesce("share", F.lit(0.0)).alias("share"))


def crosstab(rows: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return rows.groupBy(row).pivot(column, list(values)).count().fillna(0, subset=list(values))


def describe(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (sample), min, exact quartiles (linear), max."""
    c = F.col(column)
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), q.alias("q"), F.max(c).alias("most"))
    return out.select(*by, "n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "most")


def demographics(rows: DataFrame, database: str = "base") -> DataFrame:
    """Per database, for all rows and for each label: counts, speakers, ages, sexes."""
    age, sex = T.to_number(F.col("age")), F.lower(F.trim("sex"))
    both = rows.withColumn("cohort", F.explode(F.array(F.lit("all"), F.col("label")))).filter(F.col("cohort").isNotNull())
    return both.groupBy(F.col(database).alias("database"), F.col("cohort").alias("label")).agg(
        F.count("*").alias("n_samples"),
        F.count_distinct("speaker_id").alias("n_speakers"),
        F.count(age).alias("age_available"),
        F.count_if(age.isNull()).alias("age_missing"),
        F.avg(age).alias("age_mean"),
        F.stddev_samp(age).alias("age_std"),
        F.median(age).alias("age_median"),
        F.min(age).alias("age_min"),
        F.max(age).alias("age_max"),
        F.count_if(sex == "female").alias("female_samples"),
        F.count_if(sex == "male").alias("male_samples"),
        F.count_if(F.coalesce(~sex.isin("female", "male"), F.lit(True))).alias("sex_missing_or_other"),
    )


def pathology_distribution(rows: DataFrame, database: str = "base") -> DataFrame:
    return rows.groupBy(F.col(database).alias("database"), "label", F.coalesce("pathology", F.lit("missing")).alias("pathology_report")).agg(
        F.count("*").alias("n_samples"), F.count_distinct("speaker_id").alias("n_speakers")
    )


def mixed_groups(rows: DataFrame, group: str, positive: str = "pathological", negative: str = "healthy") -> DataFrame:
    """Groups with more than one label."""
    by = rows.groupBy(group).agg(
        F.count("*").alias("n_samples"),
        F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"),
        F.count_distinct("label").alias("n_labels"),
        F.count_if(F.col("label") == positive).alias(f"n_{positive}"),
        F.count_if(F.col("label") == negative).alias(f"n_{negative}"),
    )
    return by.filter("n_labels > 1").drop("n_labels")


def histogram(rows: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, n: equal widths from the least to the greatest value, the last bin closed."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    v = F.col(column)
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return rows.filter(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # ends has one row


def distinct_then_count(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """How many distinct combinations each value has."""
    return rows.select(by, *columns).distinct().groupBy(by).agg(F.count("*").alias("n"))


def top_k(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties in order of the value."""
    return value_counts(rows, column, nulls=False).limit(k)


def numbered(rows: DataFrame, first: str, *order: str | Column, name: str = "place") -> DataFrame:
    """Place (from 1) of each row in the total order of first and then order.

    Rows are numbered inside each value of first, and the values' counts give the offsets, so no task
    sees all rows; first should have many values, none of them with most of the rows.
    """
    counts = rows.groupBy(F.col(first).alias("value")).agg(F.count("*").alias("n"))
    before = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)  # a row a value
    offsets = counts.select("value", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(first).orderBy(*order))
    return rows.withColumn(name, inside).join(offsets, F.col(first).eqNullSafe(F.col("value"))).withColumn(name, F.col(name) + F.col("offset")).drop("value", "offset")


def learning_curve(points: DataFrame) -> DataFrame:
    """Per training fraction: mean sizes, mean and sample deviation of scores, mean gap."""
    return points.groupBy("train_fraction").agg(
        F.avg("n_train").alias("n_train_mean"),
        F.avg("train_score").alias("train_mean"),
        F.stddev_samp("train_score").alias("train_std"),
        F.avg("valid_score").alias("valid_mean"),
        F.stddev_samp("valid_score").alias("valid_std"),
        F.avg(F.col("train_score") - F.col("valid_score")).alias("gap_mean"),
    )


def metric_summary(rows: DataFrame, metrics: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """metric, mean, std, min, max, n over rows of wide metrics."""
    wide = rows.select(*key, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = wide.unpivot(list(key), list(metrics), "metric", "value") if key else wide.unpivot([], list(metrics), "metric", "value")
    return long.groupBy(*key, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"))


def selection_stability(rows: DataFrame, *key: str) -> DataFrame:
    """How often each key was selected, and its share."""
    by = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def file_report(files: DataFrame, path: Column | None = None) -> DataFrame:
    """extension, n and kind (audio, metadata, other) of a listing with a path column."""
    name = T.file_name(F.col("path") if path is None else path)
    extension = F.lower(F.regexp_extract(name, ".(\\.[^.]*)$", 1))
    kind = F.when(extension.isin(*AUDIO), "audio").when(extension.isin(*METADATA), "metadata").otherwise("other")
    return files.groupBy(extension.alias("extension"), kind.alias("kind")).agg(F.count("*").alias("n"))


# Suffixes of audio and metadata files.
AUDIO = (".wav", ".nsp")
METADATA = (".csv", ".tsv", ".xlsx", ".xls", ".json", ".txt")


# ------------------------------------------------------------------ whole reports

#: Statistics of describe() that a report lists.
STATISTICS = ("n", "mean", "least", "q25", "q50", "q75", "most")


def _key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in columns])


def _counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").cast("double").alias("value")).select(_key(*columns).alias("key"), "value")


def _statistics(rows: DataFrame, column: str, by: str) -> DataFrame:
    long = describe(rows, column, (by,)).select(by, *[F.col(c).cast("double").alias(c) for c in STATISTICS]).unpivot([by], list(STATISTICS), "statistic", "value")
    return long.filter(F.col("value").isNotNull()).select(_key(by, "statistic").alias("key"), "value")


def binned(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), bins: int = 30) -> DataFrame:
    """by, bin_<column> for each column, n: counts on a grid of equal widths; rows with a null in a column are left out.

    What a scatter plot shows, in as many rows as the grid has cells, however many points there are.
    """
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])

    def place(c: str) -> Column:
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return F.when(width > 0, F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / width * bins), F.lit(bins - 1))).otherwise(0).cast("long").alias(f"bin_{c}")

    held = rows.dropna(subset=list(columns)).crossJoin(F.broadcast(ends))  # ends has one row
    return held.groupBy(*by, *[place(c) for c in columns]).agg(F.count("*").alias("n"))


def _report(rows: DataFrame, plans: Sequence[tuple[str, set[str], Callable[[], DataFrame]]]) -> DataFrame:
    """report, key, value of those whose columns exist."""
    out = rows.sparkSession.createDataFrame([], "report string, key string, value double")
    for name, needed, make in plans:
        if needed <= set(rows.columns):
            out = out.unionByName(make().select(F.lit(name).alias("report"), "key", "value"))
    return out


def basic_report(rows: DataFrame, pathologies: int = 15, bins: int = 30) -> DataFrame:
    """report, key, value: the eight tables of a dataset, each made if its columns exist; parts of a key are joined by |.

    Classes, sexes, classes by sex, durations (bins), durations and ages by class (statistics), the most frequent
    pathologies, and age against duration by class (cells of a grid).
    """

    def cells() -> DataFrame:
        grid = binned(rows, ("age", "duration"), ("label",), bins)
        return grid.select(_key("label", "bin_age", "bin_duration").alias("key"), F.col("n").cast("double").alias("value"))

    return _report(
        rows,
        [
            ("class_distribution", {"label"}, lambda: _counts(rows, "label")),
            ("sex_distribution", {"sex"}, lambda: _counts(rows, "sex")),
            ("class_by_sex", {"sex", "label"}, lambda: _counts(rows, "label", "sex")),
            ("duration_distribution", {"duration"}, lambda: binned(rows, ("duration",), (), bins).select(_key("bin_duration").alias("key"), F.col("n").cast("double").alias("value"))),
            ("duration_by_class", {"duration", "label"}, lambda: _statistics(rows, "duration", "label")),
            ("age_by_class", {"age", "label"}, lambda: _statistics(rows, "age", "label")),
            ("top_pathologies", {"pathology"}, lambda: top_k(rows, "pathology", pathologies).select(_key("pathology").alias("key"), F.col("n").cast("double").alias("value"))),
            ("age_vs_duration_by_class", {"age", "duration", "label"}, cells),
        ],
    )


def session_report(rows: DataFrame, groups: int = 20) -> DataFrame:
    """The basic report and three more tables: vowels by condition, how many speakers have so many recordings, largest groups."""

    def recordings() -> DataFrame:
        by = rows.filter(F.col("speaker_id").isNotNull()).groupBy("speaker_id").agg(F.count_distinct("recording_id").alias("recordings"))
        return _counts(by, "recordings")

    more = [
        ("vowel_condition_coverage", {"vowel", "condition"}, lambda: _counts(rows, "vowel", "condition")),
        ("recordings_per_speaker", {"speaker_id", "recording_id"}, recordings),
        ("top_pathology_groups", {"pathology_group"}, lambda: top_k(rows, "pathology_group", groups).select(_key("pathology_group").alias("key"), F.col("n").cast("double").alias("value"))),
    ]
    return basic_report(rows).unionByName(_report(rows, more))
