"""Audited cohorts: ordered exclusion rules, duplicate consolidation, integrity constraints, summaries.

A rule cascade is one expression, so excluding needs no join and no shuffle; the first rule that
holds names the reason, which equals applying the rules one after another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


class CohortError(ValueError):
    """An integrity constraint doesn't hold."""


@dataclass(frozen=True)
class CohortConfig:
    """Which recordings enter a cohort."""

    minimum_age: float | None = 18.0
    minimum_duration: float | None = 0.5
    exclude_missing_labels: bool = True
    exclude_missing_speakers: bool = True
    vowels: Sequence[str] | None = None
    conditions: Sequence[str] | None = None
    adults_only: bool = True
    prefix: str = "d2"

    def __post_init__(self):
        if self.minimum_age is not None and self.minimum_age < 0:
            raise ValueError("minimum_age must not be negative")
        if self.minimum_duration is not None and self.minimum_duration < 0:
            raise ValueError("minimum_duration must not be negative")
        if self.vowels is not None and not self.vowels:
            raise ValueError("vowels must not be empty")


@dataclass(frozen=True)
class Rule:
    """Rows for which excluded is true (null counts as false) leave for this reason."""

    reason: str
    excluded: Column
    detail: Column = field(default_factory=lambda: F.lit(None).cast("string"))


def audio_rule() -> Rule:
    ok = F.coalesce(F.lower(F.trim(F.col("audio_read_status"))) == "ok", F.lit(False))
    return Rule("audio_read_error", ~ok, T.observed("audio_read_status", F.col("audio_read_status")))


def member_rule(column: str, values: Sequence[str]) -> Rule:
    inside = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return Rule(f"{column}_not_selected", ~inside, T.observed(column, F.col(column)))


def missing_rule(column: str) -> Rule:
    return Rule(f"missing_{column}", T.missing(F.col(column)), T.observed(column, F.col(column)))


def least_rules(column: str, least: float) -> list[Rule]:
    n = T.to_number(F.col(column))
    return [Rule(f"missing_{column}", n.isNull(), T.observed(column, F.col(column))), Rule(f"{column}_below_minimum", n < least, T.below(column, n, least))]


def rules(config: CohortConfig) -> list[Rule]:
    """Audio, vowel, condition, label, speaker, age, duration, in this order."""
    out = [audio_rule()]
    if config.vowels is not None:
        out.append(member_rule("vowel", config.vowels))
    if config.conditions is not None:
        out.append(member_rule("condition", config.conditions))
    if config.exclude_missing_labels:
        out.append(missing_rule("label"))
    if config.exclude_missing_speakers:
        out.append(missing_rule("speaker_id"))
    if config.minimum_age is not None:
        out += least_rules("age", config.minimum_age)
    if config.minimum_duration is not None:
        out += least_rules("duration", config.minimum_duration)
    return out


def audited(manifest: DataFrame, cascade: Sequence[Rule]) -> DataFrame:
    """All rows with exclusion_reason and exclusion_detail (null: kept)."""
    reason, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(cascade):
        holds = F.coalesce(rule.excluded, F.lit(False))
        reason = F.when(holds, rule.reason).otherwise(reason)
        detail = F.when(holds, rule.detail).otherwise(detail)
    return manifest.withColumns({"exclusion_reason": reason, "exclusion_detail": detail})


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and excluded rows with reason and detail."""
    return rows.filter(F.col("exclusion_reason").isNull()).drop("exclusion_reason", "exclusion_detail"), rows.filter(F.col("exclusion_reason").isNotNull())


def with_conflicting_ages(rows: DataFrame, hash_column: str = "file_sha256") -> DataFrame:
    """exclusion_reason for all copies of bytes that come with several ages; the detail lists them."""
    ages = rows.groupBy(F.col(hash_column).alias("conflict_hash")).agg(F.array_sort(F.collect_set(T.to_number(F.col("age")))).alias("ages"))
    ages = ages.filter(F.size("ages") > 1)
    joined = rows.join(ages, F.col(hash_column).eqNullSafe(F.col("conflict_hash")), "left")
    detail = F.concat(F.lit("ages="), F.array_join(F.transform("ages", lambda a: a.cast("string")), T.SEPARATOR))
    return joined.withColumns({"exclusion_reason": F.when(F.col("ages").isNotNull(), "conflicting_age_for_duplicate_audio"), "exclusion_detail": detail}).drop("conflict_hash", "ages")


# ------------------------------------------------------------------ duplicates


def _present(rows: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in rows.columns]


#: Copies of one file whose lists are made by one aggregate; lists of more are made of chunks of so many values.
LIST_ROWS = 4096


def joined_lists(rows: DataFrame, by: str, values: Mapping[str, Column], chunk_rows: int | None = None) -> DataFrame:
    """by and, for each name, what T.join_distinct gives, for groups of any size.

    Values are made distinct by a shuffle on group and value, ranked by a two-pass scan and joined in chunks, so no task
    holds the values of a group one by one; only the finished texts are in one place.  A group without any value has no row.
    """
    from .scan import running

    most = chunk_rows or LIST_ROWS
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("list_name"), F.trim(c.cast("string")).alias("list_value")) for n, c in values.items()]))
    long = rows.select(F.col(by), each.alias("list_each")).select(by, "list_each.*").filter("list_value <> ''").distinct()
    placed = running(long, [F.lower("list_value"), F.col("list_value")], {"list_place": F.lit(1).cast("long")}, by=[by, "list_name"])

    def in_order(order: str, text: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), T.SEPARATOR)

    chunks = placed.groupBy(by, "list_name", F.floor((F.col("list_place") - 1) / most).alias("list_chunk")).agg(in_order("list_place", "list_value").alias("list_text"))
    whole = chunks.groupBy(by, "list_name").agg(in_order("list_chunk", "list_text").alias("list_text"))
    return whole.groupBy(by).agg(*[F.max(F.when(F.col("list_name") == n, F.col("list_text"))).alias(n) for n in values])


def _canonical(rows: DataFrame, order: Sequence[str], hash_column: str, lists: Mapping[str, Column], more: Mapping[str, Column]) -> DataFrame:
    """One row a hash: the columns of the first row in order, lists of distinct values, and aggregates."""
    from ..sources.sinks import kept

    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("first_row")
    lists = {"source_sample_ids": F.col("sample_id"), **{f"source_{c}s": F.col(c) for c in _present(rows, ("filepath", "relative_path", "metadata_path"))}, **lists}
    sums = [first, F.count("*").alias("source_count"), *[c.alias(n) for n, c in more.items()]]

    def at_once(some: DataFrame) -> DataFrame:
        return some.groupBy(hash_column).agg(*sums, *[T.join_distinct(c.cast("string")).alias(n) for n, c in lists.items()])

    large = kept(rows.groupBy(F.col(hash_column).alias("large_hash")).count().filter(F.col("count") > LIST_ROWS).select("large_hash"))
    if large.isEmpty():
        return at_once(rows)
    same = rows[hash_column].eqNullSafe(large["large_hash"])
    hot = rows.join(large, same, "left_semi")
    found = joined_lists(hot, hash_column, lists).withColumnRenamed(hash_column, "list_hash")
    heads = hot.groupBy(hash_column).agg(*sums)
    wide = heads.join(found, F.col(hash_column).eqNullSafe(F.col("list_hash")), "left").drop("list_hash")
    wide = wide.fillna("", list(lists))  # no value at all
    return at_once(rows.join(large, same, "left_anti")).unionByName(wide)


def consolidate_groups(rows: DataFrame, prefix: str = "d2", hash_column: str = "file_sha256") -> DataFrame:
    """One row for each set of equal files, keyed by recording, vowel and condition, groups joined."""
    order = _present(rows, ("pathology_group_key", "relative_path", "sample_id"))
    groups = F.col("pathology_group")
    keys = F.col("pathology_group_key") if "pathology_group_key" in rows.columns else groups
    found = F.col("pathology") if "pathology" in rows.columns else groups
    out = _canonical(rows, order, hash_column, {"joined_groups": groups, "joined_keys": keys, "joined_pathologies": found}, {})
    own = [c for c in rows.columns if c not in (hash_column, "sample_id", "pathology_group", "pathology_group_key", "pathology")]
    return out.select(
        T.canonical_id_of_key(prefix, F.col("first_row.recording_id"), F.col("first_row.vowel"), F.col("first_row.condition")).alias("sample_id"),
        *[F.col(f"first_row.{c}").alias(c) for c in own],
        hash_column,
        F.col("first_row.sample_id").alias("source_sample_id"),
        F.col("joined_groups").alias("pathology_group"),
        F.col("joined_keys").alias("pathology_group_key"),
        F.col("joined_groups").alias("pathology_groups"),
        F.col("joined_pathologies").alias("pathology"),
        F.col("joined_pathologies").alias("pathologies"),
        "source_count",
        (F.col("source_count") > 1).alias("is_consolidated_duplicate"),
        *[c for c in out.columns if c.startswith("source_") and c != "source_count"],
    )


# Columns that tell sources apart and so can't conflict; those that must agree; and those that are joined.
IDENTITY = ("sample_id", "speaker_id", "speaker_id_source", "filepath", "relative_path", "folder", "filename", "file_stem", "file_key", "metadata_filename", "metadata_file_key", "metadata_sheet")
INVARIANT = ("base", "label", "vowel", "samplerate", "duration", "channels", "audio_read_status")
JOINED = ("pathology", "pathology_code")


def _as_value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(T.NA))


def conflicts(rows: DataFrame, hash_column: str = "file_sha256", ignore: Sequence[str] = IDENTITY) -> DataFrame:
    """hash, conflict_columns: columns whose values differ among equal files (null differs from a value)."""
    names = sorted(c for c in rows.columns if c not in ignore and c != hash_column)
    sums = rows.groupBy(hash_column).agg(*[(F.min(_as_value(c)) != F.max(_as_value(c))).alias(f"differs_{c}") for c in names])
    held = F.filter(F.array(*[F.when(F.col(f"differs_{c}"), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    return sums.select(hash_column, held.alias("conflict_columns"))


def consolidate_hashes(rows: DataFrame, prefix: str = "d1", hash_column: str = "file_sha256") -> DataFrame:
    """One row for each set of equal files, keyed by the hash; other columns that conflict become null."""
    names = [c for c in rows.columns if c not in IDENTITY and c != hash_column]
    joined = _present(rows, JOINED)
    lists = {f"joined_{c}": F.col(c) for c in joined}
    more = {f"differs_{c}": F.min(_as_value(c)) != F.max(_as_value(c)) for c in names}
    out = _canonical(rows, _present(rows, ("relative_path", "sample_id")), hash_column, lists, more)
    listed = F.array_join(F.filter(F.array(*[F.when(F.col(f"differs_{c}"), F.lit(c)) for c in sorted(names)]), lambda x: x.isNotNull()), T.SEPARATOR)
    new_id = T.canonical_id_of_hash(prefix, F.col(hash_column))
    kept = [c for c in rows.columns if c not in (hash_column, "sample_id", "speaker_id", "speaker_id_source", *joined)]
    return out.select(
        new_id.alias("sample_id"),
        new_id.alias("speaker_id"),
        F.lit("assumed_unique_acoustic_sample").alias("speaker_id_source"),
        *[(F.when(~F.col(f"differs_{c}"), F.col(f"first_row.{c}")) if c in names else F.col(f"first_row.{c}")).alias(c) for c in kept],
        *[F.col(f"joined_{c}").alias(c) for c in joined],
        hash_column,
        F.col("first_row.sample_id").alias("source_sample_id"),
        "source_count",
        (F.col("source_count") > 1).alias("is_consolidated_duplicate"),
        listed.alias("metadata_conflict_columns"),
        *[c for c in out.columns if c.startswith("source_") and c != "source_count"],
    )


def duplicate_audit(rows: DataFrame, canonical: DataFrame, hash_column: str = "file_sha256") -> DataFrame:
    """Every member of sets of more than one file, with its canonical id and whether it is the source."""
    heads = canonical.filter("source_count > 1").select(
        F.col(hash_column).alias("head_hash"), F.col("sample_id").alias("canonical_sample_id"), F.col("source_sample_id").alias("head_source"), F.col("source_count").alias("group_size")
    )
    return rows.join(heads, F.col(hash_column) == F.col("head_hash")).withColumn("is_canonical_source", F.col("sample_id") == F.col("head_source")).drop("head_hash", "head_source")


# ------------------------------------------------------------------ constraints


def distinct_with_null(c: str) -> Column:
    """Aggregate: number of distinct values, null being one."""
    return F.count_distinct(_as_value(c))


def keys_with_several(rows: DataFrame, key: str | Sequence[str], *columns: str) -> DataFrame:
    """Keys that have more than one value (null being one) in any of the columns."""
    key = [key] if isinstance(key, str) else list(key)
    found = rows.groupBy(*key).agg(*[distinct_with_null(c).alias(f"n_{c}") for c in columns])
    several = F.lit(False)
    for c in columns:
        several = several | (F.col(f"n_{c}") > 1)
    return found.filter(several)


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once, and how often."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def assert_empty(violations: DataFrame, message: str, show: int = 5) -> None:
    """Raise with some of the violations if there are any."""
    found = violations.limit(show).collect()
    if found:
        raise CohortError(f"{message}: {[r.asDict() for r in found]}")


def require_columns(rows: DataFrame, *names: str) -> None:
    absent = sorted(set(names) - set(rows.columns))
    if absent:
        raise CohortError(f"missing columns: {absent}")


def check_manifest(rows: DataFrame, config: CohortConfig) -> None:
    """Columns that the configuration needs; at least one row; unique ids."""
    names = ["sample_id", "filepath", "label", "audio_read_status"]
    names += ["speaker_id"] if config.exclude_missing_speakers else []
    names += ["age"] if config.minimum_age is not None else []
    names += ["duration"] if config.minimum_duration is not None else []
    require_columns(rows, *names)
    if rows.isEmpty():
        raise CohortError("the manifest is empty")
    assert_empty(repeated(rows, "sample_id"), "repeated sample_id")


def check_labels(rows: DataFrame, allowed: Sequence[str] = ("healthy", "pathological")) -> None:
    found = {r[0] for r in rows.select(F.lower(F.trim("label")).alias("label")).distinct().limit(len(allowed) + 5).collect()}
    if found != set(allowed):
        raise CohortError(f"labels are {sorted(map(str, found))}, not {sorted(allowed)}")


def check_hash_relations(rows: DataFrame, key: Sequence[str] = ("recording_id", "vowel", "condition"), hash_column: str = "file_sha256") -> None:
    """A key has one hash; a hash has one key, label and speaker."""
    assert_empty(keys_with_several(rows, key, hash_column), "Different hashes for one acoustic key")
    whole = rows.withColumn("acoustic_key", F.concat_ws("|", *key))
    assert_empty(keys_with_several(whole, hash_column, "acoustic_key", "label", "speaker_id"), "Identical files with conflicting binary labels, keys or speakers")


def check_duplicate_labels(rows: DataFrame, hash_column: str = "file_sha256") -> None:
    assert_empty(keys_with_several(rows, hash_column, "label"), "Identical files with conflicting binary labels")


def check_invariants(rows: DataFrame, hash_column: str = "file_sha256") -> None:
    assert_empty(keys_with_several(rows, hash_column, *_present(rows, INVARIANT)), "Identical files with conflicting invariant metadata")


def check_curated(rows: DataFrame, *unique: str) -> None:
    for c in unique:
        assert_empty(repeated(rows, c), f"repeated {c}")
    assert_empty(rows.filter(T.missing(F.col("speaker_id"))).select("sample_id"), "missing speaker_id")


def check_adults(rows: DataFrame, least: float = 18.0) -> None:
    age = T.to_number(F.col("age"))
    found = rows.agg(F.count_if(age.isNull()).alias("without"), F.count_if(age < least).alias("young")).first()
    if found["without"]:
        raise CohortError(f"{found['without']} rows without valid age")
    if found["young"]:
        raise CohortError(f"{found['young']} rows younger than {least:g}")


# ------------------------------------------------------------------ the whole build


@dataclass(frozen=True)
class Cohort:
    """training, exclusions, duplicates and the one-row summary."""

    training: DataFrame
    exclusions: DataFrame
    duplicates: DataFrame
    summary: DataFrame


def summary(audit: DataFrame, training: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: counts of input, exclusions (also by reason), candidates, training rows, duplicates, classes, speakers."""
    totals = audit.agg(F.count("*").alias("input_rows"), F.count("exclusion_reason").alias("excluded_rows"), F.count_if(F.col("exclusion_reason").isNull()).alias("candidate_rows"))
    reasons = audit.filter(F.col("exclusion_reason").isNotNull()).groupBy("exclusion_reason").count()
    reasons = reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("exclusion_reason", "count")))).alias("exclusions_by_reason"))
    trained = training.agg(F.count("*").alias("training_rows"), F.count_distinct("speaker_id").alias("unique_speakers"), F.coalesce(F.sum(F.col("source_count") - 1), F.lit(0)).alias("collapsed_rows"))
    classes = training.groupBy("label").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "count")))).alias("class_distribution"))
    copies = duplicates.agg(F.count_distinct("canonical_sample_id").alias("duplicate_groups"), F.count("*").alias("duplicate_rows"))
    out = totals
    for one in (reasons, trained, classes, copies):  # one row each
        out = out.crossJoin(one)
    return out


def build(manifest: DataFrame, config: CohortConfig, by_hash: bool = False) -> Cohort:
    """Check, exclude, consolidate, check again.  by_hash: the first database's way, with age conflicts."""
    check_manifest(manifest, config)
    audit = audited(manifest, rules(config))
    kept, gone = split(audit)
    if by_hash:
        check_duplicate_labels(kept)
        if config.adults_only:
            aged = with_conflicting_ages(kept)
            kept, conflicting = split(aged)
            gone = gone.unionByName(conflicting)
        check_invariants(kept)
        training = consolidate_hashes(kept, config.prefix)
    else:
        check_hash_relations(kept)
        training = consolidate_groups(kept, config.prefix)
    check_curated(training, "sample_id", "file_sha256")
    duplicates = duplicate_audit(kept, training)
    whole = kept.withColumns({"exclusion_reason": F.lit(None).cast("string"), "exclusion_detail": F.lit(None).cast("string")}).unionByName(gone)
    return Cohort(training, gone, duplicates, summary(whole, training, duplicates))


def first_of(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in order; the order should be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("rank_in_key", F.row_number().over(w)).filter("rank_in_key = 1").drop("rank_in_key")
