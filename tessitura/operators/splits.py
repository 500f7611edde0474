"""Group-disjoint stratified splits, folds and subsamples.

Groups, not rows, are assigned.  Assignment is by hash order inside each stratum, so it is a window
over the groups and not a loop; a fixed seed gives equal splits on any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cohort import CohortError, assert_empty


def hash_order(seed: int, *columns: Column) -> Column:
    """A pseudo-random text key for ordering, equal in every engine."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]), 256)


def group_strata(rows: DataFrame, group: str, stratum: str) -> DataFrame:
    """group, strata (sorted distinct, joined), n: one row a group."""
    return rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(F.col(stratum).cast("string"))), "|").alias("strata"), F.count("*").alias("n"))


def group_folds(rows: DataFrame, group: str, stratum: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """group, fold (0 to folds - 1): the groups of each stratum are dealt out in hash order.

    The strata start at different folds, so that small strata don't all fill the first ones.
    """
    if folds < 2:
        raise ValueError("at least 2 folds")
    by = group_strata(rows, group, stratum)
    order = Window.partitionBy("strata").orderBy(hash_order(seed, F.col(group)))
    start = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("strata"))), 1, 8), 16, 10).cast("long"), F.lit(folds))
    return by.select(group, F.pmod(F.row_number().over(order) - 1 + start, F.lit(folds)).cast("int").alias("fold"))


def with_folds(rows: DataFrame, group: str, stratum: str, folds: int = 5, seed: int = 42) -> DataFrame:
    return rows.join(group_folds(rows, group, stratum, folds, seed), group)


def holdout_scores(rows: DataFrame, group: str, stratum: str, target: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """fold, score of each fold as the test part: distance of its size and of its class shares."""
    folds = max(2, round(1 / test_size))
    r = with_folds(rows, group, stratum, folds, seed)
    counts = r.groupBy("fold", stratum).agg(F.count("*").alias("n"))
    per = counts.groupBy("fold").agg(F.sum("n").alias("size"), F.count("*").alias("strata"))
    total = rows.groupBy(stratum).agg(F.count("*").alias("all_n"))
    n = rows.agg(F.count("*").alias("rows"), F.count_distinct(stratum).alias("all_strata"))
    grid = per.crossJoin(total)  # folds x strata
    both = grid.join(counts, ["fold", stratum], "left").crossJoin(n)
    distance = F.abs(F.coalesce("n", F.lit(0)) / F.col("size") - F.col("all_n") / F.col("rows"))
    scored = both.groupBy("fold").agg((F.abs(F.max("size") / F.max("rows") - test_size) + F.sum(distance) / 2).alias("score"), (F.max("strata") == F.max("all_strata")).alias("complete"))
    return scored.filter("complete").drop("complete")


def group_holdout(rows: DataFrame, group: str, stratum: str, target: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with partition ``train`` or ``test``: the fold with the best score is the test part."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    best = holdout_scores(rows, group, stratum, target, test_size, seed).agg(F.min_by("fold", F.struct("score", "fold"))).first()[0]
    if best is None:
        raise CohortError("no fold has all strata")
    r = with_folds(rows, group, stratum, max(2, round(1 / test_size)), seed)
    return r.withColumn("partition", F.when(F.col("fold") == best, "test").otherwise("train")).drop("fold")


def stratified_holdout(rows: DataFrame, key: str, stratum: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Ungrouped: the given share of each stratum, in hash order, is the test part."""
    order = Window.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)))
    n = F.count("*").over(Window.partitionBy(stratum))
    return rows.withColumn("partition", F.when(F.row_number().over(order) <= F.floor(n * test_size), "test").otherwise("train"))


def external(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One database trains and the other is tested, on their common columns."""
    return train.select(*columns, F.lit("train").alias("partition")).unionByName(test.select(*columns, F.lit("external_test").alias("partition")))


def subsample_targets(strata: DataFrame, fraction: float) -> DataFrame:
    """strata, n, target: groups to draw from each stratum for a fraction of them.

    At least one each, floor of the share, then the largest remainders until the rounded total is met.
    """
    share = F.col("n") * F.lit(fraction)
    base = F.least(F.col("n"), F.greatest(F.lit(1), F.floor(share))).cast("long")
    whole = Window.partitionBy()
    t = strata.withColumn("base", base).withColumn("goal", F.greatest(F.count("*").over(whole), F.bround(F.sum("n").over(whole) * fraction))).withColumn("missing", F.col("goal") - F.sum("base").over(whole))
    # At most one more for each stratum, those with most remainder first.
    order = Window.orderBy(F.desc(F.col("open") > 0), F.desc(share - F.col("base")), F.desc("strata"))
    t = t.withColumn("open", F.col("n") - F.col("base"))
    t = t.withColumn("more", ((F.row_number().over(order) <= F.col("missing")) & (F.col("open") > 0)).cast("long"))
    return t.select("strata", "n", F.when(F.lit(fraction >= 1), F.col("n")).otherwise(F.col("base") + F.col("more")).alias("target"))


def group_subsample(rows: DataFrame, group: str, stratum: str, fraction: float, seed: int = 42) -> DataFrame:
    """Rows of a stratified sample of whole groups."""
    if fraction >= 1:
        return rows
    by = group_strata(rows, group, stratum)
    targets = subsample_targets(by.groupBy("strata").agg(F.count("*").alias("n")), fraction)
    order = Window.partitionBy("strata").orderBy(hash_order(seed, F.col(group)))
    chosen = by.withColumn("place", F.row_number().over(order)).drop("n").join(targets, "strata").filter("place <= target").select(group)
    return rows.join(chosen, group, "left_semi")


def repeated_folds(rows: DataFrame, group: str, stratum: str, folds: int = 3, repeats: int = 2, seed: int = 42) -> DataFrame:
    """group, repeat, fold: one assignment for each repeat, seeded seed + repeat."""
    out = None
    for r in range(repeats):
        one = group_folds(rows, group, stratum, folds, seed + r).withColumn("repeat", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


def shared_groups(rows: DataFrame, group: str, partition: str = "partition") -> DataFrame:
    """Groups that stand in more than one part (leakage)."""
    return rows.groupBy(group).agg(F.count_distinct(partition).alias("parts")).filter("parts > 1")


def check_split(rows: DataFrame, group: str, stratum: str, target: str, partition: str = "partition") -> None:
    """No shared group; all classes and strata in every part."""
    assert_empty(shared_groups(rows, group, partition), "groups in several parts")
    for c in (target, stratum):
        n = rows.select(c).distinct().count()
        assert_empty(rows.groupBy(partition).agg(F.count_distinct(c).alias("n")).filter(F.col("n") < n), f"a part lacks a value of {c}")
