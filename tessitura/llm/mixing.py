"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each row has a 36-bit hash of its content.  A source that shall give k whole passes and a rest takes
k + 1 copies of the rows below a hash threshold and k of the others.  The threshold comes from
nested histograms: words summed by source and the top 12 bits of the hash show the bucket in which
the budget ends; only that bucket is split by the next 12 bits, and so on.  The last bucket goes
in if that brings the sum nearer to the budget.  No row is sorted, and a histogram has 4,096 rows
a source at most.

Edge cases: a null source is a source of its own, ordered last; a null text has size 0; sources of
size 0 get target 0, and their rows are not taken; rows of size 0 in other sources are taken like the rest; equal rows have equal hashes and are taken alike; an empty table gives an
empty result; null ids are hashed as empty text.  Only doc_id, text and source are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MOST_PASSES = 3
#: Levels of the histogram, and bits of the hash that each level reads.
LEVELS, BITS = 3, 12
HEX = LEVELS * BITS // 4

def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def row_hash() -> Column:
    """36 bits of MD5 over id and text: equal in every run and every engine."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HEX), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source, source_size -> also target.  One row a source, so one partition holds them.

    With sources in order of most * size / weight, the level that remains when the first j stop at
    their limit is (all - limits of j) / (weights of the rest); the highest of these is the level at
    which nothing is above its limit, and a target is min(limit, level * weight).
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    before = Window.orderBy((most * F.col("source_size") / F.col("weight")), F.col("source").isNull(), "source")
    all_rows = Window.partitionBy()
    return (
        sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("limits", F.sum(most * F.col("source_size")).over(before.rowsBetween(Window.unboundedPreceding, 0)) - most * F.col("source_size"))
        .withColumn("rest", F.sum("weight").over(before.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("total") - F.col("limits")).cast("double") / F.col("rest").cast("double")).over(all_rows))
        .withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight").cast("double")))
        .select("source", "source_size", "target")
    )


def _digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words().alias("size"), row_hash().alias("hash"))


def thresholds(digest: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Per source: mix_source, mix_size, mix_target, mix_passes, mix_threshold.

    A row of the source is taken mix_passes times, and once more if its hash is below mix_threshold.
    """
    # A source may hold most rows: its name is a key of sums only, which are made in each task first.
    sizes = digest.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    plan = plan.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = written(plan.withColumn("prefix", zero).withColumn("below", zero).withColumn("end", zero), "mixing")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        open_ = plan.select(F.col("source").alias("s"), "prefix", "below", "budget")
        buckets = (
            digest.join(open_, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + BITS) == F.col("prefix")))
            .groupBy("s", "below", "budget", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"))
        )
        run = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
        # The budget ends in the first bucket that ends above it.
        last = (
            buckets.withColumn("stop", F.col("below") + run)
            .filter(F.col("stop") > F.col("budget"))
            .groupBy("s")
            .agg(F.min(F.struct("bucket", (F.col("stop") - F.col("words")).alias("begin"), "stop")).alias("at"))
        )
        plan = plan.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source",
            "source_size",
            "target",
            "passes",
            "budget",
            F.coalesce(F.col("at.bucket"), F.lit(1 << BITS * (level + 1)).cast("long")).alias("prefix"),
            F.coalesce(F.col("at.begin"), F.col("below")).alias("below"),
            F.coalesce(F.col("at.stop"), F.col("below")).alias("end"),
        )
        plan = written(plan, "mixing")
    nearer = (F.col("end") - F.col("budget")) < (F.col("budget") - F.col("below"))
    # Without a rest no row is taken once more, not even one of size 0.
    threshold = F.when(F.col("budget") > 0, F.col("prefix") + nearer.cast("long")).otherwise(zero)
    return plan.select(
        F.col("source").alias("mix_source"),
        F.col("source_size").alias("mix_size"),
        F.col("target").alias("mix_target"),
        F.col("passes").alias("mix_passes"),
        threshold.alias("mix_threshold"),
    )


def _passes(rows: DataFrame, chosen: DataFrame) -> tuple[DataFrame, Column]:
    taken = F.col("mix_passes") + (F.col("mix_hash") < F.col("mix_threshold")).cast("long")
    return rows.join(chosen, rows["source"].eqNullSafe(F.col("mix_source"))), taken


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    digest = written(_digest(docs), "mixing")
    rows, taken = _passes(digest.withColumnRenamed("hash", "mix_hash"), thresholds(digest, weights, most))
    return rows.select("doc_id", "size", F.col("mix_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * taken).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """The rows of docs as often as the mix takes them, columns as they were."""
    names = docs.columns
    clash = [c for c in names if c.lower().startswith("mix_")]
    held = docs.withColumnsRenamed({c: f"held_{i}_{c}" for i, c in enumerate(clash)})
    chosen = thresholds(written(_digest(docs), "mixing"), weights, most)
    rows, taken = _passes(held.withColumn("mix_hash", row_hash()), chosen)
    rows = rows.withColumn("mix_copy", F.explode(F.when(taken > 0, F.sequence(F.lit(1).cast("long"), taken))))
    return rows.select(*[F.col(f"held_{clash.index(c)}_{c}").alias(c) if c in clash else F.col(c) for c in names])


def targets_sql(documents: str = "documents", weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> str:
    """DuckDB CTEs (without WITH) that end in mix_plan(source, size, target, passes, threshold) and mix_rows."""
    cycle = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
    mix_rows AS (
      SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS mix_words,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {HEX}))::BIGINT AS mix_hash
      FROM {documents}),
    mix_sizes AS (SELECT source, sum(mix_words)::BIGINT AS size FROM mix_rows GROUP BY source),
    mix_weights AS (
      SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(weights)} {cycle} END AS weight FROM mix_sizes),
    mix_levels AS (
      SELECT *, max((total - limits)::DOUBLE / rest::DOUBLE) OVER () AS level FROM (
        SELECT *, (sum(size) OVER ())::BIGINT AS total, (sum({most} * size) OVER w)::BIGINT - {most} * size AS limits,
               (sum(weight) OVER ())::BIGINT - (sum(weight) OVER w)::BIGINT + weight AS rest
        FROM mix_weights WINDOW w AS (ORDER BY {most} * size / weight::DOUBLE, source IS NULL, source ROWS UNBOUNDED PRECEDING))),
    mix_targets AS (
      SELECT source, size, least(({most} * size)::DOUBLE, level * weight::DOUBLE) AS target FROM mix_levels),
    mix_budgets AS (
      SELECT *, CASE WHEN size > 0 THEN floor(target / size)::BIGINT ELSE 0 END AS passes,
             target - (CASE WHEN size > 0 THEN floor(target / size)::BIGINT ELSE 0 END) * size AS budget
      FROM mix_targets),
    mix_runs AS (
      SELECT b.source, mix_hash, words, sum(words) OVER (PARTITION BY b.source ORDER BY mix_hash) AS stop, budget
      FROM (SELECT source, mix_hash, sum(mix_words) AS words FROM mix_rows GROUP BY 1, 2) r
      JOIN mix_budgets b ON r.source IS NOT DISTINCT FROM b.source),
    mix_ends AS (
      SELECT source, min(mix_hash) AS hash, arg_min(stop, mix_hash) AS stop, arg_min(stop - words, mix_hash) AS below, any_value(budget) AS budget
      FROM mix_runs WHERE stop > budget GROUP BY source),
    mix_plan AS (
      SELECT b.*, CASE WHEN b.budget > 0 THEN 1 ELSE 0 END * coalesce(e.hash + CASE WHEN e.stop - e.budget < e.budget - e.below THEN 1 ELSE 0 END, {1 << LEVELS * BITS}) AS threshold
      FROM mix_budgets b LEFT JOIN mix_ends e ON b.source IS NOT DISTINCT FROM e.source)"""


def oracle() -> str:
    """DuckDB SQL for the rows of mixed(): the same rule by sorting."""
    return f"""WITH {targets_sql()}
    SELECT doc_id, mix_words AS size, p.size AS source_size, p.target,
           mix_words * (p.passes + CASE WHEN mix_hash < p.threshold THEN 1 ELSE 0 END)::BIGINT AS taken
    FROM mix_rows r JOIN mix_plan p ON r.source IS NOT DISTINCT FROM p.source"""
