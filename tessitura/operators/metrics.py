"""Binary classification metrics as aggregates: overall, by subgroup, macro averages, bootstrap.

Ranks and curves need the rows of a scope in order of score; they are aggregated to one row for each
distinct score first, and the running sums over these are a scan in two passes over ranges of scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import replicates
from .scan import running

CONFUSION = ("tn", "fp", "fn", "tp")
RATES = ("accuracy", "balanced_accuracy", "precision", "sensitivity", "specificity", "f1", "macro_f1", "uar", "mcc")
MACRO = (*RATES, "roc_auc", "average_precision")


def confusion(y_true: str = "y_true", y_pred: str = "y_pred") -> list[Column]:
    t, p = F.col(y_true) == 1, F.col(y_pred) == 1
    return [F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp")]


def _over(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a.cast("double") / b)


def rates() -> dict[str, Column]:
    """Metrics from tn, fp, fn, tp.  Empty denominators give 0, for specificity null."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in CONFUSION)
    sens, spec0 = _over(tp, tp + fn), _over(tn, tn + fp)
    f1, f1_other = _over(2 * tp, 2 * tp + fp + fn), _over(2 * tn, 2 * tn + fp + fn)
    # A class that is absent from y_true doesn't count in balanced accuracy.
    both = F.when(tp + fn == 0, spec0).when(tn + fp == 0, sens).otherwise((sens + spec0) / 2)
    # UAR counts such a class as 0 if it was predicted.
    uar = F.when((tp + fn == 0) & (fp > 0), spec0 / 2).when((tn + fp == 0) & (fn > 0), sens / 2).otherwise(both)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "accuracy": _over(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": both,
        "precision": _over(tp, tp + fp),
        "sensitivity": sens,
        "specificity": _over(tn, tn + fp, None),
        "f1": f1,
        "macro_f1": (f1 + f1_other) / 2,
        "uar": uar,
        "mcc": _over(tp * tn - fp * fn, den),
    }


def score_steps(rows: DataFrame, scope: Sequence[str] = (), y_true: str = "y_true", score: str = "y_score") -> DataFrame:
    """Per scope and distinct score, highest first: pos and neg, and cumulative true and false positives (tp, fp).

    A two-pass scan, so no task orders a scope, however many distinct scores it has.
    """
    by = rows.groupBy(*scope, score).agg(F.sum(F.col(y_true).cast("long")).alias("pos"), F.sum((1 - F.col(y_true)).cast("long")).alias("neg"))
    return running(by, [F.desc(score)], {"tp": F.col("pos"), "fp": F.col("neg")}, scope)


def ranking(rows: DataFrame, scope: Sequence[str] = (), y_true: str = "y_true", score: str = "y_score") -> DataFrame:
    """roc_auc (ties count half) and average_precision (steps, not trapezoids); null with one class only."""
    steps = score_steps(rows, scope, y_true, score)
    pos, neg = F.max("tp").cast("double"), F.max("fp").cast("double")  # the last step has the totals
    # A negative at this score is beaten by the positives above it and half of those beside it.
    wins = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    precision = F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    return steps.groupBy(*scope).agg(
        F.when((pos > 0) & (neg > 0), wins / (pos * neg)).alias("roc_auc"),
        F.when((pos > 0) & (neg > 0), F.sum(F.col("pos") * precision) / pos).alias("average_precision"),
    )


def curves(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Points of the ROC and precision-recall curves, one for each distinct score."""
    steps = score_steps(rows, scope)
    totals = steps.groupBy(*[F.col(c).alias(f"curve_{c}") for c in scope]).agg(F.max("tp").alias("all_pos"), F.max("fp").alias("all_neg"))
    same = F.lit(True)
    for c in scope:
        same &= F.col(c).eqNullSafe(F.col(f"curve_{c}"))
    s = steps.join(totals, same) if scope else steps.crossJoin(totals)  # one row
    return s.select(*scope, "y_score", (F.col("fp") / F.col("all_neg")).alias("fpr"), (F.col("tp") / F.col("all_pos")).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def evaluate(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and all metrics for each scope."""
    counts = rows.groupBy(*scope).agg(*confusion(), F.count("*").alias("n_test_samples")).withColumns(rates())
    ranks = ranking(rows, scope)
    return counts.join(ranks, list(scope)) if scope else counts.crossJoin(ranks)  # one row each


def evaluate_scopes(rows: DataFrame, subgroup: str) -> DataFrame:
    """evaluation_scope ``overall``, ``<subgroup>:<value>`` and, with several values, ``<subgroup>:macro``.

    The macro row is the unweighted mean of the metrics over the values, without their nulls; its counts are null.
    """
    overall = F.lit("overall")
    value = F.concat(F.lit(f"{subgroup}:"), F.col(subgroup).cast("string"))
    both = rows.withColumn("evaluation_scope", F.explode(F.array(overall, value)))
    each = evaluate(both.filter(F.col("evaluation_scope").isNotNull()), ("evaluation_scope",))
    parts = each.filter(F.col("evaluation_scope") != "overall")
    macro = parts.agg(F.count("*").alias("parts"), *[F.avg(m).alias(m) for m in MACRO]).filter("parts > 1").drop("parts").withColumn("evaluation_scope", F.lit(f"{subgroup}:macro"))
    return each.unionByName(macro, allowMissingColumns=True)


def bootstrap(rows: DataFrame, group: str = "group", iterations: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile intervals of the metrics over resamples of whole groups: confusion metrics, roc_auc and average_precision.

    A replicate gives each group a Poisson number of copies, which follows from a hash of the group and the replicate's
    number, so no list of groups is needed anywhere; ``replicates`` sums vectors with a place for each replicate.
    Replicates without both classes don't count.  With fewer than two groups there are no intervals: the result is empty.
    """
    if rows.select(group).distinct().limit(2).count() < 2:
        return rows.sparkSession.createDataFrame([], "metric string, ci_lower double, ci_upper double, valid_iterations bigint")
    sums = replicates.replicated(rows, group, iterations, seed)
    valid = sums.filter("tp + fn > 0 AND tn + fp > 0").withColumns(rates())
    tail = (1 - confidence) / 2
    long = valid.unpivot("replicate", [*RATES, "roc_auc", "average_precision"], "metric", "value")
    return long.groupBy("metric").agg(
        F.percentile("value", F.lit(tail)).alias("ci_lower"), F.percentile("value", F.lit(1 - tail)).alias("ci_upper"), F.count("value").alias("valid_iterations")
    )


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    """Aggregate: mean cross-entropy."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))
