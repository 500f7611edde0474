"""Streaming forms of the row-wise operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as E
from ..operators.cohort import Rule, audited


def audited_stream(rows: DataFrame, cascade: Sequence[Rule]) -> DataFrame:
    """The rule cascade holds no state, so a stream passes through it as it is."""
    return audited(rows, cascade)


def exclusion_counts(rows: DataFrame, cascade: Sequence[Rule], time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows by reason in windows of event time; rows later than the watermark are left out."""
    out = audited(rows, cascade).withWatermark(time, late)
    return out.groupBy(F.window(time, window), F.coalesce("exclusion_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def confusion_counts(rows: DataFrame, key: str = "epoch") -> DataFrame:
    """Running confusion counts with accuracy and balanced accuracy, as batches arrive."""
    return rows.groupBy(key).agg(*E.confusion()).withColumns({n: E.rates()[n] for n in ("accuracy", "balanced_accuracy")})
