"""Manifest rows as typed samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TEXT = ("sample_id", "base", "filepath", "label", "speaker_id", "recording_id", "sex", "pathology", "vowel", "condition", "pitch")
NUMBERS = ("age", "duration")


def typed_samples(rows: DataFrame) -> DataFrame:
    """Blank text and NaN become null, unreadable numbers too; the whole row stays as a map of text."""
    values = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in TEXT if c in rows.columns}
    values |= {c: T.safe_float(F.col(c)) for c in NUMBERS if c in rows.columns}
    values |= {c: F.lit(None).cast("string") for c in TEXT if c not in rows.columns}
    values |= {c: F.lit(None).cast("double") for c in NUMBERS if c not in rows.columns}
    whole = F.map_from_arrays(F.array(*[F.lit(c) for c in rows.columns]), F.array(*[F.col(c).cast("string") for c in rows.columns]))
    return rows.withColumn("metadata", whole).withColumns(values)
