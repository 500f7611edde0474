"""Feature rows from signals, one Arrow batch at a time; a record that fails becomes a row with its error."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dsp


def extract(samples: DataFrame, target: int = 16000, glottal: bool = True, families: Sequence[str] = dsp.FAMILIES) -> DataFrame:
    """samples: any columns, signal (array<float>) and sr (int).  Adds features, duration, status, error; drops signal.

    families: which are made, all unless some are named; a failure in one that is not made is not seen.
    Wide results come from one struct, not from a chain of columns.
    """
    names = dsp.feature_names(glottal, families)
    fields = [pa.field(n, pa.float64()) for n in (*names, "processed_duration")] + [pa.field("status", pa.string()), pa.field("error", pa.string())]
    ddl = ", ".join(f"{n} double" for n in (*names, "processed_duration")) + ", status string, error string"

    def run(signals: pa.Array, rates: pa.Array) -> pa.Array:
        values, errors = np.full((len(names) + 1, len(signals)), np.nan), [None] * len(signals)
        for k, (x, rate) in enumerate(zip(signals, rates)):  # one signal is opened at a time
            try:
                y, r = dsp.preprocess(_array(x), int(rate.as_py() or 0), target)
                f = dsp.features(y, r, glottal, families)
                values[:, k] = [*(f.get(n, np.nan) for n in names), len(y) / r]
            except Exception as e:  # one bad recording must not fail the others
                values[:, k], errors[k] = np.nan, str(e)
        columns = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in values]
        columns += [pa.array(["ok" if e is None else "error" for e in errors], pa.string()), pa.array(errors, pa.string())]
        return pa.StructArray.from_arrays(columns, fields=fields)

    out = samples.withColumn("extracted", F.arrow_udf(run, ddl)("signal", "sr")).drop("signal")
    return out.select(*[c for c in out.columns if c != "extracted"], "extracted.*")


def _array(signal: pa.ListScalar) -> np.ndarray:
    """The samples of a list, nulls as NaN; none for a null."""
    return np.zeros(0, np.float32) if signal.values is None else signal.values.to_numpy(zero_copy_only=False).astype(np.float32)


def profile(samples: DataFrame, target: int = 16000) -> DataFrame:
    """sr, n_samples, duration, rms, peak, status, error of each processed signal."""
    fields = [pa.field("processed_sr", pa.int64()), pa.field("n_samples", pa.int64()), *[pa.field(n, pa.float64()) for n in ("processed_duration", "rms", "peak")], pa.field("status", pa.string()), pa.field("error", pa.string())]

    def run(signals: pa.Array, rates: pa.Array) -> pa.Array:
        rows = []
        for x, rate in zip(signals, rates):
            try:
                y, r = dsp.preprocess(_array(x), int(rate.as_py() or 0), target)
                rows.append((r, len(y), len(y) / r, float(np.sqrt(np.mean(y.astype(np.float64) ** 2))), float(np.abs(y).max()), "ok", None))
            except Exception as e:  # one bad recording must not fail the others
                rows.append((None, None, None, None, None, "error", str(e)))
        columns = list(zip(*rows)) if rows else [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)

    ddl = "processed_sr bigint, n_samples bigint, processed_duration double, rms double, peak double, status string, error string"
    out = samples.withColumn("profiled", F.arrow_udf(run, ddl)("signal", "sr")).drop("signal")
    return out.select(*[c for c in out.columns if c != "profiled"], "profiled.*")
