"""Linear support vector machines on rows that stay where they are.

All units (split, scenario, candidate, fold) are fitted together.  A pass over the rows multiplies each Arrow batch by
the weights of all units at once and sums losses and gradients in its task; Spark adds the tasks' sums, and the driver
holds one vector of weights a unit.  So the grid costs passes, not copies of the table, and no task holds the table.

The objective is that of the exact machine: half the squared weights plus C times the weighted hinge losses, the
intercept free.  The hinge is smoothed over a width that shrinks from pass to pass (``WIDTHS``), and limited-memory
BFGS steps are taken for each unit.  On the test data the objective ends within 1 % of the exact solution's.

Imputation by exact medians, standardization and the ANOVA selection of each unit are aggregates over its training rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import kept

#: Widths of the smoothed hinge, most passes at each, past steps that are kept, and the relative decrease that ends a width.
WIDTHS, PASSES, MEMORY, ENOUGH = (0.5, 0.1, 0.02), 60, 8, 1e-5


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' vectors (a row each, array v)."""
    by = parts.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v")).toArrow().sort_by("pos")
    return by.column("v").to_numpy()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


class Linear:
    """Fits of all units; after fit(): weights (unit x feature) and bias on the plain features, objective of each unit."""

    def __init__(self, rows: DataFrame, units: Sequence[Mapping], columns: Mapping[str, Sequence[int]] | None = None):
        """rows: x, target, parts (as for search.fit_units); units: split, scenario, candidate, fold, percentile, c."""
        self.rows, self.units = kept(rows), [dict(u) for u in units]
        self.d = rows.select(F.size("x")).first()[0]
        self.masks = sorted({(int(u["split"]), int(u["fold"])) for u in self.units})
        self.mask_of = np.array([self.masks.index((int(u["split"]), int(u["fold"]))) for u in self.units])
        self.allowed = np.zeros((len(self.units), self.d), bool)
        for i, u in enumerate(self.units):
            own = (columns or {}).get(u["scenario"])
            self.allowed[i, np.arange(self.d) if own is None else np.asarray(own, int)] = True

    def _pass(self, work) -> np.ndarray:
        """work(x, missing, y, fits) -> vector, summed over all batches; fits: row x mask."""
        masks = self.masks

        def run(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    x, parts = matrix(b.column("x")), matrix(b.column("parts"))
                    missing = np.isnan(x)
                    fits = np.stack([(parts[:, s] != f) & (parts[:, s] >= 0) for s, f in masks], 1)
                    one = work(np.where(missing, 0.0, x), missing, b.column("target").to_numpy(zero_copy_only=False), fits)
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

        return _added(self.rows.select("x", "target", "parts").mapInArrow(run, "v array<double>"))

    def _medians(self) -> np.ndarray:
        """mask x feature; 0 where nothing is missing, as it is not needed there."""
        out = np.zeros((len(self.masks), self.d))
        each = self.rows.select("parts", F.posexplode("x").alias("at", "v"))
        holes = [r["at"] for r in each.filter(F.col("v").isNull() | F.isnan("v")).select("at").distinct().collect()]  # features at most
        if holes:
            held = each.filter(F.col("at").isin(holes) & F.col("v").isNotNull() & ~F.isnan("v"))
            for m, (s, f) in enumerate(self.masks):
                part = F.get("parts", F.lit(s))
                for r in held.filter((part != f) & (part >= 0)).groupBy("at").agg(F.median("v").alias("v")).collect():
                    out[m, r["at"]] = r["v"]
        return out

    def prepare(self) -> Linear:
        """Imputation, scaling, selection and costs of each unit."""
        m, d = len(self.masks), self.d
        median = self.median = self._medians()

        def sums(x, missing, y, fits):
            out = np.zeros((m, 2, 2 * d + 1))
            for c in (0, 1):
                w = (fits & (y == c)[:, None]).astype(float).T
                holes = w @ missing
                out[:, c, 0] = w.sum(1)
                out[:, c, 1 : d + 1] = w @ x + holes * median
                out[:, c, d + 1 :] = w @ (x * x) + holes * median**2
            return out.ravel()

        t = self._pass(sums).reshape(m, 2, 2 * d + 1)
        n, total, square = t[:, :, 0], t[:, :, 1 : d + 1], t[:, :, d + 1 :]
        rows = n.sum(1)[:, None]
        mean = total.sum(1) / rows
        std = np.sqrt(np.maximum(square.sum(1) / rows - mean**2, 0))
        constant = std < 1e-12 * np.maximum(1, np.abs(mean))
        std[constant] = 1
        with np.errstate(all="ignore"):
            between = (total**2 / n[:, :, None]).sum(1) - total.sum(1) ** 2 / rows
            within = square.sum(1) - (total**2 / n[:, :, None]).sum(1)
            f = np.nan_to_num(between / (within / np.maximum(rows - 2, 1)), nan=-1.0)
        self.mean, self.std, self.n, self.constant = mean[self.mask_of], std[self.mask_of], n[self.mask_of], constant[self.mask_of]
        self.chosen = np.zeros((len(self.units), d), bool)
        for i, u in enumerate(self.units):
            own = np.flatnonzero(self.allowed[i])
            k = max(1, int(len(own) * u["percentile"] / 100))
            self.chosen[i, own[np.argsort(-f[self.mask_of[i], own], kind="stable")[:k]]] = True
        c = np.array([float(u["c"]) for u in self.units])
        self.cost = c[:, None] * self.n.sum(1)[:, None] / (2 * np.maximum(self.n, 1))  # of a row, by class
        return self

    def _plain(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and bias on the plain features, of weights (and intercept, last) on the standardized ones."""
        v = np.where(self.chosen, w[:, :-1], 0) / self.std
        return v, w[:, -1] - (v * self.mean).sum(1)

    def _value(self, w: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Objective and gradient of each unit, by one pass."""
        v, bias = self._plain(w)
        filled, mask_of, cost, u, d = v * self.median[self.mask_of], self.mask_of, self.cost, len(w), self.d

        def losses(x, missing, y, fits):
            s = np.where(y == 1, 1.0, -1.0)[:, None]
            short = 1 - s * (x @ v.T + missing @ filled.T + bias)
            weight = fits[:, mask_of] * cost[:, y.astype(int)].T
            if width > 0:
                loss = np.where(short <= 0, 0, np.where(short < width, short**2 / (2 * width), short - width / 2))
                slope = np.clip(short / width, 0, 1)
            else:
                loss, slope = np.maximum(short, 0), (short > 0).astype(float)
            g = -s * slope * weight
            return np.concatenate([(loss * weight).sum(0), g.sum(0), (g.T @ x).ravel(), (g.T @ missing).ravel()])

        t = self._pass(losses)
        loss, at_bias = t[:u], t[u : 2 * u]
        at_x = t[2 * u : 2 * u + u * d].reshape(u, d) + t[2 * u + u * d :].reshape(u, d) * self.median[mask_of]
        inner = np.where(self.chosen, w[:, :-1], 0)
        g = np.where(self.chosen, (at_x - self.mean * at_bias[:, None]) / self.std, 0) + inner
        return (inner**2).sum(1) / 2 + loss, np.hstack([g, at_bias[:, None]])

    def fit(self) -> Linear:
        self.prepare()
        w = np.zeros((len(self.units), self.d + 1))
        for width in WIDTHS:
            w = self._minimized(w, width)
        self.weights, self.bias = self._plain(w)
        self.objective = self._value(w, 0)[0]
        return self

    def _minimized(self, w: np.ndarray, width: float) -> np.ndarray:
        """BFGS steps of all units, one pass for a trial of each; a unit whose trial is no progress tries half of it."""
        f, g = self._value(w, width)
        past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in w]
        step, way = np.full(len(w), 1.0), [self._direction(g[i], past[i]) for i in range(len(w))]
        open_ = np.ones(len(w), bool)
        for _ in range(PASSES):
            trial = w + np.where(open_, step, 0)[:, None] * np.stack(way)
            f2, g2 = self._value(trial, width)
            for i in np.flatnonzero(open_):
                if f2[i] <= f[i] + 1e-4 * step[i] * (g[i] @ way[i]):
                    s, y = trial[i] - w[i], g2[i] - g[i]
                    if s @ y > 1e-12:
                        past[i] = [*past[i], (s, y)][-MEMORY:]
                    open_[i] = f[i] - f2[i] > ENOUGH * abs(f[i])
                    w[i], f[i], g[i], step[i] = trial[i], f2[i], g2[i], 1.0
                    way[i] = self._direction(g[i], past[i])
                else:
                    step[i] /= 2
                    open_[i] = step[i] > 1e-10
            if not open_.any():
                break
        return w

    @staticmethod
    def _direction(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        q, a = g.copy(), []
        for s, y in reversed(past):
            a.append(s @ q / (s @ y))
            q -= a[-1] * y
        if past:
            s, y = past[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(g)))
        for (s, y), k in zip(past, reversed(a)):
            q += s * (k - y @ q / (s @ y))
        return -q


@dataclass(frozen=True)
class Plane:
    """A fitted machine on the plain features of a table, missing ones replaced by medians."""

    weights: np.ndarray
    bias: float
    median: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), self.median, x) @ self.weights + self.bias

    def decided(self, score: np.ndarray) -> np.ndarray:
        return (score > 0).astype(int)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.decided(self.score(x))


def as_is(x: np.ndarray) -> np.ndarray:
    return x


def fitted(train: DataFrame, configs: DataFrame) -> DataFrame:
    """candidate, converged, model (pickled), as search.fitted for linear configurations, fitted on all training rows."""
    todo = [{**r.asDict(), "split": 0, "scenario": "all", "fold": -1} for r in configs.collect()]  # a row a configuration
    model = Linear(train.select("x", "target", F.array(F.lit(0)).alias("parts")), todo).fit()
    median = model.median[model.mask_of]
    rows = [(u["candidate"], True, bytearray(pickle.dumps((as_is, Plane(model.weights[i], float(model.bias[i]), median[i]))))) for i, u in enumerate(todo)]
    return train.sparkSession.createDataFrame(rows, "candidate int, converged boolean, model binary")


def balanced_accuracies(model: Linear, guess) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit, on the rows it was fitted on and on those of its fold, by one pass; and the numbers of these rows.

    guess(x, missing) -> whether each unit takes each row for the positive class.
    """
    mask_of, folds = model.mask_of, model.masks

    def hits(batches):
        total = np.zeros((len(mask_of), 2, 2, 2))  # unit, fitted or left out, class, rows and hits
        for b in batches:
            if b.num_rows:
                x, parts, y = matrix(b.column("x")), matrix(b.column("parts")), b.column("target").to_numpy(zero_copy_only=False)
                right = guess(x, np.isnan(x)) == (y == 1)[:, None]
                own = np.stack([parts[:, s] for s, _ in folds], 1)
                out = own == np.array([f for _, f in folds])
                for k, which in enumerate((~out & (own >= 0), out)):
                    for c in (0, 1):
                        rows_of = which[:, mask_of] & (y == c)[:, None]
                        total[:, k, c, 0] += rows_of.sum(0)
                        total[:, k, c, 1] += (rows_of & right).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["v"])

    t = _added(model.rows.select("x", "target", "parts").mapInArrow(hits, "v array<double>")).reshape(len(mask_of), 2, 2, 2)
    some = t[..., 0] > 0
    share = np.where(some, t[..., 1] / np.maximum(t[..., 0], 1), 0).sum(axis=2) / np.maximum(some.sum(axis=2), 1)  # a class that is absent does not count
    return np.where(some.any(axis=2), share, np.nan), t[..., 0].sum(axis=2)


def fit_units(rows: DataFrame, units: DataFrame, configs: DataFrame, columns: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """split, scenario, candidate, fold, train_score, valid_score (balanced accuracies), as search.fit_units for linear units.

    The units are listed on the driver: they are the work, and as many as configurations times folds.
    """
    spark = rows.sparkSession
    todo = [r.asDict() for r in units.join(F.broadcast(configs), "candidate").orderBy("split", "scenario", "candidate", "fold").collect()]
    model = Linear(rows.select("x", "target", "parts"), todo, columns).fit()
    v, bias, filled = model.weights, model.bias, model.weights * model.median[model.mask_of]

    def guess(x: np.ndarray, missing: np.ndarray) -> np.ndarray:
        return (np.where(missing, 0.0, x) @ v.T + missing @ filled.T + bias) > 0

    scores, _ = balanced_accuracies(model, guess)
    names = ["split", "scenario", "candidate", "fold"]
    found = pd.DataFrame(todo)[names].assign(train_score=scores[:, 0], valid_score=scores[:, 1], objective=model.objective)
    return spark.createDataFrame(found, "split int, scenario string, candidate int, fold int, train_score double, valid_score double, objective double")
