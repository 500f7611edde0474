"""Grid search: a table of configurations and folds, fitted in parallel, and the choice among them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import estimators as E
from . import cascade, linear, network, spread

# The default grids.
PERCENTILES, CS, GAMMAS, LAYERS, ALPHAS, EPOCHS = (10, 25, 50), (0.01, 0.1, 1.0, 10.0), ("scale", "0.0001", "0.001", "0.01"), ((8,), (16,)), (0.001, 0.01), (5, 10, 15, 20, 30)
#: Bytes of a feature matrix that tasks may hold whole; beyond that machines and networks are fitted on rows that stay distributed.
MOST_BYTES = 256 << 20
#: Rows up to which a task fits a kernel machine by itself, as its time grows with their square; beyond that the rows of ml.spread.
MOST_ROWS = 1 << 17

HISTORY = "epoch bigint, train_loss double, train_accuracy double, train_balanced_accuracy double, valid_loss double, valid_accuracy double, valid_balanced_accuracy double"
CONFIG = "candidate int, model string, percentile int, c double, gamma string, layers array<int>, alpha double, dropout double, epochs int, neurons int, depth int"


def default_grid() -> list[tuple]:
    """12 linear, 48 kernel and 60 network configurations."""
    rows: list[tuple] = [("svm_linear", p, c, None, None, None, None, None, 0, 0) for p, c in product(PERCENTILES, CS)]
    rows += [("svm_rbf", p, c, g, None, None, None, None, 0, 0) for p, c, g in product(PERCENTILES, CS, GAMMAS)]
    rows += [("mlp", p, None, None, list(l), a, 0.0, e, sum(l), len(l)) for l, p, a, e in product(LAYERS, PERCENTILES, ALPHAS, EPOCHS)]
    return [(i, *r) for i, r in enumerate(rows)]


def configurations(spark: SparkSession, rows: Sequence[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(list(rows) if rows is not None else default_grid(), CONFIG)


def matrix(rows: DataFrame, features: str = "x", *more: str) -> pd.DataFrame:
    """The feature table on the driver, after a check of its size."""
    size = rows.agg(F.sum(F.size(features) * 8)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of features exceed {MOST_BYTES}; use distributed_svm")
    return rows.select(features, *more).toPandas()


def table_bytes(rows: DataFrame, features: str = "x") -> int:
    return rows.agg(F.sum(F.size(features) * 8)).first()[0] or 0


def check_size(rows: DataFrame, features: str = "x") -> None:
    """Each task of a diagnostic curve holds the feature table whole; raise where it is too large for that."""
    if (size := table_bytes(rows, features)) > MOST_BYTES:
        raise ValueError(f"{size} bytes of features exceed {MOST_BYTES}; searches and fits have no limit")


def families(configs: DataFrame) -> set[str]:
    return {r[0] for r in configs.select("model").distinct().collect()}  # three at most


class Held:
    """Rows that a task holds: the columns, of which x is a matrix, target of whole numbers and parts a matrix.

    x is of single precision if that holds all its values, else of double.
    """

    def __init__(self, batches: Sequence[pa.RecordBatch], x: Sequence[np.ndarray]):
        """x is emptied piece by piece, so that two copies never meet."""
        self._columns = {c: pa.concat_arrays([b.column(c) for b in batches]) for c in batches[0].schema.names}
        self.x = np.empty((sum(map(len, x)), x[0].shape[1]), np.result_type(*{piece.dtype for piece in x}))
        at = 0
        for i, piece in enumerate(x):
            self.x[at : at + len(piece)] = piece
            at, x[i] = at + len(piece), None
        self.target = self["target"].astype(int)

    def __getitem__(self, column: str) -> np.ndarray:
        return self._columns[column].to_numpy(zero_copy_only=False)

    @property
    def parts(self) -> np.ndarray:
        return linear.matrix(self._columns["parts"]).astype(np.int32)

    def members(self, column: str, of: int) -> np.ndarray:
        """The rows whose list has this number."""
        lists = self._columns[column]
        rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        out = np.zeros(len(lists), bool)
        out[rows[lists.flatten().to_numpy(zero_copy_only=False) == of]] = True
        return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """The values in single precision if that changes none."""
    with np.errstate(over="ignore"):
        out = x.astype(np.float32)
    return out if np.array_equal(out, x, equal_nan=True) else x


def in_blocks(rows: DataFrame, work: DataFrame, run: Callable[[Held, pd.DataFrame], Iterator[pd.DataFrame]], schema: str, key: str, even: Sequence[str] = (), apart: Sequence[str] = ()) -> DataFrame:
    """run(rows, part of work) in blocks of the work; each block gets the rows by a shuffle, and the driver none of them.

    The work is dealt out in turn, in the order of the columns ``even``, so that like work is spread evenly; what differs in the
    columns ``apart`` only goes to one block, if there is enough other work for all.  A task takes its rows batch by batch, in the order of their key, and holds them once, as a matrix.
    """
    blocks = rows.sparkSession.sparkContext.defaultParallelism
    order = [c for c in [*even, *work.columns] if c not in apart]
    if apart and work.select(*order).distinct().count() >= 2 * blocks:  # units of work are few
        number = F.dense_rank().over(Window.orderBy(*dict.fromkeys(order)))
    else:
        number = F.row_number().over(Window.orderBy(*even, *[c for c in work.columns if c not in even and c != "layers"]))  # over a row a unit of work
    todo = work.withColumn("block", (number - 1) % blocks).toPandas()  # units of work are few, and known to the driver
    of = {int(n): part.drop(columns="block") for n, part in todo.groupby("block")}
    kind = to_arrow_schema(T.StructType.fromDDL(schema))
    if not of:
        return rows.sparkSession.createDataFrame([], schema)
    dealt = rows.withColumn("block", F.explode(F.array(*[F.lit(n) for n in of])))
    dealt = dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", F.col(key).asc_nulls_last())

    def done(number: int, batches: list, x: list) -> Iterator[pa.RecordBatch]:
        held = Held(batches, x)
        batches.clear()
        for out in run(held, of[number]):
            yield pa.RecordBatch.from_pandas(out, kind, preserve_index=False)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, x = None, [], []
        for b in batches:
            block = b.column("block").to_numpy()
            for lo in np.flatnonzero(np.diff(block, prepend=-1)).tolist():
                if own and block[lo] != last:
                    yield from done(last, own, x)
                    own, x = [], []
                last = int(block[lo])
                at = np.flatnonzero(block == last)
                x.append(_narrow(linear.matrix(b.column("x").take(pa.array(at)))))
                own.append(b.drop_columns(["block", "x"]).take(pa.array(at)))  # copies, so that b is let go
        if own:
            yield from done(last, own, x)

    return dealt.mapInArrow(each, schema)


UNIT = "split int, scenario string, candidate int, fold int"
#: What is prepared once: units that agree in these share imputation, scaling, selection and kernel.
SHARED = ("split", "scenario", "fold", "percentile", "model", "gamma")


def fit_units(rows: DataFrame, units: DataFrame, configs: DataFrame, columns: Mapping[str, Sequence[int]] | None = None, key: str = "vec_id", predict: bool = False) -> DataFrame:
    """Fit every unit (split, scenario, candidate, fold) and score it on the rows left out.

    rows: key, x, target and parts, an array with a place for each split: the row's fold, or -1 where the split holds it
    out.  A unit of fold f is fitted on the rows of other folds and scored on those of f; a unit of fold -1 is fitted on
    all that its split does not hold out and scored on what it does.  columns: positions in x for each scenario.

    Result: the unit, train_score and valid_score; with predict also key, y_true, y_pred, y_score, a row for each row left out.
    Kernel units of more than MOST_ROWS rows are fitted by working sets that all rows follow (ml.spread).
    Over a table too large for a task linear units are fitted on rows that stay distributed (ml.linear), kernel units by
    a cascade (ml.cascade) and networks by rounds of averaged updates (ml.network).
    """
    first: dict[tuple, str] = {}
    same = {name: first.setdefault(tuple(at), name) for name, at in (columns or {}).items()}
    if len(first) < len(same):  # scenarios of the same columns are one
        names = rows.sparkSession.createDataFrame(list(same.items()), "scenario string, first string")
        all_ = units.join(F.broadcast(names), "scenario").select("split", F.col("first").alias("scenario"), "candidate", "fold", F.col("scenario").alias("name"))
        done = fit_units(rows, all_.drop("name").distinct(), configs, {n: columns[n] for n in first.values()}, key, predict)
        return all_.join(done, ["split", "scenario", "candidate", "fold"]).drop("scenario").withColumnRenamed("name", "scenario").select(done.columns)
    large = table_bytes(rows) > MOST_BYTES
    if rows.count() > MOST_ROWS:
        kernel = F.broadcast(configs.filter("model = 'svm_rbf'"))  # a row a configuration
        todo = [r.asDict() for r in units.join(kernel, "candidate").orderBy("split", "scenario", "fold", "percentile", "gamma", "candidate").collect()]  # the work itself
        if todo:
            done, rest = spread.fit_units(rows, todo, columns, key, predict), units.join(kernel, "candidate", "left_anti")
            return done.unionByName(fit_units(rows, rest, configs, columns, key, predict)) if not rest.isEmpty() else done
    if large and predict:
        return _predicted_apart(rows, units, configs, columns or {}, key)
    if large:
        used = families(configs.join(units, "candidate", "left_semi"))
        work = units.join(F.broadcast(configs.select("candidate", "model")), "candidate")  # a row a configuration
        of = {m: work.filter(F.col("model") == m).drop("model") for m in used}
        done = [linear.fit_units(rows, of["svm_linear"], configs, columns).drop("objective")] if "svm_linear" in of else []
        done += [cascade.fit_units(rows, of["svm_rbf"], configs, columns, key)] if "svm_rbf" in of else []
        done += [network.fit_units(rows, of["mlp"], configs, columns, key)] if "mlp" in of else []
        return reduce(DataFrame.unionByName, done)
    at = {k: np.asarray(v, int) for k, v in (columns or {}).items()}
    work = units.join(F.broadcast(configs), "candidate")  # a row a configuration
    unit = UNIT.split(", ")

    def run(held: Held, todo: pd.DataFrame):
        x, y, parts, ids = held.x, held.target, held.parts, held[key]
        shared, whole = list(SHARED), todo.astype(object).where(todo.notna(), None)
        whole = whole.sort_values([*shared, "candidate"], key=lambda c: c.astype(str))
        for _, some in whole.groupby(whole[shared].astype(str).agg("|".join, axis=1), sort=False):
            r = some.iloc[0]
            own = parts[:, int(r["split"])]
            fit, valid = (own != r["fold"]) & (own >= 0), own == r["fold"]
            if not valid.any() or len(np.unique(y[fit])) < 2:
                continue
            pre = E.Preprocess(int(r["percentile"])).fit(x, y, fit, at.get(r["scenario"]))
            seen, unseen, t = pre(x, fit), pre(x, valid), y[fit]
            for u, model, known, about in _fits(some.to_dict("records"), seen, t, None if predict else unseen):
                value = model.score(unseen) if predict else None
                guess = model.decided(value) if predict else model.predict(unseen) if about is None else model.predict(unseen, about)
                scores = [E.balanced_accuracy(t, known), E.balanced_accuracy(y[valid], guess)]
                base = {c.split()[0]: u[c.split()[0]] for c in unit} | {"train_score": scores[0], "valid_score": scores[1]}
                yield pd.DataFrame(base | {key: ids[valid], "y_true": y[valid], "y_pred": guess, "y_score": value} if predict else [base])
            seen = unseen = None  # before the next are made

    schema = f"{UNIT}, train_score double, valid_score double"
    if predict:
        schema += f", {key} {rows.schema[key].dataType.simpleString()}, y_true int, y_pred int, y_score double"
    return in_blocks(rows.select(key, "x", "target", "parts"), work, run, schema, key, ("model", "gamma", "percentile", "c", "epochs"), ("candidate", "c", "epochs"))


def _fits(todo: Sequence[Mapping], x: np.ndarray, y: np.ndarray, unseen: np.ndarray | None) -> Iterator[tuple[Mapping, E.SVM | E.MLP, np.ndarray, np.ndarray | None]]:
    """unit, model, its classes of x, and its scores of the unseen in single precision if it made them, of units that share what is prepared.

    Kernel machines that differ in C share the kernel, or where it is not made whole, the pieces of their start and scores; a
    network that differs from the one before in the number of epochs only goes on from it, with equal results.
    """
    if todo[0]["model"] == "mlp":
        alike, before = [c for c in ("layers", "alpha", "dropout", "seed") if c in todo[0]], None
        for r in sorted(todo, key=lambda r: (str([r[c] for c in alike]), r["epochs"])):
            same = before is not None and all(str(r[c]) == str(before[0][c]) for c in alike)
            model = E.make("mlp", r)
            if same:
                after, model = before[1].epochs, before[1]
                model.epochs = int(r["epochs"])
                model.further(x, y, after, model.rng)
            else:
                model.fit(x, y)
            before = r, model
            yield r, model, model.predict(x), None
        return
    machines = [E.make(r["model"], r) for r in todo]
    kernel = machines[0].kernel(x)
    starts = E.started(machines, x, y) if kernel is None else [None] * len(machines)
    classes = []
    for i, m in enumerate(machines):
        m.fit(x, y, kernel, start=starts[i])
        starts[i] = None
        classes.append(m.predict(x, m.about))
        m.about = None
    kernel = None
    yield from zip(todo, machines, classes, [None] * len(machines) if unseen is None else E.abouts(machines, unseen, x))


def _predicted_apart(rows: DataFrame, units: DataFrame, configs: DataFrame, columns: Mapping[str, Sequence[int]], key: str) -> DataFrame:
    """fit_units with predictions over a table too large for a task: each unit's machine, and the rows that meet it, stay distributed."""
    from ..sources.sinks import kept

    spark, names, out = rows.sparkSession, [c.split()[0] for c in UNIT.split(", ")], []
    for r in units.join(F.broadcast(configs), "candidate").orderBy(*names).collect():  # the work itself
        own = rows
        if r["scenario"] in columns:
            own = rows.withColumn("x", F.transform(F.array(*[F.lit(int(i)) for i in columns[r["scenario"]]]), lambda i: F.get("x", i)))
        part = F.get("parts", F.lit(int(r["split"])))
        fit, valid = own.filter((part != r["fold"]) & (part >= 0)), own.filter(part == r["fold"])
        if fit.select("target").distinct().count() < 2 or valid.isEmpty():
            continue
        models = kept(fitted(fit, as_configuration(spark, r.asDict()), key))
        found = kept(predicted(models, valid, key))
        hit = F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("share")
        train, left = (p.groupBy("y_true").agg(hit).agg(F.avg("share")).first()[0] for p in (predicted(models, fit, key), found))
        base = {c: F.lit(r[c]).cast(kind) for c, kind in (c.split() for c in UNIT.split(", "))} | {"train_score": F.lit(train), "valid_score": F.lit(left)}
        out.append(found.select(*[v.alias(c) for c, v in base.items()], key, "y_true", "y_pred", "y_score"))
    schema = f"{UNIT}, train_score double, valid_score double, {key} {rows.schema[key].dataType.simpleString()}, y_true int, y_pred int, y_score double"
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def cross_validate(rows: DataFrame, configs: DataFrame, key: str = "vec_id", folds: str = "fold", scenario: str = "all") -> DataFrame:
    """scenario, candidate, fold, train_score, valid_score of each configuration and fold.

    rows: x (array), target, fold.
    """
    numbers = rows.select(F.col(folds).cast("int").alias("fold")).distinct()  # as many as folds
    units = configs.select("candidate").crossJoin(numbers).select(F.lit(0).alias("split"), F.lit(scenario).alias("scenario"), "candidate", "fold")
    held = rows.withColumn("parts", F.array(F.col(folds).cast("int")))
    return fit_units(held, units, configs, key=key).select("scenario", "candidate", "fold", "train_score", "valid_score")


def results(scores: DataFrame, configs: DataFrame) -> DataFrame:
    """Per configuration mean_score, std_score (population), gap, with its parameters; input of the selection operators."""
    by = scores.groupBy("scenario", "candidate").agg(F.avg("valid_score").alias("mean_score"), F.stddev_pop("valid_score").alias("std_score"), (F.avg("train_score") - F.avg("valid_score")).alias("gap"))
    return by.join(F.broadcast(configs), "candidate")  # a row a configuration


def fitted(train: DataFrame, configs: DataFrame, key: str = "vec_id") -> DataFrame:
    """candidate, converged, model (pickled): each configuration fitted on all training rows, one row of work each.

    Kernel machines of more than MOST_ROWS rows come in pieces, a row each, whose scores add up.

    Over a table too large for a task linear ones are fitted on rows that stay distributed, kernel machines by a cascade,
    networks by rounds of averaged updates.
    """
    if train.count() > MOST_ROWS and "svm_rbf" in (used := families(configs)):
        done = _kernel_fits(train.select(key, "x", "target", F.array(F.lit(0)).alias("parts")), configs, key)[0]
        return done.unionByName(fitted(train, configs.filter("model <> 'svm_rbf'"), key)) if len(used) > 1 else done
    if table_bytes(train) > MOST_BYTES:
        used = families(configs)
        of = {m: configs.filter(F.col("model") == m) for m in used}
        done = [linear.fitted(train, of["svm_linear"])] if "svm_linear" in of else []
        done += [cascade.fitted(train, of["svm_rbf"], key)] if "svm_rbf" in of else []
        done += [network.fitted(train, of["mlp"], key)] if "mlp" in of else []
        return reduce(DataFrame.unionByName, done)

    def run(held: Held, todo: pd.DataFrame):
        x, y = held.x, held.target
        for r in todo.astype(object).where(todo.notna(), None).to_dict("records"):
            pre = E.Preprocess(int(r["percentile"])).fit(x, y)
            model = E.make(r["model"], r).fit(pre(x), y)
            yield pd.DataFrame([(r["candidate"], getattr(model, "converged", True), pickle.dumps((pre, model)))], columns=["candidate", "converged", "model"])

    return in_blocks(train.select(key, "x", "target"), configs, run, "candidate int, converged boolean, model binary", key, ("candidate",))


def predicted(models: DataFrame, test: DataFrame, key: str = "vec_id") -> DataFrame:
    """candidate, key, y_true, y_pred, y_score of the test rows under each of the models.

    The rows are dealt into blocks, and each block meets each model once; no model goes through the driver.
    """
    blocks = cascade.blocks_of(test)
    left = test.select(key, "x", "target", F.pmod(F.hash(key), F.lit(blocks)).alias("block")).repartition(blocks, "block")
    right = models.select("candidate", "model", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).repartition(blocks, "block")
    names = ["candidate", key, "y_true", "y_pred", "y_score"]

    def run(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            x = np.stack(rows["x"].to_numpy()).astype(float)
            total: dict = {}
            for candidate, model in zip(held["candidate"], held["model"]):
                pre, m = pickle.loads(model)
                total[candidate] = m, m.score(pre(x)) + (total[candidate][1] if candidate in total else 0)  # pieces of one machine
            for candidate, (m, value) in total.items():
                out.append(pd.DataFrame({"candidate": candidate, key: rows[key], "y_true": rows["target"], "y_pred": m.decided(value), "y_score": value}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    kind = test.schema[key].dataType.simpleString()
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(run, f"candidate int, {key} {kind}, y_true int, y_pred int, y_score double")


def _kernel_fits(rows: DataFrame, configs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Models of the kernel configurations, fitted on the rows of part 0, and their predictions of those of part -1."""
    from ..sources.sinks import kept

    todo = [{**r.asDict(), "split": 0, "scenario": "all", "fold": -1} for r in configs.filter("model = 'svm_rbf'").orderBy("candidate").collect()]  # a row a configuration
    models, found = [], []
    for fit, named in spread.fitted_apart(rows, todo, None, key):
        of = F.broadcast(named.select("unit", "candidate"))
        models.append(kept(fit.models().join(of, "unit").select("candidate", "converged", "model")))
        found.append(kept(fit.predictions().join(of, "unit").select("candidate", key, "y_true", "y_pred", "y_score")))
    return reduce(DataFrame.unionByName, models), reduce(DataFrame.unionByName, found)


def fitted_predicted(train: DataFrame, test: DataFrame, configs: DataFrame, key: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """fitted(), and predicted() of the test rows; kernel machines of more than MOST_ROWS rows are never held whole for it."""
    from ..sources.sinks import kept

    used = families(configs)
    if "svm_rbf" not in used or train.count() <= MOST_ROWS:
        models = kept(fitted(train, configs, key))
        return models, predicted(models, test, key)
    parts = [rows.select(key, "x", "target", F.array(F.lit(n)).alias("parts")) for rows, n in ((train, 0), (test, -1))]
    models, found = _kernel_fits(parts[0].unionByName(parts[1]), configs, key)
    if len(used) > 1:
        more, others = fitted_predicted(train, test, configs.filter("model <> 'svm_rbf'"), key)
        models, found = models.unionByName(more), found.unionByName(others)
    return models, found


def as_configuration(spark: SparkSession, config: dict) -> DataFrame:
    """One configuration of a row of results."""
    row = tuple({"candidate": 0, "neurons": 0, "depth": 0, **config}.get(c.split()[0]) for c in CONFIG.split(", "))
    return configurations(spark, [row])


def fit_final(train: DataFrame, test: DataFrame, config: dict, key: str = "vec_id") -> DataFrame:
    """Refit one configuration on all training rows, in a task; key, y_true, y_pred, y_score of the test rows."""
    return fitted_predicted(train, test, as_configuration(train.sparkSession, config), key)[1].drop("candidate")


def learning_points(rows: DataFrame, config: dict, fractions: Sequence[float], group: str = "group", key: str = "vec_id", seed: int = 42) -> DataFrame:
    """train_fraction, fold, n_train, train_score, valid_score: the configuration on group subsamples of each training part."""
    from ..operators.splits import group_subsample

    check_size(rows)
    spark, parts, runs = rows.sparkSession, None, []
    for f in sorted({r[0] for r in rows.select("fold").distinct().collect()}):
        for q in fractions:
            one = group_subsample(rows.filter(F.col("fold") != f), group, "target", q, seed + 1000 * f + round(100 * q)).select(key, F.lit(len(runs)).alias("run"))
            parts = one if parts is None else parts.unionByName(one)
            runs.append((len(runs), int(f), float(q)))
    held = rows.select(key, "x", "target", "fold").join(parts.groupBy(key).agg(F.collect_set("run").alias("runs")), key, "left")  # folds x fractions at most

    def run(table: Held, todo: pd.DataFrame):
        x, y = table.x, table.target
        for number, fold, fraction in todo[["run", "fold", "train_fraction"]].itertuples(index=False):
            fit, valid = table.members("runs", number), table["fold"] == fold
            pre = E.Preprocess(int(config["percentile"])).fit(x, y, fit)
            m = E.make(config["model"], config).fit(pre(x, fit), y[fit])
            scores = [E.balanced_accuracy(y[p], m.predict(pre(x, p))) for p in (fit, valid)]
            yield pd.DataFrame([(fraction, fold, int(fit.sum()), *scores)], columns=["train_fraction", "fold", "n_train", "train_score", "valid_score"])

    work = spark.createDataFrame(runs, "run int, fold int, train_fraction double")
    return in_blocks(held, work, run, "train_fraction double, fold int, n_train int, train_score double, valid_score double", key, ("run",))


def epoch_history(train: DataFrame, valid: DataFrame, config: dict, key: str = "vec_id") -> DataFrame:
    """Loss and accuracies after each epoch of a network on a diagnostic split inside the training rows; fitted in a task."""
    check_size(train.select("x").unionByName(valid.select("x")))
    both = train.select(key, "x", "target", F.lit(True).alias("fits")).unionByName(valid.select(key, "x", "target", F.lit(False).alias("fits")))
    names = [f.split()[0] for f in HISTORY.split(", ")]

    def run(held: Held, todo: pd.DataFrame):
        x, y, fit = held.x, held.target, held["fits"].astype(bool)
        pre = E.Preprocess(int(config["percentile"])).fit(x, y, fit)
        model = E.make("mlp", config).fit(pre(x, fit), y[fit], (pre(x, ~fit), y[~fit]))
        yield pd.DataFrame(model.history)[names]

    return in_blocks(both, train.sparkSession.range(1), run, HISTORY, key)


def distributed_svm(rows: DataFrame, c: float = 1.0, gamma: float | None = None, components: int = 512, seed: int = 42, features: str = "x"):
    """A fitted Spark pipeline for data of any size: LinearSVC, after random Fourier features for a kernel.

    An approximation of the kernel machine; its error falls with the number of components.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    from ..operators.transforms import class_weights

    weighted = rows.join(F.broadcast(class_weights(rows)), "target")  # a row a class
    x = F.col(features)
    if gamma is not None:
        n = len(rows.select(features).first()[0])
        rng = np.random.default_rng(seed)
        w, b = rng.normal(0, np.sqrt(2 * gamma), (components, n)), rng.uniform(0, 2 * np.pi, components)
        x = fourier(x, w, b)
    total = weighted.agg(F.sum("weight")).first()[0]
    svc = LinearSVC(featuresCol="vector", labelCol="target", weightCol="weight", regParam=1 / (c * total), maxIter=100)
    prepared = weighted.withColumn("vector", array_to_vector(x))
    return Pipeline(stages=[svc]).fit(prepared)


def fourier(x, w: np.ndarray, b: np.ndarray):
    """Random Fourier features of an array column, in Arrow batches."""
    import pyarrow as pa

    def run(column: pa.Array) -> pa.Array:
        m = np.stack(column.to_pylist()) if len(column) else np.zeros((0, w.shape[1]))
        z = np.cos(m @ w.T + b) * np.sqrt(2 / len(b))
        return pa.array(list(z), pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(x)
