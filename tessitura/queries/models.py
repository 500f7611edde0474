"""Queries for transforms, selection, metrics, splits, reports and resuming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as E
from ..operators import replicates as V
from ..operators import reports as R
from ..operators import selection as Z
from ..operators import splits as S
from ..operators import transforms as X
from ..plans.journal import Journal
from ..sources import sinks
from ..views import CANDIDATES_SQL, CV_DUCK, MANIFEST_SQL, PREDICTION_SQL, candidates, cv_results, manifest, predictions, table, vectors
from .registry import query, r6

M, L, P = f"({MANIFEST_SQL}) m", f"({CANDIDATES_SQL}) m", f"({PREDICTION_SQL}) p"
LONG = "SELECT vec_id, CAST(label < 5 AS INT) AS target, generate_subscripts(embedding, 1) AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings"


def long(spark, d):
    """vec_id, target, feature (from 1), value."""
    return vectors(spark, d).select("vec_id", "target", F.posexplode("x").alias("i", "value")).select("vec_id", "target", (F.col("i") + 1).cast("long").alias("feature"), "value")


# ------------------------------------------------------------------ transforms


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 7 > 0 THEN p_retailprice END, (SELECT median(p_retailprice) FROM part WHERE p_partkey % 7 > 0)) AS x FROM part")
def m02_median_imputer(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 > 0, F.col("p_retailprice")).alias("x"))
    return X.imputed(p, ["x"], X.medians(p, ["x"]))


@query("SELECT p_partkey, round(coalesce((p_retailprice - avg(p_retailprice) OVER ()) / nullif(stddev_pop(p_retailprice) OVER (), 0), 0), 6) AS z FROM part")
def m03_standard_scaler(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("z"))
    return X.standardized(p, ["z"]).withColumn("z", r6("z"))


@query(f"""SELECT feature, round(f, 6) AS f FROM (SELECT *, row_number() OVER (ORDER BY f DESC NULLS LAST, feature) AS rn, count(*) OVER () AS n FROM (
      SELECT feature, ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / nullif((sum(q) - sum(s * s / n)) / (sum(n) - count(*)), 0) AS f
      FROM (SELECT feature, target, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM ({LONG}) GROUP BY 1, 2) GROUP BY 1)) WHERE rn <= floor(n * 0.25)""")
def m04_anova_percentile(spark, d):
    return X.selected_percentile(X.f_scores(long(spark, d)), 25).select("feature", r6("f").alias("f"))


# ------------------------------------------------------------------ selection

FINITE = f"SELECT *, CASE WHEN gamma IS NULL THEN 0 WHEN gamma = 'scale' THEN 'inf'::DOUBLE ELSE TRY_CAST(gamma AS DOUBLE) END AS g FROM ({CV_DUCK})"
GRID = f"""
    SELECT scenario, model, arg_min(candidate, k) AS selected, arg_min(mean_score, k) AS selected_score, count(*) AS eligible, any_value(numerical_best) AS numerical_best,
           any_value(best_score) AS numerical_best_score, any_value(standard_error) AS standard_error, any_value(threshold) AS threshold
    FROM (SELECT c.*, b.*, struct_pack(a := percentile / 100.0::DOUBLE, b := neurons, c := depth, d := epochs, e := c, f := g, g := -alpha, h := -dropout, i := -mean_score, j := candidate) AS k
      FROM ({FINITE}) c JOIN (SELECT scenario AS s, model AS m, best.candidate AS numerical_best, best.mean_score AS best_score, best.std_score / sqrt(5) AS standard_error,
             best.mean_score - greatest(best.std_score / sqrt(5), 0.005) AS threshold
             FROM (SELECT scenario, model, arg_max(struct_pack(candidate := candidate, mean_score := mean_score, std_score := std_score), struct_pack(a := mean_score, b := -candidate)) AS best FROM ({CV_DUCK}) GROUP BY 1, 2)) b
      ON c.scenario = b.s AND c.model = b.m) WHERE mean_score >= threshold GROUP BY 1, 2"""


@query(f"SELECT scenario, model, selected, eligible, numerical_best, round(standard_error, 6) AS standard_error, round(threshold, 6) AS threshold FROM ({GRID})")
def m10_one_standard_error(spark, d):
    out = Z.select_grid(cv_results(spark, d), ("scenario", "model"))
    return out.select("scenario", "model", "selected", "eligible", "numerical_best", r6("standard_error").alias("standard_error"), r6("threshold").alias("threshold"))


GRIDS = f"SELECT r.*, g.standard_error, g.numerical_best_score AS best_score FROM ({GRID}) g JOIN ({CV_DUCK}) r ON r.candidate = g.selected"


def grids(spark, d):
    rows = cv_results(spark, d)
    g = Z.select_grid(rows, ("scenario", "model")).select("selected", "standard_error", F.col("numerical_best_score").alias("best_score"))
    return rows.join(g, rows["candidate"] == g["selected"]).drop("selected")


def source_sql(family: str) -> str:
    by = "GROUP BY 1" if family else ""
    lead, using = (f"{family} AS family, ", "c.family = b.family") if family else ("", "true")
    own = "c.family, " if family else ""
    return f"""
    SELECT {own}arg_min(candidate, struct_pack(l := late, a := std_score, b := abs(gap), c := f, d := -mean_score, e := candidate)) AS selected, round(max(threshold), 6) AS threshold, count_if(late = 0) AS eligible FROM (
      SELECT c.*, b.threshold, CAST(mean_score < threshold AS INT) AS late, nb FROM (SELECT *, {lead}greatest(1, round_even(n_features * percentile / 100.0::DOUBLE, 0)) AS f FROM ({GRIDS})) c
      JOIN (SELECT {lead}arg_max(candidate, struct_pack(a := best_score, b := -candidate)) AS nb, arg_max(best_score - greatest(standard_error, 0.005), struct_pack(a := best_score, b := -candidate)) AS threshold FROM ({GRIDS}) {by}) b ON {using}
    ) c WHERE late = 0 OR candidate = nb {by}"""


@query(source_sql(""))
def m11_global_choice(spark, d):
    return Z.select_source(grids(spark, d)).withColumn("threshold", r6("threshold"))


@query(source_sql("CASE WHEN contains(model, 'svm') THEN 'svm' ELSE 'mlp' END"))
def m12_family_champions(spark, d):
    rows = grids(spark, d).withColumn("family", Z.family(F.col("model")))
    return Z.select_source(rows, ("family",)).withColumn("threshold", r6("threshold"))


# ------------------------------------------------------------------ metrics

COUNTS = "count_if(y_true = 0 AND y_pred = 0) AS tn, count_if(y_true = 0 AND y_pred = 1) AS fp, count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 1 AND y_pred = 1) AS tp"


def div(a: str, b: str, empty: str = "0") -> str:
    return f"CASE WHEN {b} = 0 THEN {empty} ELSE ({a})::DOUBLE / ({b}) END"


SENS, SPEC = div("tp", "tp + fn"), div("tn", "tn + fp")
F1, F0 = div("2 * tp", "2 * tp + fp + fn"), div("2 * tn", "2 * tn + fp + fn")
BALANCED = f"CASE WHEN tp + fn = 0 THEN {SPEC} WHEN tn + fp = 0 THEN {SENS} ELSE ({SENS} + {SPEC}) / 2 END"
MCC = div("tp::DOUBLE * tn - fp::DOUBLE * fn", "sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))")
BY_VOWEL = f"SELECT vowel, {COUNTS} FROM {P} GROUP BY 1"


@query(BY_VOWEL)
def e01_confusion(spark, d):
    return predictions(spark, d).groupBy("vowel").agg(*E.confusion())


def rates(spark, d, *names):
    counts = predictions(spark, d).groupBy("vowel").agg(*E.confusion())
    return counts.select("vowel", *[r6(E.rates()[n]).alias(n) for n in names])


@query(f"SELECT vowel, round({div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, round({div('tp', 'tp + fp')}, 6) AS precision, round({SENS}, 6) AS sensitivity, round({div('tn', 'tn + fp', 'NULL')}, 6) AS specificity, round({F1}, 6) AS f1 FROM ({BY_VOWEL})")
def e02_rates(spark, d):
    return rates(spark, d, "accuracy", "precision", "sensitivity", "specificity", "f1")


@query(f"SELECT vowel, round({BALANCED}, 6) AS balanced_accuracy, round(CASE WHEN tp + fn = 0 AND fp > 0 THEN ({SPEC}) / 2 WHEN tn + fp = 0 AND fn > 0 THEN ({SENS}) / 2 ELSE {BALANCED} END, 6) AS uar FROM ({BY_VOWEL})")
def e03_balanced_accuracy(spark, d):
    return rates(spark, d, "balanced_accuracy", "uar")


@query(f"SELECT vowel, round((({F1}) + ({F0})) / 2, 6) AS macro_f1 FROM ({BY_VOWEL})")
def e04_macro_f1(spark, d):
    return rates(spark, d, "macro_f1")


@query(f"SELECT vowel, round({MCC}, 6) AS mcc FROM ({BY_VOWEL})")
def e05_mcc(spark, d):
    return rates(spark, d, "mcc")


RANKS = "SELECT *, rank() OVER (PARTITION BY {k} ORDER BY y_score) + (count(*) OVER (PARTITION BY {k}, y_score) - 1) / 2.0 AS r FROM {p}"
AUC = "CASE WHEN sum(y_true) > 0 AND sum(1 - y_true) > 0 THEN ((sum(r) FILTER (y_true = 1)) - sum(y_true) * (sum(y_true) + 1) / 2.0)::DOUBLE / (sum(y_true) * sum(1 - y_true)) END"
AP = """SELECT {k}, CASE WHEN max(ap) > 0 AND max(an) > 0 THEN sum(pos * tp / (tp + fp)) / max(ap) END AS ap FROM (
    SELECT *, (sum(pos) OVER w)::DOUBLE AS tp, (sum(neg) OVER w)::DOUBLE AS fp, sum(pos) OVER (PARTITION BY {k}) AS ap, sum(neg) OVER (PARTITION BY {k}) AS an
    FROM (SELECT {k}, y_score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM {p} GROUP BY 1, 2) WINDOW w AS (PARTITION BY {k} ORDER BY y_score DESC)) GROUP BY 1"""


@query(f"SELECT vowel, round({AUC}, 6) AS roc_auc FROM ({RANKS.format(k='vowel', p=P)}) GROUP BY 1")
def e06_roc_auc(spark, d):
    return E.ranking(predictions(spark, d), ("vowel",)).select("vowel", r6("roc_auc").alias("roc_auc"))


@query(f"SELECT vowel, round(ap, 6) AS average_precision FROM ({AP.format(k='vowel', p=P)})")
def e07_average_precision(spark, d):
    return E.ranking(predictions(spark, d), ("vowel",)).select("vowel", r6("average_precision").alias("average_precision"))


SCOPED = f"(SELECT *, unnest(['overall', 'vowel:' || vowel]) AS s FROM {P}) q"
SCOPES = f"SELECT s AS evaluation_scope, count(*) AS n, {COUNTS}, {AUC} AS auc FROM ({RANKS.format(k='s', p=SCOPED)}) GROUP BY 1"
EACH = f"SELECT evaluation_scope, n, {BALANCED} AS balanced_accuracy, {F1} AS f1, auc FROM ({SCOPES})"


@query(f"SELECT evaluation_scope, n AS n_test_samples, round(balanced_accuracy, 6) AS balanced_accuracy, round(f1, 6) AS f1, round(auc, 6) AS roc_auc FROM ({EACH})")
def e08_subgroups(spark, d):
    out = E.evaluate_scopes(predictions(spark, d), "vowel").filter("evaluation_scope NOT LIKE '%:macro'")
    return out.select("evaluation_scope", "n_test_samples", r6("balanced_accuracy").alias("balanced_accuracy"), r6("f1").alias("f1"), r6("roc_auc").alias("roc_auc"))


@query(f"SELECT 'vowel:macro' AS evaluation_scope, round(avg(balanced_accuracy), 6) AS balanced_accuracy, round(avg(f1), 6) AS f1, round(avg(auc), 6) AS roc_auc FROM ({EACH}) WHERE evaluation_scope <> 'overall'")
def a21_macro_average(spark, d):
    out = E.evaluate_scopes(predictions(spark, d), "vowel").filter("evaluation_scope LIKE '%:macro'")
    return out.select("evaluation_scope", *[r6(c).alias(c) for c in ("balanced_accuracy", "f1", "roc_auc")])


@query(f"SELECT vowel, round(-avg(y_true * ln(p) + (1 - y_true) * ln(1 - p)), 6) AS loss FROM (SELECT vowel, y_true, greatest(1e-15, least(1 - 1e-15, y_score / 40000)) AS p FROM {P}) GROUP BY 1")
def e09_log_loss(spark, d):
    return predictions(spark, d).groupBy("vowel").agg(r6(E.log_loss(F.col("y_true"), F.col("y_score") / 40000)).alias("loss"))


@query(f"SELECT doc_id % 8 AS batch, {COUNTS}, round(avg(CAST(y_true = y_pred AS INT)), 6) AS accuracy FROM {P} GROUP BY 1")
def e10_batch_counters(spark, d):
    by = predictions(spark, d).groupBy((F.col("doc_id") % 8).alias("batch")).agg(*E.confusion())
    return by.withColumn("accuracy", r6(E.rates()["accuracy"]))


# ------------------------------------------------------------------ splits

HASHED = "sha256('42|' || CAST({} AS VARCHAR))"


@query(f"SELECT sample_id, CASE WHEN rn <= floor(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM (SELECT sample_id, row_number() OVER (PARTITION BY label ORDER BY {HASHED.format('sample_id')}) AS rn, count(*) OVER (PARTITION BY label) AS n FROM {L})")
def x03_stratified_holdout(spark, d):
    return S.stratified_holdout(candidates(spark, d), "sample_id", "label").select("sample_id", F.col("partition").alias("part"))


@query(f"SELECT sample_id, CASE base WHEN 'D1' THEN 'train' ELSE 'external_test' END AS part FROM {M}")
def x04_external(spark, d):
    m = manifest(spark, d)
    return S.external(m.filter("base = 'D1'"), m.filter("base = 'D2'"), ["sample_id"]).select("sample_id", F.col("partition").alias("part"))


@query("""WITH g AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS strata FROM orders GROUP BY 1), n AS (SELECT strata, count(*) AS n FROM g GROUP BY 1),
    b AS (SELECT *, least(n, greatest(1, floor(n * 0.3::DOUBLE)))::BIGINT AS base, greatest(count(*) OVER (), round_even(sum(n) OVER () * 0.3::DOUBLE, 0)) AS goal FROM n),
    t AS (SELECT strata, base + CASE WHEN n > base AND row_number() OVER (ORDER BY n > base DESC, n * 0.3::DOUBLE - base DESC, strata DESC) <= goal - sum(base) OVER () THEN 1 ELSE 0 END AS target FROM b)
    SELECT o_custkey FROM (SELECT o_custkey, strata, row_number() OVER (PARTITION BY strata ORDER BY sha256('42|' || CAST(o_custkey AS VARCHAR))) AS rn FROM g) JOIN t USING (strata) WHERE rn <= target""")
def x05_group_subsample(spark, d):
    return S.group_subsample(table(spark, d, "orders"), "o_custkey", "o_orderstatus", 0.3).select("o_custkey").distinct()


def folds_sql(folds: int, seed: int = 42) -> str:
    """speaker_id, fold of the labelled rows' groups."""
    return f"""SELECT speaker_id, ((row_number() OVER (PARTITION BY strata ORDER BY sha256('{seed}|' || speaker_id)) - 1
        + ('0x' || substr(md5('{seed}|' || strata), 1, 8))::BIGINT) % {folds})::INTEGER AS fold
      FROM (SELECT speaker_id, string_agg(DISTINCT label, '|' ORDER BY label) AS strata FROM {L} GROUP BY 1)"""


HOLDOUT = f"""WITH f AS (SELECT m.speaker_id, m.label, f.fold FROM {L} JOIN ({folds_sql(5)}) f ON f.speaker_id = m.speaker_id),
    c AS (SELECT fold, label, count(*) AS n FROM f GROUP BY 1, 2), p AS (SELECT fold, sum(n) AS size, count(*) AS strata FROM c GROUP BY 1),
    t AS (SELECT label, count(*) AS all_n FROM f GROUP BY 1), a AS (SELECT count(*) AS n, count(DISTINCT label) AS strata FROM f),
    s AS (SELECT p.fold, abs(max(p.size) / max(a.n) - 0.2::DOUBLE) + sum(abs(coalesce(c.n, 0) / p.size - t.all_n / a.n)) / 2 AS score
      FROM p CROSS JOIN t CROSS JOIN a LEFT JOIN c ON c.fold = p.fold AND c.label = t.label WHERE p.strata = a.strata GROUP BY 1),
    b AS (SELECT arg_min(fold, struct_pack(a := score, b := fold)) AS fold FROM s)"""


@query(f"{HOLDOUT} SELECT CASE WHEN f.fold = b.fold THEN 'test' ELSE 'train' END AS partition, label, count(*) AS n, count(DISTINCT speaker_id) AS groups FROM f CROSS JOIN b GROUP BY 1, 2")
def x01_group_holdout(spark, d):
    return S.group_holdout(candidates(spark, d), "speaker_id", "label", "label").groupBy("partition", "label").agg(F.count("*").alias("n"), F.count_distinct("speaker_id").alias("groups"))


@query(f"SELECT f.fold, m.label, count(*) AS n, count(DISTINCT m.speaker_id) AS groups FROM {L} JOIN ({folds_sql(5)}) f ON f.speaker_id = m.speaker_id GROUP BY 1, 2")
def x02_inner_folds(spark, d):
    return S.with_folds(candidates(spark, d), "speaker_id", "label").groupBy("fold", "label").agg(F.count("*").alias("n"), F.count_distinct("speaker_id").alias("groups"))


DRAWS = 1000
DRAWN = f"""SELECT g."group", r AS replicate, {' + '.join(f'((a * r + b) % {V.PRIME} >= {x})::INTEGER' for x in V.poisson_bounds())} AS copies
    FROM (SELECT "group", ('0x' || substr(md5('42|' || "group"), 1, 15))::BIGINT % {V.PRIME - 1} + 1 AS a, ('0x' || substr(md5('42|' || "group"), 16, 15))::BIGINT % {V.PRIME} AS b
      FROM (SELECT DISTINCT "group" FROM {P})) g, range(1, {DRAWS + 1}) t(r)"""
REPLICATES = f"""WITH drawn AS (SELECT * FROM ({DRAWN}) WHERE copies > 0),
    c AS (SELECT "group", {COUNTS} FROM {P} GROUP BY 1),
    sums AS (SELECT replicate, {', '.join(f'sum(copies * {x})::BIGINT AS {x}' for x in ('tn', 'fp', 'fn', 'tp'))} FROM drawn JOIN c USING ("group") GROUP BY 1),
    taken AS (SELECT replicate, y_score, sum(copies * y_true)::BIGINT AS pos, sum(copies * (1 - y_true))::BIGINT AS neg FROM drawn JOIN {P} USING ("group") GROUP BY 1, 2),
    steps AS (SELECT *, (sum(pos) OVER w)::DOUBLE AS tp, (sum(neg) OVER w)::DOUBLE AS fp, (sum(pos) OVER (PARTITION BY replicate))::DOUBLE AS ap, (sum(neg) OVER (PARTITION BY replicate))::DOUBLE AS an
      FROM taken WINDOW w AS (PARTITION BY replicate ORDER BY y_score DESC)),
    ranks AS (SELECT replicate, sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / max(ap * an) AS roc_auc, sum(pos * tp / (tp + fp)) / max(ap) AS average_precision FROM steps WHERE ap > 0 AND an > 0 GROUP BY 1),
    each AS (SELECT {div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {BALANCED} AS balanced_accuracy, {div('tp', 'tp + fp')} AS precision, {SENS} AS sensitivity, {div('tn', 'tn + fp', 'NULL')} AS specificity,
      {F1} AS f1, (({F1}) + ({F0})) / 2 AS macro_f1, {BALANCED} AS uar, {MCC} AS mcc, roc_auc, average_precision FROM sums JOIN ranks USING (replicate) WHERE tp + fn > 0 AND tn + fp > 0)"""


@query(f"""{REPLICATES} SELECT metric, round(quantile_cont(value, 0.025), 6) AS ci_lower, round(quantile_cont(value, 0.975), 6) AS ci_upper, count(value) AS valid_iterations
    FROM (UNPIVOT each ON COLUMNS(*) INTO NAME metric VALUE value) GROUP BY 1""")
def x06_grouped_bootstrap(spark, d):
    return E.bootstrap(predictions(spark, d), "group", DRAWS).select("metric", r6("ci_lower").alias("ci_lower"), r6("ci_upper").alias("ci_upper"), "valid_iterations")


@query(f"SELECT speaker_id, fold, 0 AS repeat FROM ({folds_sql(3)}) UNION ALL SELECT speaker_id, fold, 1 FROM ({folds_sql(3, 43)})")
def x07_repeated_folds(spark, d):
    return S.repeated_folds(candidates(spark, d), "speaker_id", "label")


# ------------------------------------------------------------------ reports and resuming


def counted(name: str, key: str, rows: str = M, where: str = "TRUE") -> str:
    return f"SELECT '{name}' AS report, {key} AS key, count(*)::DOUBLE AS value FROM {rows} WHERE {where} GROUP BY 2"


def missing(c: str) -> str:
    return f"coalesce({c}::VARCHAR, 'missing')"


def cell(c: str) -> str:
    """Number of the value's bin, of 30."""
    return f"(CASE WHEN hi_{c} > lo_{c} THEN least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 30), 29) ELSE 0 END)::BIGINT"


def statistics(name: str, c: str) -> str:
    of = {"n": f"count({c})::DOUBLE", "mean": f"avg({c})", "least": f"min({c})", "q25": f"quantile_cont({c}, 0.25)", "q50": f"quantile_cont({c}, 0.5)", "q75": f"quantile_cont({c}, 0.75)", "most": f"max({c})"}
    each = ", ".join(f"{sql}::DOUBLE AS {n}" for n, sql in of.items())
    return f"SELECT '{name}' AS report, {missing('label')} || '|' || s AS key, v AS value FROM (UNPIVOT (SELECT label, {each} FROM {M} GROUP BY 1) ON {', '.join(of)} INTO NAME s VALUE v)"


def most(name: str, c: str, k: int) -> str:
    return f"SELECT '{name}' AS report, {c} AS key, n AS value FROM (SELECT {c}, count(*)::DOUBLE AS n FROM {M} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, {c} LIMIT {k})"


ENDS = f"(SELECT m.*, e.* FROM {M}, (SELECT min(age) AS lo_age, max(age) AS hi_age, min(duration) AS lo_duration, max(duration) AS hi_duration FROM {M}) e) q"
BASIC = " UNION ALL ".join([
    counted("class_distribution", missing("label")), counted("sex_distribution", missing("sex")), counted("class_by_sex", f"{missing('label')} || '|' || {missing('sex')}"),
    counted("duration_distribution", f"{cell('duration')}::VARCHAR", ENDS, "duration IS NOT NULL"), statistics("duration_by_class", "duration"), statistics("age_by_class", "age"), most("top_pathologies", "pathology", 15),
    counted("age_vs_duration_by_class", f"{missing('label')} || '|' || {cell('age')} || '|' || {cell('duration')}", ENDS, "age IS NOT NULL AND duration IS NOT NULL"),
])
PER_SPEAKER = f"(SELECT speaker_id, count(DISTINCT recording_id) AS recordings FROM {M} WHERE speaker_id IS NOT NULL GROUP BY 1) r"
SESSIONS = " UNION ALL ".join([
    BASIC, counted("vowel_condition_coverage", f"{missing('vowel')} || '|' || {missing(chr(34) + 'condition' + chr(34))}"), counted("recordings_per_speaker", "recordings::VARCHAR", PER_SPEAKER), most("top_pathology_groups", "pathology_group", 20),
])


@query(f"SELECT report, key, round(value, 6) AS value FROM ({BASIC})")
def d03_basic_report(spark, d):
    """The eight tables of the basic report."""
    return R.basic_report(manifest(spark, d)).withColumn("value", r6("value"))


@query(f"SELECT report, key, round(value, 6) AS value FROM ({SESSIONS})")
def d04_session_report(spark, d):
    """The basic report and the three tables of the second database."""
    return R.session_report(manifest(spark, d)).withColumn("value", r6("value"))


@query(f"SELECT base, count(*) AS n_rows, count(DISTINCT speaker_id) AS speakers, count(*) - count(DISTINCT file_sha256) AS copies, count_if(label IS NULL) AS unmatched FROM {M} GROUP BY 1")
def d07_manifest_diagnostics(spark, d):
    return manifest(spark, d).groupBy("base").agg(
        F.count("*").alias("n_rows"), F.count_distinct("speaker_id").alias("speakers"), (F.count("*") - F.count_distinct("file_sha256")).alias("copies"), F.count_if(F.col("label").isNull()).alias("unmatched")
    )


@query(f"SELECT r.scenario, r.model, r.fold FROM (SELECT DISTINCT scenario, model, fold FROM ({CV_DUCK})) r WHERE NOT (scenario = 'scenario_0' AND fold < 3)")
def o07_resume(spark, d):
    """What is left to do after a part of the units was logged, a part of that twice."""
    work = cv_results(spark, d).select("scenario", "model", "fold").distinct()
    log = Journal(spark, sinks.scratch(spark), "protocol", ["scenario", "model", "fold"])
    log.add(work.filter("scenario = 'scenario_0' AND fold < 3"))
    log.add(work.filter("scenario = 'scenario_0' AND fold = 1"))
    return log.left(work)
