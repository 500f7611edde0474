"""Queries for joins, aggregates, windows, ordering, set operations and constraints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cohort as C
from ..operators import reports as R
from ..operators import splits as S
from ..operators import transforms as X
from ..views import CANDIDATES_SQL, CV_DUCK, MANIFEST_SQL, SIGNAL_SQL, candidates, cv_results, manifest, predictions, table
from .registry import query, r6

M, L = f"({MANIFEST_SQL}) m", f"({CANDIDATES_SQL}) m"


def agg_joined(c: str) -> str:
    return f"coalesce(list_aggregate(list_transform(list_sort(list_distinct(list(CASE WHEN trim({c}) <> '' THEN lower(trim({c})) || chr(1) || trim({c}) END))), lambda x: string_split(x, chr(1))[2]), 'string_agg', ' | '), '')"


# ------------------------------------------------------------------ joins


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j01_left_one_to_one(spark, d):
    from ..sources.metadata import join_metadata

    both = join_metadata(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), {"doc_id": "doc_id"}, one_to_one=True)
    return both.select("doc_id", "source", "quality", "toxic")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def j02_left_many_to_one(spark, d):
    from ..sources.metadata import join_metadata

    return join_metadata(table(spark, d, "orders"), table(spark, d, "customer"), {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name", "c_mktsegment")


SEVERAL = "SELECT file_sha256 FROM {} GROUP BY 1 HAVING count(DISTINCT coalesce({}, '<NA>')) > 1"


@query(f"SELECT sample_id, file_sha256, label FROM {L} WHERE file_sha256 IN ({SEVERAL.format(L, 'label')})")
def j03_conflict_rows(spark, d):
    rows = candidates(spark, d)
    return rows.join(C.keys_with_several(rows, "file_sha256", "label"), "file_sha256", "left_semi").select("sample_id", "file_sha256", "label")


@query(f"SELECT sample_id FROM {M} WHERE file_sha256 IN (SELECT file_sha256 FROM {M} GROUP BY 1 HAVING count(*) > 1)")
def j04_semi(spark, d):
    rows = manifest(spark, d)
    return rows.join(C.repeated(rows, "file_sha256"), "file_sha256", "left_semi").select("sample_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j05_anti(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""SELECT coalesce(a.feature, b.feature) AS feature, a.feature IS NOT NULL AS in_left, b.feature IS NOT NULL AS in_right
    FROM (SELECT DISTINCT p_brand AS feature FROM part WHERE p_partkey % 2 = 0) a FULL JOIN (SELECT DISTINCT p_brand AS feature FROM part WHERE p_size > 48) b ON a.feature = b.feature""")
def j06_schema_intersection(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_brand", "feature")
    return X.feature_availability(p.filter("p_partkey % 2 = 0"), p.filter("p_size > 48"))


@query(f"SELECT speaker_id, count(DISTINCT base) AS parts FROM {M} GROUP BY 1 HAVING count(DISTINCT base) > 1")
def j07_group_overlap(spark, d):
    return S.shared_groups(manifest(spark, d), "speaker_id", "base")


@query("SELECT d.doc_id, CASE l.quality WHEN 0 THEN 1 ELSE 0 END AS target, d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
def j08_attach_labels(spark, d):
    l = table(spark, d, "labels").filter("quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).cast("int").alias("target"))
    return l.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")


# ------------------------------------------------------------------ aggregates


@query(f"SELECT file_sha256, count(DISTINCT coalesce(label, '<NA>')) AS n_label, count(DISTINCT coalesce(speaker_id, '<NA>')) AS n_speaker_id FROM {M} GROUP BY 1 HAVING count(DISTINCT coalesce(label, '<NA>')) > 1 OR count(DISTINCT coalesce(speaker_id, '<NA>')) > 1")
def a01_distinct_with_null(spark, d):
    return C.keys_with_several(manifest(spark, d), "file_sha256", "label", "speaker_id")


@query(f"SELECT vowel, count(DISTINCT speaker_id) AS speakers, count(DISTINCT pathology) AS pathologies FROM {M} GROUP BY 1")
def a02_distinct(spark, d):
    return manifest(spark, d).groupBy("vowel").agg(F.count_distinct("speaker_id").alias("speakers"), F.count_distinct("pathology").alias("pathologies"))


CANONICAL = f"SELECT *, row_number() OVER (PARTITION BY file_sha256 ORDER BY {{}}) AS rn FROM {M}"


@query(f"""SELECT 'd2_' || recording_id || '_' || vowel || '_' || "condition" AS sample_id, file_sha256, c.sample_id AS source_sample_id, pathology_group, pathology_group_key, pathology, source_count, source_count > 1 AS is_consolidated_duplicate, source_sample_ids
    FROM (SELECT file_sha256, recording_id, vowel, "condition", sample_id FROM ({CANONICAL.format('pathology_group_key, relative_path, sample_id')}) WHERE rn = 1) c
    JOIN (SELECT file_sha256, {agg_joined('pathology_group')} AS pathology_group, {agg_joined('pathology_group_key')} AS pathology_group_key, {agg_joined('pathology')} AS pathology, {agg_joined('sample_id')} AS source_sample_ids, count(*) AS source_count FROM {M} GROUP BY 1) g USING (file_sha256)""")
def a03_consolidate_groups(spark, d):
    out = C.consolidate_groups(manifest(spark, d))
    return out.select("sample_id", "file_sha256", "source_sample_id", "pathology_group", "pathology_group_key", "pathology", "source_count", "is_consolidated_duplicate", "source_sample_ids")


DIFFERS = ("age", "base", "condition", "doc_id", "label", "n_chars", "pathology", "pathology_group", "pathology_group_key", "recording_id", "samplerate", "sex", "toxic", "vowel", "audio_read_status", "duration")


def differs(c: str) -> str:
    return f"""count(DISTINCT coalesce(CAST("{c}" AS VARCHAR), '<NA>')) > 1"""


@query(f"""SELECT 'd1_' || substr(file_sha256, 1, 16) AS sample_id, file_sha256, CASE WHEN NOT age_differs THEN age END AS age, CASE WHEN NOT sex_differs THEN sex END AS sex, pathology, source_count, metadata_conflict_columns, c.sample_id AS source_sample_id
    FROM (SELECT file_sha256, age, sex, sample_id FROM ({CANONICAL.format('relative_path, sample_id')}) WHERE rn = 1) c
    JOIN (SELECT file_sha256, {agg_joined('pathology')} AS pathology, count(*) AS source_count, {differs('age')} AS age_differs, {differs('sex')} AS sex_differs,
          list_aggregate(list_filter([{', '.join(f"CASE WHEN {differs(c)} THEN '{c}' END" for c in sorted(DIFFERS))}], lambda x: x IS NOT NULL), 'string_agg', ' | ') AS conflicts FROM {M} GROUP BY 1) g USING (file_sha256),
    LATERAL (SELECT coalesce(conflicts, '') AS metadata_conflict_columns)""")
def a04_consolidate_hashes(spark, d):
    return C.consolidate_hashes(manifest(spark, d)).select("sample_id", "file_sha256", "age", "sex", "pathology", "source_count", "metadata_conflict_columns", "source_sample_id")


@query(f"SELECT file_sha256, {agg_joined('speaker_id')} AS speakers FROM {M} GROUP BY 1")
def a05_join_distinct(spark, d):
    return manifest(spark, d).groupBy("file_sha256").agg(T.join_distinct(F.col("speaker_id")).alias("speakers"))


@query(f"SELECT sample_id, 'd1_' || substr(file_sha256, 1, 16) AS canonical_sample_id, n AS group_size, rn = 1 AS is_canonical_source FROM (SELECT *, count(*) OVER (PARTITION BY file_sha256) AS n FROM ({CANONICAL.format('relative_path, sample_id')})) WHERE n > 1")
def a06_duplicate_audit(spark, d):
    rows = manifest(spark, d)
    return C.duplicate_audit(rows, C.consolidate_hashes(rows)).select("sample_id", "canonical_sample_id", "group_size", "is_canonical_source")


@query(f"""SELECT count(*) AS input_rows, count_if(label IS NULL) AS excluded_rows, count_if(label IS NOT NULL) AS candidate_rows, count(DISTINCT speaker_id) FILTER (label IS NOT NULL) AS unique_speakers,
    count_if(label = 'healthy') AS healthy, count_if(label = 'pathological') AS pathological, count(DISTINCT file_sha256) FILTER (label IS NOT NULL) AS training_rows FROM {M}""")
def a07_summary(spark, d):
    rows = manifest(spark, d)
    kept = F.col("label").isNotNull()
    return rows.agg(
        F.count("*").alias("input_rows"), F.count_if(~kept).alias("excluded_rows"), F.count_if(kept).alias("candidate_rows"), F.count_distinct(F.when(kept, F.col("speaker_id"))).alias("unique_speakers"),
        F.count_if(F.col("label") == "healthy").alias("healthy"), F.count_if(F.col("label") == "pathological").alias("pathological"), F.count_distinct(F.when(kept, F.col("file_sha256"))).alias("training_rows"),
    )


@query(f"""SELECT base AS database, cohort AS label, count(*) AS n_samples, count(DISTINCT speaker_id) AS n_speakers, count(age) AS age_available, count_if(age IS NULL) AS age_missing, round(avg(age), 6) AS age_mean,
    round(stddev_samp(age), 6) AS age_std, median(age) AS age_median, min(age) AS age_min, max(age) AS age_max, count_if(sex = 'female') AS female_samples, count_if(sex = 'male') AS male_samples, count_if(sex IS NULL) AS sex_missing_or_other
    FROM (SELECT *, unnest(['all', label]) AS cohort FROM {L}) GROUP BY 1, 2""")
def a08_demographics(spark, d):
    out = R.demographics(candidates(spark, d))
    return out.withColumns({"age_mean": r6("age_mean"), "age_std": r6("age_std")})


@query(f"SELECT base AS database, label, coalesce(pathology, 'missing') AS pathology_report, count(*) AS n_samples, count(DISTINCT speaker_id) AS n_speakers FROM {L} GROUP BY 1, 2, 3")
def a09_pathologies(spark, d):
    return R.pathology_distribution(candidates(spark, d))


@query(f"""SELECT speaker_id, count(*) AS n_samples, string_agg(DISTINCT label, '|' ORDER BY label) AS labels, count_if(label = 'pathological') AS n_pathological, count_if(label = 'healthy') AS n_healthy
    FROM {M} GROUP BY 1 HAVING count(DISTINCT label) > 1""")
def a10_mixed_groups(spark, d):
    return R.mixed_groups(manifest(spark, d), "speaker_id")


@query(f"SELECT pathology, count(*) AS n FROM {M} GROUP BY 1")
def a11_value_counts(spark, d):
    return R.value_counts(manifest(spark, d), "pathology")


@query(f"SELECT v AS vowel, coalesce(n / (SELECT count(*) FROM {M})::DOUBLE, 0) AS share FROM (VALUES ('en'), ('de'), ('xx')) t(v) LEFT JOIN (SELECT vowel, count(*) AS n FROM {M} GROUP BY 1) c ON c.vowel = v")
def a12_shares(spark, d):
    return R.shares(manifest(spark, d), "vowel", ("en", "de", "xx"))


@query(f"SELECT vowel, count_if(label = 'healthy') AS healthy, count_if(label = 'pathological') AS pathological FROM {M} GROUP BY 1")
def a13_crosstab(spark, d):
    return R.crosstab(manifest(spark, d), "vowel", "label", ("healthy", "pathological"))


@query("""SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, min(c_acctbal) AS least, round(quantile_cont(c_acctbal, 0.25), 6) AS q25,
    round(quantile_cont(c_acctbal, 0.5), 6) AS q50, round(quantile_cont(c_acctbal, 0.75), 6) AS q75, max(c_acctbal) AS most FROM customer GROUP BY 1""")
def a14_describe(spark, d):
    out = R.describe(table(spark, d, "customer"), "c_acctbal", ("c_mktsegment",))
    return out.withColumns({c: r6(c) for c in ("mean", "std", "q25", "q50", "q75")})


@query("SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
def a15_distinct_then_count(spark, d):
    return R.distinct_then_count(table(spark, d, "events"), "user_id", "event_type")


@query("SELECT o_orderpriority, median(o_totalprice) AS median, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def a16_group_median(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("median"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("""SELECT CAST(least(floor((v - lo) / (hi - lo) * 30), 29) AS BIGINT) AS bin, count(*) AS n FROM (SELECT n_chars / 1000.0::DOUBLE AS v FROM documents), (SELECT min(n_chars / 1000.0::DOUBLE) AS lo, max(n_chars / 1000.0::DOUBLE) AS hi FROM documents) GROUP BY 1""")
def a17_histogram(spark, d):
    return R.histogram(table(spark, d, "documents").select((F.col("n_chars") / 1000.0).alias("v")), "v", 30)


CURVE = "SELECT percentile / 100.0::DOUBLE AS train_fraction, n_features AS n_train, mean_score + gap AS train_score, mean_score AS valid_score FROM ({})"


@query(f"""SELECT train_fraction, round(avg(n_train), 6) AS n_train_mean, round(avg(train_score), 6) AS train_mean, round(stddev_samp(train_score), 6) AS train_std, round(avg(valid_score), 6) AS valid_mean, round(stddev_samp(valid_score), 6) AS valid_std,
    round(avg(train_score - valid_score), 6) AS gap_mean FROM ({CURVE.format(CV_DUCK)}) GROUP BY 1""")
def a18_learning_curve(spark, d):
    points = cv_results(spark, d).select((F.col("percentile") / 100.0).alias("train_fraction"), F.col("n_features").alias("n_train"), (F.col("mean_score") + F.col("gap")).alias("train_score"), F.col("mean_score").alias("valid_score"))
    out = R.learning_curve(points)
    return out.select("train_fraction", *[r6(c).alias(c) for c in out.columns[1:]])


@query(f"""SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS least, max(value) AS most, count(value) AS n
    FROM (UNPIVOT (SELECT mean_score, std_score, gap FROM ({CV_DUCK})) ON mean_score, std_score, gap INTO NAME metric VALUE value) GROUP BY 1""")
def a19_metric_summary(spark, d):
    out = R.metric_summary(cv_results(spark, d), ("mean_score", "std_score", "gap"))
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


@query(f"SELECT scenario, model, percentile, count(*) AS n, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS share FROM ({CV_DUCK}) GROUP BY 1, 2, 3")
def a20_selection_stability(spark, d):
    return R.selection_stability(cv_results(spark, d), "scenario", "model", "percentile").withColumn("share", r6("share"))


@query(f"SELECT speaker_id, string_agg(DISTINCT label, '|' ORDER BY label) AS strata, count(*) AS n FROM {L} GROUP BY 1")
def a22_group_strata(spark, d):
    return S.group_strata(candidates(spark, d), "speaker_id", "label")


@query("SELECT doc_id, round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY quality)), 6)::DOUBLE AS weight FROM labels")
def a23_class_weights(spark, d):
    l = table(spark, d, "labels")
    weights = X.class_weights(l.withColumnRenamed("quality", "target"))
    return l.join(F.broadcast(weights), l["quality"] == weights["target"]).select("doc_id", r6("weight").alias("weight"))  # a row a class


# ------------------------------------------------------------------ windows


@query(f"SELECT sample_id FROM ({CANONICAL.format('relative_path, sample_id')}) WHERE rn = 1")
def w01_first_row(spark, d):
    return C.first_of(manifest(spark, d), ("file_sha256",), ("relative_path", "sample_id")).select("sample_id")


@query(f"SELECT candidate, row_number() OVER (ORDER BY mean_score DESC NULLS LAST, candidate) AS rank FROM ({CV_DUCK})")
def w02_rank_first(spark, d):
    from ..operators.selection import ranked

    return ranked(cv_results(spark, d)).select("candidate", "rank")


@query("SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM orders")
def w03_group_transform(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.max("o_totalprice").over(Window.partitionBy("o_custkey")).alias("most"))


@query(f"SELECT user_id, min(pos) AS pos FROM (SELECT user_id, pos, sum(v * v) OVER (PARTITION BY user_id ORDER BY pos) AS run, sum(v * v) OVER (PARTITION BY user_id) AS total FROM ({SIGNAL_SQL})) WHERE run >= 0.5 * total GROUP BY 1")
def w04_first_crossing(spark, d):
    e = table(spark, d, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    order = Window.partitionBy("user_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    square = F.col("value") * F.col("value")
    run = e.withColumns({"run": F.sum(square).over(order), "total": F.sum(square).over(Window.partitionBy("user_id"))})
    return run.filter("run >= 0.5 * total").groupBy("user_id").agg(F.min("pos").cast("long").alias("pos"))


@query("SELECT event_id, round(value - 0.97 * lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS y FROM events")
def w05_difference(spark, d):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", r6(F.col("value") - 0.97 * before).alias("y"))


@query(f"SELECT sample_id FROM (SELECT sample_id, count(*) OVER (PARTITION BY file_sha256) AS n FROM {M}) WHERE n > 1")
def w06_duplicated(spark, d):
    return manifest(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("file_sha256"))).filter("n > 1").select("sample_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def w07_drop_exact_duplicates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return C.first_of(rows, ("h", "lang"), ("doc_id",)).select("doc_id")


@query("""SELECT y_score, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM (SELECT CAST(d.n_chars AS DOUBLE) AS y_score, sum(l.quality)::BIGINT AS p, sum(1 - l.quality)::BIGINT AS n
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY y_score DESC)""")
def w08_curve_points(spark, d):
    from ..operators.metrics import score_steps

    return score_steps(predictions(spark, d)).select("y_score", "tp", "fp")


# ------------------------------------------------------------------ order and top-k


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_type DESC, p_partkey) AS place FROM part")
def t01_total_order(spark, d):
    return R.numbered(table(spark, d, "part"), "p_brand", F.desc("p_type"), "p_partkey").select("p_partkey", "place")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 30")
def t02_head(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(30)


@query(f"SELECT speaker_id, count(*) AS n FROM {M} GROUP BY 1 ORDER BY n DESC, speaker_id LIMIT 15")
def t03_top_k(spark, d):
    return R.top_k(manifest(spark, d), "speaker_id", 15)


@query("""SELECT vec_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM (
      SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS rn FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, abs(unnest(embedding)) AS v FROM embeddings) WHERE pos >= 8) WHERE rn <= 30 GROUP BY 1""")
def t04_top_bins(spark, d):
    from ..functions.signal import strongest

    e = table(spark, d, "embeddings")
    pairs = F.transform("embedding", lambda x, i: F.struct(i.cast("double").alias("freq"), F.abs(x).cast("double").alias("amp")))
    top = strongest(pairs, 30, 8.0)
    return e.select("vec_id", F.array_join(F.transform(F.filter(top, lambda p: p["freq"].isNotNull()), lambda p: p["freq"].cast("int").cast("string")), ",").alias("positions"))


@query(f"SELECT scenario, arg_min(candidate, struct_pack(a := std_score, b := -mean_score, c := candidate)) AS candidate FROM ({CV_DUCK}) GROUP BY 1")
def t05_composite_argmin(spark, d):
    return cv_results(spark, d).groupBy("scenario").agg(F.min_by("candidate", F.struct("std_score", (-F.col("mean_score")).alias("b"), "candidate")).alias("candidate"))


# ------------------------------------------------------------------ set operations


@query("SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def u01_union_all(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return n.unionByName(table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def u02_aligned_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query(f"SELECT DISTINCT vowel, label FROM {M}")
def u03_distinct(spark, d):
    return manifest(spark, d).select("vowel", "label").dropDuplicates(["vowel", "label"])


@query("SELECT o_custkey AS k, 'both' AS side FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT c_custkey, 'no order' FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def u04_difference(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return o.intersect(c.filter("k % 2 = 0")).withColumn("side", F.lit("both")).unionByName(c.subtract(o).withColumn("side", F.lit("no order")))


# ------------------------------------------------------------------ constraints: rows that violate them


@query(f"SELECT recording_id, count(*) AS n FROM {M} GROUP BY 1 HAVING count(*) > 1")
def c01_manifest_contract(spark, d):
    return C.repeated(manifest(spark, d), "recording_id")


@query(f"SELECT DISTINCT coalesce(lower(trim(label)), '<NA>') AS label FROM {M} WHERE label IS NULL OR lower(trim(label)) NOT IN ('healthy', 'other')")
def c02_label_contract(spark, d):
    low = F.lower(F.trim("label"))
    return manifest(spark, d).filter(F.coalesce(~low.isin("healthy", "other"), F.lit(True))).select(F.coalesce(low, F.lit("<NA>")).alias("label")).distinct()


@query(f"""SELECT file_sha256 FROM {M} GROUP BY 1 HAVING count(DISTINCT recording_id || '|' || vowel || '|' || "condition") > 1 OR count(DISTINCT coalesce(label, '<NA>')) > 1 OR count(DISTINCT coalesce(speaker_id, '<NA>')) > 1""")
def c03_hash_relations(spark, d):
    rows = manifest(spark, d).withColumn("acoustic_key", F.concat_ws("|", "recording_id", "vowel", "condition"))
    return C.keys_with_several(rows, "file_sha256", "acoustic_key", "label", "speaker_id").select("file_sha256")


@query(SEVERAL.format(L, "label"))
def c04_hash_labels(spark, d):
    return C.keys_with_several(candidates(spark, d), "file_sha256", "label").select("file_sha256")


@query(f"SELECT key, count(*) AS n FROM (SELECT recording_id || '_' || vowel AS key FROM {M}) GROUP BY 1 HAVING count(*) > 1")
def c05_curated(spark, d):
    return C.repeated(manifest(spark, d).select(F.concat_ws("_", "recording_id", "vowel").alias("key")), "key")


@query(f"SELECT pathology_group_key, label, count(*) AS n FROM {L} GROUP BY 1, 2 HAVING count(*) > 1")
def c06_composite_key(spark, d):
    return C.repeated(candidates(spark, d), "pathology_group_key", "label")


@query(f"SELECT count(*) AS n_rows, count(DISTINCT sample_id) AS n_ids FROM {M} WHERE label IS NULL")
def c07_one_reason(spark, d):
    gone = C.split(C.audited(manifest(spark, d), [C.missing_rule("label")]))[1]
    return gone.agg(F.count("*").alias("n_rows"), F.count_distinct("sample_id").alias("n_ids"))


@query(f"SELECT base, count_if(age IS NULL) AS without_age, count_if(age < 18) AS young FROM {M} GROUP BY 1")
def c08_adults(spark, d):
    return manifest(spark, d).groupBy("base").agg(F.count_if(F.col("age").isNull()).alias("without_age"), F.count_if(F.col("age") < 18).alias("young"))


@query("SELECT (SELECT count(*) FROM documents) AS rows_in, count(*) AS rows_out, count(DISTINCT doc_id) AS ids FROM documents")
def c09_row_count(spark, d):
    docs = table(spark, d, "documents")
    return docs.agg(F.count("*").alias("rows_in"), F.count("*").alias("rows_out"), F.count_distinct("doc_id").alias("ids"))


@query(f"SELECT base AS part, count(DISTINCT label) AS labels, count(DISTINCT vowel) AS strata FROM {L} GROUP BY 1")
def c10_split_contract(spark, d):
    return candidates(spark, d).groupBy(F.col("base").alias("part")).agg(F.count_distinct("label").alias("labels"), F.count_distinct("vowel").alias("strata"))
