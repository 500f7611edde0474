"""Queries for scans, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as G
from ..functions import text as T
from ..operators import cohort as C
from ..operators import reports as R
from ..views import MANIFEST_SQL, manifest, table
from .registry import query

M = f"({MANIFEST_SQL}) m"


def norm(c: str) -> str:
    return f"regexp_replace(regexp_replace(strip_accents(lower(trim(coalesce({c}, '')))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def stem(c: str) -> str:
    return f"regexp_replace(string_split({c}, '/')[-1], '(.)\\.[^.]*$', '\\1')"


@query(f"SELECT doc_id, md5({norm('text')}) AS key FROM documents")
def p01_normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("key"))


@query("SELECT p_partkey, regexp_replace(trim(coalesce(concat(' ', p_size, CASE WHEN p_partkey % 2 = 0 THEN '.0 ' ELSE ' ' END), '')), '\\.0$', '') AS recording_id FROM part")
def p02_recording_id(spark, d):
    raw = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".0 ").otherwise(" "))
    return table(spark, d, "part").select("p_partkey", T.normalize_recording_id(raw).alias("recording_id"))


@query(f"SELECT sample_id, {norm(stem('relative_path'))} AS file_key FROM {M}")
def p03_filename_key(spark, d):
    return manifest(spark, d).select("sample_id", T.normalize_filename_key(F.col("relative_path")).alias("file_key"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def p04_slugify(spark, d):
    return table(spark, d, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


@query(f"SELECT doc_id, 'd1_' || {norm(chr(39).join(['regexp_replace(relative_path, ', '(.)\\.[^./]*$', ', ', '\\1', ')']))} AS sample_id FROM {M}")
def p05_sample_id(spark, d):
    return manifest(spark, d).select("doc_id", T.sample_id("d1", F.col("relative_path")).alias("sample_id"))


@query(f"""SELECT doc_id, 'd2_' || recording_id || '_' || vowel || '_' || "condition" AS key_id, 'd1_' || substr(file_sha256, 1, 16) AS hash_id FROM {M}""")
def p06_canonical_id(spark, d):
    m = manifest(spark, d)
    return m.select("doc_id", T.canonical_id_of_key("d2", F.col("recording_id"), F.col("vowel"), F.col("condition")).alias("key_id"), T.canonical_id_of_hash("d1", F.col("file_sha256")).alias("hash_id"))


@query(f"""SELECT sample_id, CASE WHEN regexp_matches(p, 'pathol|patolog') THEN 'pathological' WHEN regexp_matches(p, 'normal|healthy') THEN 'healthy' END AS path_label
    FROM (SELECT sample_id, {norm('relative_path')} AS p FROM {M})""")
def p07_label_from_path(spark, d):
    return manifest(spark, d).select("sample_id", T.label_from_path(F.col("relative_path")).alias("path_label"))


@query("SELECT c_custkey, CASE WHEN lower(c_mktsegment) IN ('building', 'machinery') THEN 'healthy' ELSE 'pathological' END AS label FROM customer")
def p08_label_from_group(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.label_from_group(F.lower("c_mktsegment"), ("building", "machinery")).alias("label"))


@query(f"""SELECT sample_id, regexp_extract(n, '^([0-9]+)-([aiu])_(h|lhl|l|n)\\.nsp$', 1) AS recording, regexp_extract(n, '^([0-9]+)-([aiu])_(h|lhl|l|n)\\.nsp$', 2) AS vowel_read,
           regexp_extract(n, '^([0-9]+)-([aiu])_(h|lhl|l|n)\\.nsp$', 3) AS condition_read
    FROM (SELECT sample_id, lower(string_split(relative_path, '/')[-1]) AS n FROM {M}) WHERE regexp_matches(n, '^([0-9]+)-([aiu])_(h|lhl|l|n)\\.nsp$')""")
def p09_parse_filename(spark, d):
    parsed = manifest(spark, d).select("sample_id", T.parse_vowel_filename(T.file_name(F.col("relative_path"))).alias("f")).filter("f IS NOT NULL")
    return parsed.select("sample_id", F.col("f.recording_id").alias("recording"), F.col("f.vowel").alias("vowel_read"), F.col("f.condition").alias("condition_read"))


@query("SELECT n_nationkey AS recording_id, n_name AS speaker_id, n_regionkey AS sex FROM nation")
def p10_rename(spark, d):
    return table(spark, d, "nation").withColumnsRenamed({"n_nationkey": "recording_id", "n_name": "speaker_id", "n_regionkey": "sex"})


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS n FROM events")
def p11_to_number(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", T.to_number(raw).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN round(floor(q) / 10 + CASE WHEN q - floor(q) > 0.5 OR (q - floor(q) = 0.5 AND floor(q) % 2 = 1) THEN 0.1 ELSE 0 END, 1) END AS age
    FROM (SELECT o_orderkey, 10 * datediff('day', DATE '1960-01-15', CAST(o_orderdate AS DATE)) / 365.2425::DOUBLE AS q FROM orders)""")
def p12_age(spark, d):
    born = F.when(F.col("o_orderkey") % 5 == 0, "no date").otherwise("1960-01-15")
    return table(spark, d, "orders").select("o_orderkey", T.age_at(F.date_format("o_orderdate", "yyyy-MM-dd"), born).alias("age"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'male' WHEN 'R' THEN 'female' ELSE l_returnflag END AS sex_1,
           CASE lower(l_linestatus) WHEN 'o' THEN 'male' WHEN 'f' THEN 'female' ELSE l_linestatus END AS sex_2 FROM lineitem""")
def p13_recode_sex(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", T.recode(F.col("l_returnflag"), {"A": "male", "R": "female"}).alias("sex_1"), T.recode(F.col("l_linestatus"), {"o": "male", "f": "female"}, ignore_case=True).alias("sex_2")
    )


@query(f"SELECT sample_id, (speaker_id IS NULL OR trim(speaker_id) = '') AS missing FROM {M}")
def p14_missing(spark, d):
    return manifest(spark, d).select("sample_id", T.missing(F.col("speaker_id")).alias("missing"))


@query(f"SELECT sample_id, 'pathology=' || coalesce(pathology, '<NA>') AS detail FROM {M}")
def p15_observed(spark, d):
    return manifest(spark, d).select("sample_id", T.observed("pathology", F.col("pathology")).alias("detail"))


@query(f"SELECT sample_id, 'age=' || CAST(age AS VARCHAR) || '; minimum_age=18' AS detail FROM {M}")
def p16_threshold_detail(spark, d):
    return manifest(spark, d).select("sample_id", T.below("age", F.col("age"), 18.0).alias("detail"))


@query(f"SELECT sample_id, coalesce(pathology, pathology_group) AS pathology FROM {M}")
def p17_coalesce(spark, d):
    return manifest(spark, d).select("sample_id", F.coalesce("pathology", "pathology_group").alias("pathology"))


@query(f"SELECT sample_id, CASE label WHEN 'pathological' THEN 1 WHEN 'healthy' THEN 0 END AS target FROM {M}")
def p18_target(spark, d):
    return manifest(spark, d).select("sample_id", T.binary_target(F.col("label")).alias("target"))


@query(f"SELECT sample_id, base || '::target=' || CASE label WHEN 'pathological' THEN '1' ELSE '0' END AS stratum FROM {M} WHERE label IS NOT NULL")
def p19_stratum(spark, d):
    return manifest(spark, d).filter("label IS NOT NULL").select("sample_id", T.stratum_key(F.col("base"), T.binary_target(F.col("label"))).alias("stratum"))


@query(f"SELECT sample_id, base || '::' || speaker_id AS pooled FROM {M}")
def p20_pooled_group(spark, d):
    return manifest(spark, d).select("sample_id", T.pooled_group(F.col("base"), F.col("speaker_id")).alias("pooled"))


@query(f"SELECT sample_id, sample_id AS speaker_id, 'assumed_unique_acoustic_sample' AS speaker_id_source, 'a' AS vowel FROM {M}")
def p23_literals(spark, d):
    return manifest(spark, d).select("sample_id").withColumns({"speaker_id": F.col("sample_id"), "speaker_id_source": F.lit("assumed_unique_acoustic_sample"), "vowel": F.lit("a")})


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 > 1 THEN c_acctbal END AS n FROM customer")
def p24_safe_float(spark, d):
    raw = F.when(F.col("c_custkey") % 7 == 0, "inf").when(F.col("c_custkey") % 7 == 1, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, d, "customer").select("c_custkey", T.safe_float(raw).alias("n"))


@query("SELECT doc_id, sha256(text) AS file_sha256 FROM documents")
def p25_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_sha256"))


@query("SELECT vec_id, CASE WHEN label > 0 THEN len(embedding) / (label * 8.0::DOUBLE) ELSE 0 END AS duration FROM embeddings")
def p26_duration(spark, d):
    return table(spark, d, "embeddings").select("vec_id", G.duration(F.col("embedding"), F.col("label") * 8.0).alias("duration"))


# ------------------------------------------------------------------ scans


@query("SELECT event_id, CAST(event_id % 60000 - 30000 AS DOUBLE) / 32768 AS x FROM events")
def s06_pcm_scaling(spark, d):
    samples = F.array((F.col("event_id") % 60000 - 30000).cast("int"))
    return table(spark, d, "events").select("event_id", G.pcm_to_float(samples)[0].cast("double").alias("x"))


@query("""SELECT page_id, CASE WHEN url IS NULL THEN 'missing' WHEN lower(regexp_extract(url, '\\.([a-z0-9]+)$', 1)) = 'html' THEN 'ok' ELSE 'unsupported' END AS status FROM pages""")
def s07_validate_file(spark, d):
    suffix = F.lower(F.regexp_extract("url", "\\.([a-z0-9]+)$", 1))
    return table(spark, d, "pages").select("page_id", F.when(F.col("url").isNull(), "missing").when(suffix == "html", "ok").otherwise("unsupported").alias("status"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS recording_id, c_name AS speaker_id, CASE c_nationkey % 2 WHEN 0 THEN 'male' ELSE 'female' END AS sex, c_mktsegment AS pathology FROM customer""")
def s11_metadata_rows(spark, d):
    from ..sources.metadata import typed_metadata

    raw = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("AufnahmeID"), F.col("c_name").alias("SprecherID"), F.when(F.col("c_nationkey") % 2 == 0, "m").otherwise("w").alias("Geschlecht"), F.col("c_mktsegment").alias("Pathologien")
    )
    return typed_metadata(raw).select("recording_id", "speaker_id", "sex", "pathology")


@query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def s12_parquet_scan(spark, d):
    return table(spark, d, "embeddings").filter("label = 3").select("vec_id", "label")


@query("SELECT p_partkey % 3 AS repeat, p_partkey % 5 AS fold, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def s13_checkpoint_duplicates(spark, d):
    folds = table(spark, d, "part").select((F.col("p_partkey") % 3).alias("repeat"), (F.col("p_partkey") % 5).alias("fold"))
    return C.repeated(folds, "repeat", "fold")


@query(f"SELECT sample_id, base, relative_path AS filepath, nullif(trim(speaker_id), '') AS speaker_id, age, duration FROM {M}")
def s16_row_to_sample(spark, d):
    from ..sources.samples import typed_samples

    return typed_samples(manifest(spark, d).withColumn("filepath", F.col("relative_path"))).select("sample_id", "base", "filepath", "speaker_id", "age", "duration")


# ------------------------------------------------------------------ filters

RULES_SQL = f"""
    SELECT *, CASE WHEN NOT coalesce(lower(trim(audio_read_status)) = 'ok', false) THEN 'audio_read_error'
                   WHEN vowel NOT IN ('en', 'de', 'fr') THEN 'vowel_not_selected'
                   WHEN "condition" <> 'n' THEN 'condition_not_selected'
                   WHEN label IS NULL OR trim(label) = '' THEN 'missing_label'
                   WHEN speaker_id IS NULL OR trim(speaker_id) = '' THEN 'missing_speaker_id'
                   WHEN age IS NULL THEN 'missing_age' WHEN age < 18 THEN 'age_below_minimum'
                   WHEN duration IS NULL THEN 'missing_duration' WHEN duration < 0.5 THEN 'duration_below_minimum' END AS exclusion_reason
    FROM {M}"""
CONFIG = C.CohortConfig(vowels=("en", "de", "fr"), conditions=("n",))


def audit(spark, d):
    return C.audited(manifest(spark, d), C.rules(CONFIG))


@query(f"SELECT sample_id, exclusion_reason FROM ({RULES_SQL})")
def f01_audited_cohort(spark, d):
    return audit(spark, d).select("sample_id", "exclusion_reason")


@query(f"SELECT sample_id, 'audio_read_status=' || coalesce(audio_read_status, '<NA>') AS exclusion_detail FROM ({RULES_SQL}) WHERE exclusion_reason = 'audio_read_error'")
def f02_audio_status(spark, d):
    return C.split(audit(spark, d))[1].filter("exclusion_reason = 'audio_read_error'").select("sample_id", "exclusion_detail")


@query(f"SELECT exclusion_reason, count(*) AS n FROM ({RULES_SQL}) WHERE exclusion_reason LIKE 'missing_%' GROUP BY 1")
def f03_missing_values(spark, d):
    return C.split(audit(spark, d))[1].filter("exclusion_reason LIKE 'missing\\_%'").groupBy("exclusion_reason").agg(F.count("*").alias("n"))


@query(f"SELECT sample_id, 'age=' || CAST(age AS VARCHAR) || '; minimum_age=18' AS exclusion_detail FROM ({RULES_SQL}) WHERE exclusion_reason = 'age_below_minimum'")
def f04_age(spark, d):
    return C.split(audit(spark, d))[1].filter("exclusion_reason = 'age_below_minimum'").select("sample_id", "exclusion_detail")


@query(f"SELECT sample_id, 'duration=' || CAST(duration AS VARCHAR) || '; minimum_duration=0.5' AS exclusion_detail FROM ({RULES_SQL}) WHERE exclusion_reason = 'duration_below_minimum'")
def f05_duration(spark, d):
    return C.split(audit(spark, d))[1].filter("exclusion_reason = 'duration_below_minimum'").select("sample_id", "exclusion_detail")


@query(f"SELECT sample_id, exclusion_reason FROM ({RULES_SQL}) WHERE exclusion_reason IN ('vowel_not_selected', 'condition_not_selected')")
def f06_membership(spark, d):
    return C.split(audit(spark, d))[1].filter(F.col("exclusion_reason").isin("vowel_not_selected", "condition_not_selected")).select("sample_id", "exclusion_reason")


@query(f"""SELECT sample_id, 'ages=' || detail AS exclusion_detail FROM {M} JOIN (
      SELECT file_sha256, string_agg(CAST(age AS VARCHAR), ' | ' ORDER BY age) AS detail FROM (SELECT DISTINCT file_sha256, age FROM {M} WHERE age IS NOT NULL) GROUP BY 1 HAVING count(*) > 1) USING (file_sha256)""")
def f07_conflicting_age(spark, d):
    return C.with_conflicting_ages(manifest(spark, d)).filter("exclusion_reason IS NOT NULL").select("sample_id", "exclusion_detail")


@query(f"SELECT sample_id, label FROM {M} WHERE lower(trim(audio_read_status)) = 'ok' AND label IS NOT NULL")
def f08_modeling_rows(spark, d):
    return manifest(spark, d).filter((F.lower(F.trim("audio_read_status")) == "ok") & F.col("label").isNotNull()).select("sample_id", "label")


@query(f"SELECT coalesce(exclusion_reason, 'kept') AS reason, count(*) AS n FROM ({RULES_SQL}) GROUP BY 1")
def f09_rule_order(spark, d):
    return audit(spark, d).groupBy(F.coalesce("exclusion_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(lower(trim(audio_read_status)) = 'ok', false) THEN 'audio_read_error' WHEN label IS NULL THEN 'missing_label'
      WHEN trim(speaker_id) = '' THEN 'missing_speaker_id' WHEN age IS NULL THEN 'missing_age' WHEN age < 18 THEN 'age_below_minimum' WHEN duration < 0.5 THEN 'duration_below_minimum' ELSE 'kept' END AS reason FROM {M}) GROUP BY 1""")
def f10_rule_order_by_hash(spark, d):
    rows = C.audited(manifest(spark, d), C.rules(C.CohortConfig()))
    return rows.groupBy(F.coalesce("exclusion_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT sample_id, label, toxic FROM {M} WHERE label IS NOT NULL AND toxic IS NOT NULL")
def f11_dropna(spark, d):
    return manifest(spark, d).select("sample_id", "label", "toxic").dropna(how="all", subset=["label", "toxic"]).dropna(subset=["label", "toxic"])


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'part 1')")
def f12_contains(spark, d):
    return table(spark, d, "part").filter(F.lower("p_name").contains("part 1")).select("p_partkey")


@query("SELECT '.' || regexp_extract(url, '\\.([a-z]+)$', 1) AS extension, 'other' AS kind, count(*) AS n FROM pages WHERE regexp_matches(url, '\\.html$') GROUP BY 1")
def s02_file_report(spark, d):
    return R.file_report(table(spark, d, "pages").filter(F.col("url").rlike("\\.html$")), F.col("url"))
