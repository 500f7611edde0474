import pytest
from pyspark.sql import functions as F

from tessitura.operators import cohort as C

D2 = "sample_id string, base string, filepath string, relative_path string, recording_id string, speaker_id string, label string, vowel string, condition string, pathology_group string, pathology_group_key string, pathology string, audio_read_status string, age double, duration double, file_sha256 string"


def row(i, **k):
    out = dict(sample_id=f"s{i}", base="D2", filepath=f"f{i}", relative_path=f"r{i}", recording_id=str(i), speaker_id=f"p{i}", label="pathological", vowel="a", condition="n", pathology_group="Group A", pathology_group_key="group_a", pathology="x", audio_read_status="ok", age=40.0, duration=2.0, file_sha256=f"h{i}")
    return tuple((out | k)[c.split()[0]] for c in D2.split(", "))


def test_second_database(spark):
    copy = dict(recording_id="1", speaker_id="p1", file_sha256="same")
    rows = [row(1, **copy), row(2, pathology_group="Group B", pathology_group_key="group_b", **copy), row(3, label="healthy", age=35.0), row(4, age=17.0), row(5, duration=0.3), row(6, vowel="i"), row(7, audio_read_status="error"), row(8, audio_read_status=None)]
    built = C.build(spark.createDataFrame(rows, D2), C.CohortConfig(vowels=("a",), conditions=("n",)))
    assert {r["exclusion_reason"] for r in built.exclusions.collect()} == {"audio_read_error", "vowel_not_selected", "age_below_minimum", "duration_below_minimum"}
    kept = {r["source_sample_id"]: r for r in built.training.collect()}
    assert len(kept) == 2 and kept["s1"]["pathology_group"] == "Group A | Group B" and kept["s1"]["source_count"] == 2
    assert kept["s1"]["sample_id"] == "d2_1_a_n" and kept["s1"]["source_sample_ids"] == "s1 | s2"
    assert built.duplicates.count() == 2 and built.duplicates.filter("is_canonical_source").count() == 1
    s = built.summary.first()
    assert (s["input_rows"], s["excluded_rows"], s["candidate_rows"], s["training_rows"], s["collapsed_rows"], s["duplicate_groups"]) == (8, 5, 3, 2, 1, 1)
    assert s["exclusions_by_reason"]["audio_read_error"] == 2 and s["class_distribution"] == {"healthy": 1, "pathological": 1}


def test_different_hashes_for_one_key(spark):
    rows = [row(1, recording_id="1"), row(2, recording_id="1"), row(3, label="healthy")]
    with pytest.raises(C.CohortError, match="Different hashes"):
        C.build(spark.createDataFrame(rows, D2), C.CohortConfig())


def test_first_database(spark):
    rows = [row(1, file_sha256="same", age=40.0), row(2, file_sha256="same", age=60.0), row(3, label="healthy", file_sha256="z" * 64)]
    built = C.build(spark.createDataFrame(rows, D2), C.CohortConfig(adults_only=False, prefix="d1"), by_hash=True)
    kept = {r["source_sample_id"]: r for r in built.training.collect()}
    assert kept["s1"]["age"] is None and "age" in kept["s1"]["metadata_conflict_columns"] and kept["s1"]["source_count"] == 2
    assert kept["s3"]["sample_id"] == "d1_" + "z" * 16 == kept["s3"]["speaker_id"] and kept["s3"]["age"] == 40.0


def test_conflicting_adult_ages(spark):
    rows = [row(1, file_sha256="same", age=40.0), row(2, file_sha256="same", age=60.0), row(3, age=50.0), row(4, label="healthy", age=30.0)]
    built = C.build(spark.createDataFrame(rows, D2), C.CohortConfig(prefix="d1"), by_hash=True)
    gone = built.exclusions.collect()
    assert built.training.count() == 2 and [r["exclusion_reason"] for r in gone] == ["conflicting_age_for_duplicate_audio"] * 2
    assert gone[0]["exclusion_detail"] == "ages=40.0 | 60.0"


def test_conflicting_labels(spark):
    rows = [row(1, file_sha256="same"), row(2, file_sha256="same", label="healthy"), row(3)]
    with pytest.raises(C.CohortError, match="conflicting binary labels"):
        C.build(spark.createDataFrame(rows, D2), C.CohortConfig(prefix="d1"), by_hash=True)


def test_invalid_ages(spark):
    rows = spark.createDataFrame([(17.0,), (None,), (40.0,)], "age double")
    with pytest.raises(C.CohortError, match="without valid age"):
        C.check_adults(rows)
    with pytest.raises(C.CohortError, match="younger than 18"):
        C.check_adults(rows.filter("age IS NOT NULL"))


def test_contracts(spark):
    df = spark.createDataFrame([row(1), row(1)], D2)
    with pytest.raises(C.CohortError, match="repeated sample_id"):
        C.check_manifest(df, C.CohortConfig())
    with pytest.raises(C.CohortError, match="empty"):
        C.check_manifest(df.limit(0), C.CohortConfig())
    with pytest.raises(C.CohortError, match="missing columns"):
        C.check_manifest(df.drop("age"), C.CohortConfig())
    with pytest.raises(C.CohortError, match="labels"):
        C.check_labels(df)
    with pytest.raises(ValueError):
        C.CohortConfig(minimum_age=-1)


def test_first_rule_wins_and_null_is_false(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 15)], "id int, x int")
    cascade = [C.Rule("small", F.col("x") < 10), C.Rule("any", F.col("id") > 0, F.lit("d"))]
    out = {r["id"]: (r["exclusion_reason"], r["exclusion_detail"]) for r in C.audited(df, cascade).collect()}
    assert out == {1: ("any", "d"), 2: ("small", None), 3: ("any", "d")}


@pytest.mark.parametrize("by_hash", [False, True])
def test_long_lists_equal_those_of_one_aggregate(spark, monkeypatch, by_hash):
    """A file with many copies, one with few, copies without a hash, and copies without any value of a list."""
    copies = [row(i, file_sha256="hot", relative_path=f" R{i % 23}", pathology=["x", "b", "B", " ", None][i % 5]) for i in range(60)]
    copies += [row(100 + i, file_sha256=None) for i in range(20)] + [row(200 + i, file_sha256="few") for i in range(3)]
    copies += [row(300 + i, file_sha256="bare", pathology=None if i % 2 else "  ", filepath=None) for i in range(15)]
    rows = spark.createDataFrame(copies, D2).repartition(5)
    make = C.consolidate_hashes if by_hash else C.consolidate_groups
    want = sorted(map(str, make(rows).collect()))
    monkeypatch.setattr(C, "LIST_ROWS", 7)
    out = make(rows)
    assert sorted(map(str, out.collect())) == want and len(want) == 4


def test_a_file_with_very_many_copies(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit("h").alias("k"), F.concat(F.lit("v"), F.col("id") % 50_000).alias("v"))
    got = C.joined_lists(rows, "k", {"all": F.col("v")}).first()["all"]
    assert got == " | ".join(sorted(f"v{i}" for i in range(50_000)))
