import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Make documents from (doc_id, text) or (doc_id, text, source) rows, with columns that clash with the operators'."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        from pyspark.sql import functions as F

        df = spark.createDataFrame(full, SCHEMA)
        for c in ("size", "shard", "kept", "node", "label", "hash", "key", "part", "mix_hash", "row", "ids"):
            df = df.withColumn(c, F.lit("clash"))
        return df

    return make


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (None, "a row without an id but with words enough to count as text"), (4, "word"), (5, "two words"),
    (6, "Ünï cödé 漢字 \U0001f600 text"), (7, "same text twice " * 5), (7, "same text twice " * 5), (8, "long " * 60_000), (9, "x" * 200_000), (10, "0" * 5000 + " +1 @@ @a.b 1.2.3.4"),
]
