"""The registered queries themselves, on the smallest tables: columns, whole tables, SQL."""

import os

import duckdb
import pytest

from tessitura.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

COLUMNS = {
    "op1_url_filters": "page_id host path rule verdict",
    "op2_language_id": "doc_id held_out lang_pred score",
    "op3_source_mixing": "doc_id size source_size target taken",
    "op4_near_duplicates": "doc_id n_shingles component_id kept",
    "op5_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_token_files": "doc_id start n_tokens ids_crc32",
    "op9_decontamination": "doc_id item_id",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op11_fill_in_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op12_snapshot_difference": "key old_key op changed row_sha256",
    "op13_exact_duplicates": "doc_id keep_id group_size kept text_sha256",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_columns_rows_and_sql(spark, duck, name):
    out = Q.QUERIES[name](spark, FOLDER)
    columns = COLUMNS[name].split()
    assert out.columns[: len(columns)] == columns
    rows = out.collect()
    if name not in ("op9_decontamination", "op12_snapshot_difference"):  # rows of pairs
        table, key = ("pages", "page_id") if name == "op1_url_filters" else ("documents", "doc_id")
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in duck.execute(f"SELECT {key} FROM {table}").fetchall())
    if name in Q.ORACLES:
        found = duck.execute(Q.ORACLES[name])
        at = [[c[0] for c in found.description].index(c) for c in out.columns]
        assert sorted([plain(v) for v in r] for r in rows) == sorted([plain(r[i]) for i in at] for r in found.fetchall())


def test_shares_of_held_out_rows_and_languages(spark, duck):
    out = Q.op2_language_id(spark, FOLDER).toPandas()
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    held = out[out.held_out]
    assert 0.1 < len(held) / len(out) < 0.4
    assert sum(langs[d] == p for d, p in zip(held.doc_id, held.lang_pred)) > 0.85 * sum(langs[d] is not None for d in held.doc_id)


def test_slots_and_starts_have_no_gaps(spark):
    shards = Q.op10_sharding(spark, FOLDER).toPandas()
    for _, g in shards.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    files = Q.op8_token_files(spark, FOLDER).toPandas().sort_values("start")
    assert files.start.tolist() == (files.n_tokens.cumsum() - files.n_tokens).tolist()
    assert files.doc_id.tolist() == sorted(files.doc_id)
