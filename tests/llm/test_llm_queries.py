"""Contract columns, and the SQL forms, on the small tables."""

import duckdb
import pytest

from rollcall.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_near_duplicates": ["doc_id", "class_id", "class_size"],
    "op3_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op4_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op6_decontamination": ["doc_id", "contaminated", "n_items", "items", "similarity"],
    "op7_quality": ["doc_id", "held_out", "score", "predicted"],
    "op8_chat_format": ["conv_id", "n_turns", "n_copies", "text"],
    "op11_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op12_ranked_search": ["item_id", "rank", "doc_id", "score"],
    "op13_importance_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
    "op10_language": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.columns == COLUMNS[name]
    if name not in ("op8_chat_format", "op12_ranked_search"):
        assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_form(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = QUERIES[name](spark, SF)
    expect = con.execute(ORACLES[name])
    names = [d[0] for d in expect.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*names).collect()), key=str) == sorted(expect.fetchall(), key=str)
