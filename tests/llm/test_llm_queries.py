import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from spendkit.llm import queries

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op2_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op3_url_filter": "page_id host path rule verdict",
    "op4_best_fit_packing": "doc_id piece start length bin_id bin_offset capacity",
    "op5_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_html_extraction": "page_id url text n_chars",
    "op8_quality": "doc_id held_out score predicted",
    "op9_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op10_jaccard_join": "doc_id n_shingles component_id",
    "op11_ranked_search": "item_id rank doc_id score",
    "op12_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op13_tokenizer_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


def test_every_operator_is_registered():
    assert set(queries.QUERIES) == set(CONTRACT)
    assert {*CONTRACT, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_against_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.CHECKS[name]) == []


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_a_row_per_document_or_page(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == CONTRACT[name].split()
    table = "pages" if "page_id" in got.columns else "documents"
    key, rows = got.columns[0], spark.read.parquet(f"{SF}/{table}.parquet")
    if name == "op4_best_fit_packing":
        got = got.select(key).distinct()
    if name == "op11_ranked_search":
        assert sorted({r["rank"] for r in got.collect()}) == list(range(1, 21))
        return
    assert got.select(key).exceptAll(rows.select(key)).isEmpty() and rows.select(key).exceptAll(got.select(key)).isEmpty()
