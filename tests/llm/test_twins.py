"""Queries of the subpackage against their SQL twins on the smallest tables, and their columns."""

import pathlib

import pytest

from tests.compare import connect, difference
from wattsift.llm import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="needs the given tables")

COLUMNS = {
    "op3": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op7": ["doc_id", "held_out", "score", "predicted"],
    "op11": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op12": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
}
#: Queries with a row for each component of an embedding, not for each document.
OTHER_ROWS = {"op12_whitening": 4 * 500}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, name):
    got = catalog.queries()[name](spark, SF_DIR).toArrow()
    assert difference(got, connect(SF_DIR).sql(catalog.oracle_sql()[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_columns_and_rows(spark, docs_001, name):
    got = catalog.queries()[name](spark, SF_DIR)
    assert set(COLUMNS.get(name.split("_")[0], ["doc_id"])) <= set(got.columns)
    assert got.count() == OTHER_ROWS.get(name, docs_001.count())
