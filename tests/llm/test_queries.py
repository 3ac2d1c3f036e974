"""Registered queries: those with SQL against it, all others for shape."""

import pytest

from stepwright.llm import queries
from tests.compare import difference, duck
from tests.conftest import SMALL

WIDE = {
    "op1_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op5_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_mixing": ["doc_id", "n_tokens", "rate"],
    "op8_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(WIDE))
def test_one_row_per_document(spark, small, name):
    found = queries.QUERIES[name](spark, SMALL)
    assert set(WIDE[name]) <= set(found.columns)
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(
        r.doc_id for r in small.select("doc_id").collect())


def test_all_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    # the last two have tests of their own: rows of pages, and of vectors and components
    assert set(WIDE) | set(queries.ORACLES) | {"op12_url_filter", "op13_whitening"} == set(queries.QUERIES)
