import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import assert_same  # noqa: E402

from bidgraph.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


#: A row per conversation and per word; their own tests compare them with brute force.
OTHER_ROWS = {"op12_conversation_repair", "op13_spelling_variants"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - OTHER_ROWS))
def test_query_gives_each_document_a_row(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).select("doc_id").distinct().count() == 200
