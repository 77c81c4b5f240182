"""Every registered query of the text operators: against its SQL where it has one, else that it answers."""

import pytest
from oracle_check import compare, connect
from paths import SF

from tillwatch.llm.queries import QUERIES, SQL

#: Vocabularies, trained models and ciphers are not SQL's; their own tests compare them with brute force.
NO_SQL = {"op1_pseudonyms", "op3_language", "op4_lm_scores", "op6_fingerprints", "op8_packing", "op10_bpe"}


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL and set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    message, _ = compare(QUERIES[name](spark, SF), duck, SQL[name])
    assert message == ""


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
