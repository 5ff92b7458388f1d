"""Every registered query of the base library against its SQL."""

import pytest

from talus.plans import hybrid_queries, log_queries, search_queries, source_queries, text_queries, thread_queries, upkeep_queries, wiki_queries  # noqa: F401
from talus.plans.registry import ORACLE, QUERIES

from .conftest import oracle_rows, same_rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    same_rows(QUERIES[name](spark, sf), *oracle_rows(ORACLE[name], sf))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_imports_and_lists(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
