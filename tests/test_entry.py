"""The driver's contract holds with the corpus operators and without them."""

import sys

import __spark_entry__
from lodestack.plans import QUERIES, SQL


def test_core_queries_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "lodestack.llm.queries", None)
    assert __spark_entry__.queries() == QUERIES and __spark_entry__.oracle_sql() == SQL


def test_every_core_query_has_sql(spark):
    assert set(QUERIES) == set(SQL)
    assert __spark_entry__.entry(spark).count() > 0
