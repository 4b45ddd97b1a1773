import pytest

from lodestone.plans import catalog

from .oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, sf, name):
    compare(spark, sf, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_point_works_without_the_training_data_subpackage(spark, monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "lodestone.llm", None)
    monkeypatch.setitem(sys.modules, "lodestone.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(e.queries()) == set(catalog.QUERIES)
    assert set(e.oracle_sql()) <= set(catalog.QUERIES)
    assert e.entry(spark).columns
