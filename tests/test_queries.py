"""Every registered query against its SQL on whole tables."""

import importlib

import pytest

import __spark_entry__ as contract
import compare


@pytest.fixture(scope="module")
def duck(small):
    return compare.connect(small)


def own_queries():
    """Queries of the article engine; those of the optional subpackage have their own tests."""
    modules = [importlib.import_module(f"newsloom.registry.{name}") for name in contract._MODULES]
    return {name for module in modules for name in module.REGISTRY.queries}


def test_every_query_has_sql():
    assert own_queries() <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(own_queries()))
def test_query(spark, duck, small, name):
    assert compare.compare(spark, duck, name, small) is None


def test_known_flagship_result(spark):
    row = contract.entry(spark).first().asDict()
    assert row == {
        "loaded": 200, "empty_dropped": 12, "duplicate_count": 10, "unique_count": 178,
        "success_count": 71, "failed_count": 104, "low_quality_count": 3, "relevant_count": 61,
        "avg_quality": 8.376404}
