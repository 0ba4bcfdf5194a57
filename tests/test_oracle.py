"""Every registered query of the library against its SQL, on small tables."""

import pytest

from cohortlake.plans import annotations, cohort, features, graph, metrics, registry, stats  # noqa: F401

from .oracle import compare, connect


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf, con, name):
    assert compare(registry.QUERIES[name](spark, sf), con, registry.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - {"d17_model_search", "g10_spanning_forest"}))
def test_rows(spark, sf, name):
    assert len(registry.QUERIES[name](spark, sf).collect()) > 0
