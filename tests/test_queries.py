"""Every registered query of the engine against its oracle, on the smallest tables."""

import pytest

from scholion.plans import registry
from tests.oracle import connect, rows_of_spark, rows_of_sql


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, con, name):
    names, rows = rows_of_spark(registry.queries()[name](spark, sf))
    if name in registry.oracle_sql():
        assert (names, rows) == rows_of_sql(con, registry.oracle_sql()[name])
    else:
        assert rows


def test_only_the_document_form_has_no_oracle():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"context_bundle_doc"}
