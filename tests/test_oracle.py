"""Every registered query against its independent DuckDB oracle."""

import pytest

from bookdesk.plans import registry
from bookdesk.plans.compare import compare, duck_connect

from .conftest import SMALL

registry.load_all()
NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck_connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, registry.QUERIES[name], registry.ORACLES.get(name), SMALL, con)
    assert r["status"] in ("ok", "rows-only"), r


def test_every_operator_has_an_oracle_or_is_listed():
    rows_only = {n for n in registry.QUERIES if n not in registry.ORACLES}
    assert not rows_only, rows_only


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_column_types_match_oracle(spark, con, name):
    from bookdesk.plans.compare import spark_type_name
    df = registry.QUERIES[name](spark, SMALL)
    spark_types = {f.name: spark_type_name(f.dataType) for f in df.schema.fields}
    rel = con.sql(registry.ORACLES[name])
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
