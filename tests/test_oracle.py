"""Every registered query against its independent DuckDB oracle (sf0.001)."""
import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, compare

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, SF_SMALL)
    assert ok, msg


def test_every_query_has_oracle_or_is_model():
    missing = set(E.queries()) - set(E.oracle_sql())
    kinds = ("ml_", "model_", "stream_", "op", "pipeline")  # "op", "pipeline": tests/llm, where present
    assert all(m.startswith(kinds) for m in missing), missing


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["district", "priced_count", "avg_price_ty"]
    assert 0 < len(rows) <= 10
