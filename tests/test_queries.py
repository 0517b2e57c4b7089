"""Every query with SQL against DuckDB on the smallest tables; the others for a stable schema."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))
from compare import kinds, norm  # noqa: E402

from orrery.plans import registry  # noqa: E402

D = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(D).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, D)
    if name in SQL:
        got, want = df.toArrow(), con.sql(SQL[name]).to_arrow_table()
        assert kinds(got) == kinds(want)
        assert norm(got).equals(norm(want))
    else:
        assert df.count() > 0
