"""Every query of this package with SQL against DuckDB on the smallest tables; the others for their rows."""

import sys
from pathlib import Path

import duckdb
import pytest

pytest.importorskip("orrery.llm")
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "scripts"))
from compare import kinds, norm  # noqa: E402

from orrery.llm import queries  # noqa: E402

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(D).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, D)
    if name in queries.SQL:
        got, want = df.toArrow(), con.sql(queries.SQL[name]).to_arrow_table()
        assert kinds(got) == kinds(want) and (got.num_rows or name == "p2_recall")  # whose queries are too few at this size
        assert norm(got).equals(norm(want))
    else:
        assert df.count() > 0
