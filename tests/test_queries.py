"""Every query of the core on the smallest tables: against its SQL, or at least for rows."""

from pathlib import Path

import duckdb
import pytest

from tallyard.plans import catalogue
from tools.oracle_check import canon

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, name):
    got = catalogue.queries()[name](spark, data).toArrow().to_pandas()
    if name not in SQL:
        assert len(got)
        return
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(SQL[name]).df()
    assert canon(got).equals(canon(want))
