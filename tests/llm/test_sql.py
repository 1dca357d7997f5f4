"""The corpus queries against their SQL, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from ledgerloom.llm.queries import ORACLE_SQL, QUERIES

SMALL = Path("/root/testdata/sf0.001")


def rows(frame):
    """Rows as text; a column of whole numbers with a null comes as floats from one side."""
    names = sorted(frame.columns)
    plain = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) and x.is_integer() else x
    return names, sorted(str(tuple(map(plain, r))) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None))


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows(QUERIES[name](spark, str(SMALL)).toPandas()) == rows(db.execute(ORACLE_SQL[name]).df())
