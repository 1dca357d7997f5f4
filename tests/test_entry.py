import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans.queries import ORACLE_SQL, QUERIES

SMALL = Path("/root/testdata/sf0.001")


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(map(str, frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows(QUERIES[name](spark, str(SMALL)).toPandas()) == rows(db.execute(ORACLE_SQL[name]).df())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_corpus_operators(tmp_path):
    """The entry module and the rest import in a copy that has neither the subpackage nor the pipeline."""
    root = Path(__file__).resolve().parent.parent
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}]; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.finance.QUERIES))"
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    for p in (root / "ledgerloom").rglob("*.py"):
        if "llm" not in p.parts:
            to = tmp_path / p.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert out.stdout.strip() == "True", out.stderr
