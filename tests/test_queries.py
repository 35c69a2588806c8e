"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from gristmill.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def _rows(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    found = _rows(df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect())
    if sql := catalogue.oracle_sql().get(name):
        assert found == _rows(duck.execute(f"SELECT {cols} FROM ({sql})").fetchall())
    else:
        assert found


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True, timeout=120)
