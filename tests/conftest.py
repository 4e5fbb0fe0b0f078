import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pii_lens import session

    s = session.build(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query's rows against its SQL's, columns by name."""

    def value(x):
        return round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x

    def check(query, sql):
        df = query(spark, str(DATA))
        rel = duck.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        names = sorted(df.columns)
        got = [tuple(r) for r in df.select(*(f"`{c}`" for c in names)).collect()]
        want = rel.select(*(f'"{c}"' for c in names)).fetchall()
        key = lambda rows: sorted(repr(tuple(map(value, r))) for r in rows)
        assert key(got) == key(want)
        return len(got)

    return check
