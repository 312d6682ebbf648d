import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from flowlens.plans.catalog import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    plain = lambda x: float(x) if not isinstance(x, bool) and hasattr(x, "__float__") else x
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=key)
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=key)
    assert got == want
    assert not any(isinstance(x, float) and math.isnan(x) for r in got for x in r)


def test_without_sql():
    """What has no twin is named; tests elsewhere hold it against loops and numpy."""
    assert set(QUERIES) - set(SQL) == {"k19_pooled_study", "l3_strategy_batch", "l7_event_export"} and set(SQL) <= set(QUERIES)


def test_entry_imports_without_a_session():
    """Nothing may need a running session at import."""
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], capture_output=True, text=True, cwd=Path(__file__).parents[1])
    assert out.returncode == 0 and out.stdout.split()[-1] == "True", out.stderr[-800:]
