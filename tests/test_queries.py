"""Every registered query with a SQL twin gives the twin's rows."""

import ast
import os

import duckdb
import pytest

from aeroframe.plans.queries import ORACLES, QUERIES
from aeroframe.session import ship

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    ship(spark)
    df, rel = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_every_query_is_checked():
    """What has no SQL twin is run and compared in a test of its own: its name indexes QUERIES there."""
    here = os.path.dirname(__file__)
    run = set()
    for name in ("test_brute.py", "test_surface.py", "test_motion.py", "test_adjust.py"):
        with open(os.path.join(here, name), encoding="utf-8") as f:
            for node in ast.walk(ast.parse(f.read())):
                if isinstance(node, ast.Subscript) and getattr(node.value, "id", "") == "QUERIES":
                    run |= {x.value for x in ast.walk(node.slice) if isinstance(x, ast.Constant)}
    assert set(QUERIES) - set(ORACLES) <= run
