"""Every query of the tape with a SQL counterpart, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tapeloom.plans import oracle
from tapeloom.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in ("events", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool) or not isinstance(v, int | float):
        return str(v)
    return "" if math.isnan(v) else f"{float(v):.9g}"


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, DIR)
    rel = db.sql(oracle.SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    columns = sorted(got.columns)
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


def test_names():
    assert set(oracle.SQL) <= set(QUERIES) and set(QUERIES) - set(oracle.SQL) == {"bootstrap_ci", "study_table"}


def test_study_table_agrees_with_its_parts(spark):
    """The table's sizes are those of the study, its intervals hold its means, and counts and controls are there."""
    table = {(r.section, r.signal, r.split, r.horizon): r for r in QUERIES["study_table"](spark, DIR).collect()}
    size = {(r.rule, r.dataset, r.horizon): r for r in QUERIES["study_size"](spark, DIR).where("n > 0").collect()}
    assert {k[1:] for k in table if k[0] == "size"} == set(size)
    for k, r in table.items():
        assert r.n < 5 or r.ci_lo <= r.value <= r.ci_hi
        assert (r.control is None) == (k[0] != "size") and (r.hit_rate is None) == (k[0] == "size")
        if k[0] == "size":
            assert abs(r.value - size[k[1:]].mean) < 1e-5
