"""Every query with SQL gives the SQL's rows over the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from ledgerlens.plans import catalog, forensics, graphs, more  # noqa: F401
from ledgerlens.session import TABLES


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    return repr(float(v)) if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", catalog.ORACLE)
def test_rows_equal_sql(spark, sf_dir, sql, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    rows = sorted([plain(v) for v in r] for r in got.select(names).collect())
    sql.execute(catalog.ORACLE[name])
    order = sorted((d[0], i) for i, d in enumerate(sql.description))
    assert [n for n, _ in order] == names
    assert rows == sorted([plain(r[i]) for _, i in order] for r in sql.fetchall())


def test_no_cross_joins_but_of_single_rows(spark, sf_dir):
    for name in ("j_bipartite", "j_in_out", "j_geoip", "agg_arrival", "chain_index"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "Python" not in plan
