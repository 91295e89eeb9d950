"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from weftcast.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        return round(float(v), 5) if isinstance(v, float) or type(v).__name__.startswith(("float", "Decimal")) else str(v)

    df = df[sorted(df.columns)]
    rows = [tuple(cell(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple("" if isinstance(v, float) else str(v) for v in r))


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(float(a) - float(b)) <= 1e-4 * max(1, abs(float(a)))
    return a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    for df in (got, want):
        for c in df.columns:
            if str(df[c].dtype) in ("Int64", "Int32"):
                df[c] = df[c].astype("float64")
    got, want = plain(got), plain(want)
    assert len(got) == len(want)
    key = lambda r: tuple((v is None, round(v, 3) if isinstance(v, float) else 0.0, str(v) if not isinstance(v, float) else "") for v in r)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert all(map(close, a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def test_as_of_paths_have_no_nested_loop(spark):
    plan = registry.queries()["j3_trend"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_are_pruned(spark):
    plan = registry.queries()["pf12_lead_buckets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" in plan and "l_comment" not in plan
