"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from marlstone.plans.all import ORACLE_SQL, QUERIES
from marlstone.sources.tables import TABLES


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, (float, decimal.Decimal)):
        return format(float(x), ".9g")
    if isinstance(x, datetime.date) and not isinstance(x, datetime.datetime):
        return str(pd.Timestamp(x))
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(x) for x in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(small, name)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Query: what its plan holds so that the pandas function sees bounded groups.
FED = {
    "udf_aggregate": "min(c_acctbal",
    "udf_grouped_map": "slice",
    "udf_cogrouped": "count(distinct c_custkey",
    "udf_window": "max(c_acctbal",
}


@pytest.mark.parametrize("name", sorted(FED))
def test_pandas_functions_see_bounded_groups(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert FED[name] in plan, plan


def test_a_hot_user_is_dealt_in_slices(spark, tmp_path):
    n = 180_000
    values = pd.DataFrame({"user_id": [1 if i % 3 else i % 100 for i in range(n)], "event_id": range(n), "value": [float((i * 7) % 1000) for i in range(n)]})
    values["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta((values["event_id"] * 7919) % n, unit="s")
    values.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    got = QUERIES["udf_grouped_map"](spark, str(tmp_path)).toPandas().set_index("event_id")["change"].sort_index()
    first = values.sort_values("ts").groupby("user_id")["value"].transform("first").sort_index()
    assert (got.to_numpy() == (values["value"] - first).to_numpy()).all()


#: Query: how its rows must follow each other.
ORDERED = {
    "top_k": "ORDER BY o_totalprice DESC, o_orderkey",
    "limit_offset": "ORDER BY o_orderdate, o_orderkey",
    "sort_nulls": "ORDER BY status ASC NULLS LAST, o_orderkey",
    "sort_ranges": "ORDER BY c_acctbal, c_custkey",
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_sorted_rows_come_in_order(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    want = duck.execute(f"SELECT * FROM ({ORACLE_SQL[name]}) {ORDERED[name]}").df()
    assert [tuple(map(plain, r)) for r in got.collect()] == [tuple(map(plain, r)) for r in want[got.columns].itertuples(index=False)]


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from marlstone.sources import shared

    class Context:
        applicationId, master = "app", "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())
