"""Every registered query of the engine against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from stratakv.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    assert sql is not None
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in answer.fetchall())


SLICED = ["store_delete", "store_flush_scan", "store_get", "store_prune", "store_reopen"]


@pytest.mark.parametrize("name", SLICED)
def test_store_query_over_runs_of_several_slices(spark, con, name, tmp_path, monkeypatch):
    from stratakv.sources import store

    monkeypatch.setattr(store, "SLICE", 10_000, raising=False)
    monkeypatch.setattr(catalog.scratch, "folder", lambda spark, name: str(tmp_path / name))
    test_query(spark, con, name)
    runs = os.listdir(tmp_path / "store" / "runs")
    assert runs and all(len(glob.glob(f"{tmp_path}/store/runs/{r}/part=*")) > 2 for r in runs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_merge_of_more_than_eight_runs(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    assert catalog.runs(spark, sf).agg({"run_id": "max"}).first()[0] > 8
    got = sorted((r.key, r.value) for r in catalog.queries()["kway_merge"](spark, sf).collect())
    assert got == sorted(con.execute(catalog.oracle_sql()["kway_merge"]).fetchall())
    log = catalog.events_log(spark, sf)
    assert got == sorted((r.key, r.value) for r in catalog.resolve.newest(log).collect())


def test_the_whole_signed_scan(spark, con):
    got = [(r.key, r.value) for r in catalog.queries()["signed_scan"](spark, SF).collect()]
    assert len(got) > 50 and got == con.execute(catalog.oracle_sql()["signed_scan"]).fetchall()
