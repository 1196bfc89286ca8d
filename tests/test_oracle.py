"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from mediacat.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# those of the optional subpackage have tests of their own
QUERIES = {k: v for k, v in entry_module.queries().items() if k in catalogue.QUERIES}
ORACLES = {k: v for k, v in entry_module.oracle_sql().items() if k in catalogue.QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted(tuple("" if r[i] is None else repr(r[i]) for i in at) for r in rows)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    ours = plain([tuple(r) for r in df.collect()], df.columns, order)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == order
    assert ours == plain(cursor.fetchall(), columns, order)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name",
    ["d7_verify_video_groups", "d12_group_listing", "d13_group_page", "d14_apply_keep", "k3_rebuild_groups",
     "m3_restore_paths", "d2_exact_incremental_members", "d6_similar_groups"],
)
def test_hot_keys_give_the_same_rows(spark, duck, name, monkeypatch):
    """Every key of three rows or more takes the broadcast path."""
    monkeypatch.setattr("mediacat.runtime.HOT_ROWS", 3)
    test_query(spark, duck, name)


@pytest.mark.parametrize("name", ["a1_timeline_by_day", "p1_browse_deep", "i10_normalize_tags", "s3_stream_timeline", "i7_diff_listing"])
def test_the_session_zone_does_not_matter(spark, duck, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_query(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
