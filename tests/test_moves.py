"""How rows of large tables move: orders meet only the line items they change, rows of a kind are dealt once."""

import statistics

import pytest
from pyspark.sql import functions as F

from marlstone import registry
from marlstone.operators import comparables, families, levels, market
from marlstone.sources import tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def merged(spark):
    """No table is small enough to be sent to every task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_orders_are_left_out_of_the_view_where_nothing_of_them_is_read(spark, merged):
    whole, got = tables.listings(spark, SF), tables.listings(spark, SF, orders=False)
    assert "orders" not in _plan(got) and "o_orderkey" in _plan(whole)
    assert got.columns == [c for c in whole.columns if c not in ("condition", "status", "date_scraped")]
    assert got.exceptAll(whole.select(got.columns)).isEmpty() and got.count() == whole.count()


def test_orders_that_are_missing_or_repeated_still_count(spark, tmp_path):
    for name in ("nation", "region", "supplier", "part", "lineitem", "orders"):
        t = tables.table(spark, SF, name)
        if name == "lineitem":
            t = t.unionByName(t.limit(5).withColumn("l_orderkey", F.lit(None).cast("long")))
        if name == "orders":
            t = t.where("o_orderkey % 7 <> 0").unionByName(t.where("o_orderkey % 5 = 0")).unionByName(t.limit(1).withColumn("o_orderkey", F.lit(None).cast("long")))
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    whole, got = tables.listings(spark, str(tmp_path)), tables.listings(spark, str(tmp_path), orders=False)
    assert got.count() == whole.count() != tables.table(spark, SF, "lineitem").count()
    assert got.exceptAll(whole.select(got.columns)).isEmpty()


def test_suppliers_go_to_the_listings(spark, merged):
    assert "BroadcastHashJoin [l_suppkey" in _plan(tables.listings(spark, SF))


def test_large_orders_and_parts_are_hashed_and_listings_not_sorted(spark, merged, monkeypatch):
    monkeypatch.setattr(tables, "HASHED", 0)
    plan = _plan(tables.listings(spark, SF))
    assert "ShuffledHashJoin [l_orderkey" in plan and "ShuffledHashJoin [l_partkey" in plan


def _family(n: int) -> list[tuple]:
    return [(i, "A", "x", 2000 + i % 4, 1000.0 * (i % 9), 9000.0 + i % 7, "diesel", "M", 1, 100, "awd", "suv", 0.5, None) for i in range(n)]


def _rows_scan(plan: str) -> str:
    return next(x for x in plan.splitlines() if "FileScan" in x and "id#" in x)


def test_rows_of_a_kind_are_dealt_once_for_families(spark, merged):
    df = spark.createDataFrame(_family(60), "id long, brand string, family string, year int, km double, price double, fuel string, gearbox string, rank int, hp int, drive string, body string, trim double, fingerprint string")
    got = families.family_estimates(df)
    assert "Bucketed: true" in _rows_scan(_plan(got)) and got.count() == 60

def test_rows_of_a_kind_are_dealt_once_for_comparables(spark, merged):
    df = spark.createDataFrame(_family(60), "id long, brand string, family string, year int, km double, price double, fuel string, gearbox string, rank int, hp int, drive string, body string, trim double, fingerprint string")
    got = comparables.comparable_estimates(df, ["brand", "family"])
    assert "Bucketed: true" in _rows_scan(_plan(got)) and got.count() == 60


LEVELS = "id long, vtype string, brand string, model string, year int, km double, price double, fuel string, segment string, retail boolean"


def test_rows_of_a_kind_are_dealt_once_for_levels(spark, merged):
    df = spark.createDataFrame([(i, "c", "A", "m", 2000, 1000.0 * (i % 5), 900.0 + i % 7, "x", "s", True) for i in range(40)], LEVELS)
    got = levels.level_estimates(df)
    assert "Bucketed: true" in _rows_scan(_plan(got)) and got.count() == 40


def test_a_level_estimate_carries_the_listing_along(spark):
    rows = [(i, "c", "A", "m", 2000, 1000.0, 900.0 + i, "x", "s", True) for i in range(4)] + [(9, "c", "", "m", 2000, 1.0, 5.0, "x", "s", True), (10, "z", "B", "m", 2000, 1.0, 5.0, "x", "t", True)]
    df = spark.createDataFrame(rows, LEVELS)
    plain = {r["id"]: r["value"] for r in levels.level_estimates(df).collect()}
    got = levels.level_estimates(df.withColumn("id", F.struct("id", "price")), every=True).select("id.*", "value").collect()
    assert {r["id"]: r["price"] for r in got} == {r[0]: r[6] for r in rows} and len(got) == len(rows)
    assert {r["id"]: r["value"] for r in got} == {i: plain.get(i) for i in {r[0] for r in rows}} and set(plain) == {0, 1, 2, 3}


def test_blended_methods_read_the_view_once(spark, merged):
    got = registry.queries()["op_v14_blended_methods"](spark, SF)
    assert "lineitem" not in _plan(got)  # what is left reads the dealt rows


def test_the_pricing_engine_reads_the_view_once(spark, merged):
    plan = _plan(registry.queries()["op_v18_engine_price"](spark, SF))
    assert "lineitem" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_errors_of_a_group_are_not_held_in_one_task(spark):
    data = [(k, 10.0 + i % 17, 11.0 + i * i % 23) for i in range(60) for k in ("a", None)] + [("b", 10.0, None), ("c", 4.0, 5.0), ("d", -1.0, 3.0)]
    df = spark.createDataFrame(data, "k string, a double, p double")
    got = market.error_report(df, "a", "p", "k")
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["k"]: r for r in got.collect()}
    assert set(rows) == {"a", None, "b", "c"} and rows["b"]["n"] == 1 and rows["b"]["median_ae"] is None and rows["c"]["median_ae"] == 1.0
    for k in ("a", None):
        errors = [(abs(p - a), abs(p - a) / a) for x, a, p in data if x == k]
        assert rows[k]["n"] == 60 and rows[k]["median_ae"] == statistics.median(e for e, _ in errors)
        assert rows[k]["median_ape_pct"] == pytest.approx(100 * statistics.median(e for _, e in errors))
