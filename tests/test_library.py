import datetime as dt

import pytest
from marlstone.functions import buckets, stats
from marlstone.operators import clean, joins, valuation
from marlstone.sources import sinks
from marlstone.streaming import alerts
from pyspark.sql import functions as F


NUMBERS = {"7.004,5": 7004.5, "7,004.5": 7004.5, "3.000.250": 3000250.0, "88,125": 88125.0, "0.75": 0.75, "41,6 %": 41.6, "EUR 9 950": 9950.0, "n/a": None, None: None}


@pytest.mark.parametrize("raw,want", NUMBERS.items())
def test_number(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(clean.number(F.col("s"))).first()[0] == want


def test_market_median(spark):
    cases = {
        "even": ([4, 1, 3, 2], 2.5), "few": ([7, 9], None), "far": ([21, 22, 23, 24, 25, 26, 27, 900], 24), "wide": ([1, 1, 2, 2, 60], 2), "signs": ([-3, 0, 5, 6, 8], 6), "ties": ([5] * 6 + [400], 5),
    }
    df = spark.createDataFrame([(k, float(p)) for k, (ps, _) in cases.items() for p in ps], "k string, p double")
    assert {r["k"]: r["market_median"] for r in valuation.market_median(df, ["k"], "p").collect()} == {k: w for k, (_, w) in cases.items()}


def test_deal_score(spark):
    given = [(8e3, 8e3, 1e5), (7.6e3, 8e3, 1e5), (7.6e3, 8e3, 2e4), (16e3, 8e3, 1e5), (8e3, 8e3, 250e3), (8e3, 8e3, 140e3)]
    got = [r[0] for r in spark.createDataFrame(given, "p double, m double, k double").select(F.round(valuation.deal_score(F.col("p"), F.col("m"), F.col("k")), 6)).collect()]
    assert got == [5.0, 5.75, 6.75, 0.0, 3.0, 4.0]


def test_moments_and_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 10, 11)], "x double")
    r = df.agg(stats.skew("x").alias("s"), stats.kurt("x").alias("k")).first()
    assert r["s"] == pytest.approx(0.40080, abs=1e-4) and r["k"] == pytest.approx(-2.91014, abs=1e-4)
    km = spark.createDataFrame([(0.0,), (20000.0,), (20001.0,), (None,)], "x double")
    assert [r[0] for r in km.select(buckets.cut(F.col("x"), buckets.MILEAGE)).collect()] == [None, "0-20k", "20k-50k", None]


def test_upsert_and_throttle(spark):
    base, delta = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert {(r["k"], r["v"], r["action"]) for r in sinks.upsert(base, delta, ["k"], [F.desc("v")]).collect()} == {(1, "a", "kept"), (2, "d", "updated"), (3, "e", "inserted")}
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(i, "x", t + dt.timedelta(seconds=s)) for i, s in enumerate((0, 100, 290, 310, 320, 700))], "id int, k string, ts timestamp")
    assert sorted(r["id"] for r in alerts.throttle(ev, ["k"], "ts", ["id"], 300).collect()) == [0, 3, 5]
    with pytest.raises(ValueError):
        joins.watchlist_matches(base, delta, {"v": "v"}, {}, {}, max_watch=1)
