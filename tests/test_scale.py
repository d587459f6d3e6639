"""Queries over large tables: texts are read once for each row, groups meet rows once, copies are not paired."""

import random

from pyspark.sql import functions as F

from marlstone.operators import decisions, drivers, estimates, market, matching, pricing, rules, scores, vehicles
from marlstone.sources import tables


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_listings_meet_their_groups_once(spark):
    rows = [(i, "A", "m x", 2000 + i % 3, 1000.0 * i, 9000.0 + i, "carros", "t", True) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "id long, brand string, model string, year int, km double, price double, vtype string, title string, retail boolean")
    got = pricing.engine_price(df, df.select("brand", "model", "year", "price").limit(0), 2005)
    assert _plan(got).count("Join ") == 1 and got.count() == 29


def test_signs_are_found_behind_their_hints(spark):
    texts = ["SALVADO", "ſalvado", "sem matrícula", "não pega", "REVISÕES em dia", "kit distribuição novo", "Único Dono", "alemão", "Aceito troca", "S-Tronic", "All wheel", "descapotável", "FR", "nada"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    each = df.select("t", drivers.signs(F.col("t")).alias("s"), *[F.col("t").rlike(f"(?iu){p}").alias(k) for k, p in drivers.SIGNS.items()]).collect()
    assert all(r.s[k] == r[k] for r in each for k in drivers.SIGNS)
    assert [any(r.s) for r in each] == [any(r[k] for k in drivers.SIGNS) for r in each] and sum(any(r.s) for r in each) >= 11


def test_group_means_need_no_window(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), ("b", None)], "k string, v double")
    got = market.with_group_mean(df, ["k"], "v", "m")
    assert "Window" not in _plan(got)
    assert sorted((r.k or "", r.v or 0, r.m or 0) for r in got.collect()) == [("", 5.0, 6.0), ("", 7.0, 6.0), ("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", 0, 0)]


def test_links_are_counted_as_pairs_without_pairing_copies(spark):
    rng = random.Random(4)
    names = ["red car door", "red car doors", "blue boat", None, "red cat door"]
    rows = [(i, rng.choice(["x", "y", None]), rng.choice(names), rng.choice(["aa", "ab", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, block string, p string, q string")
    want = {}
    for r in matching.fuzzy_pairs(df, "id", ["block"], ["p", "q"]).collect():
        for i in (r.a, r.b):
            want[i] = want.get(i, 0) + 1
    got = matching.fuzzy_links(df, "id", ["block"], ["p", "q"]).collect()
    assert len(got) == 60 and {r.id: r.links for r in got if r.links} == want
    first = {}
    for i, *key in rows:
        key = (key[0], key[1] or "", key[2] or "")
        first.setdefault(key if key[0] else i, i)
        assert [r.class_id for r in got if r.id == i] == [first[key if key[0] else i]]


def test_texts_are_folded_once(spark):
    df = spark.createDataFrame([("Clio híbrido", "desde 12.500 € AMG line")], "a string, b string")
    n = F.lit(None).cast("double")
    for c, most in (
        (vehicles.performance_class(F.col("a"), F.col("b")), 1), (vehicles.fuel_class(F.col("a"), F.col("b")), 1), (rules.price_evidence(F.col("b")), 1),
        (rules.guard(F.col("a"), F.col("b"), n, n, n, F.col("a"), F.col("a"), F.col("a"), n, 2020), 2),
    ):
        assert 0 < _plan(df.select(c.alias("x"))).count("translate(lower(") <= most
    assert df.select(vehicles.fuel_class(F.col("a"), F.col("b"))).first()[0] == "hibrido"
    assert df.select(vehicles.performance_class(F.col("a"), F.col("b")).alias("p")).first().p.performance == "sport_trim"
    assert df.select(rules.price_evidence(F.col("b")).alias("p")).first().p.kind == "monthly"


def test_a_sale_is_rounded_once_for_each_row(spark):
    names = ("asking", "estimate", "low", "high", "conf", "comps", "cost")
    df = spark.range(3).select(*[(F.col("id") * 1000.0 + 100).alias(c) for c in names])
    got = df.select(decisions.realism(*map(F.col, names), F.lit(60), F.lit(False)).alias("r")).select("r.*")
    assert _plan(got).count("round(") == 2 and got.count() == 3  # of the estimate and of its low end


def test_opinions_are_weighed_once_for_each_row(spark):
    names = ("value", "low", "high", "conf", "model", "ref", "ref_conf")
    df = spark.range(3).select(*[(F.col("id") * 1.0).alias(c) for c in names])
    got = df.select(estimates.blended(*map(F.col, names)).alias("b")).select("b.*")
    assert _plan(got).count("greatest(0.4,") == 1
    assert [r["value"] for r in got.collect()] == [None, 1.0, 2.0]  # no value, no blend, and nothing is divided by it


def test_market_ranges_read_the_listings_once(spark):
    schema = "brand string, year int, price double, active boolean, value double, risk double, condition double"
    rows = [("BMW", 2020, 9.0, True, 9.0, 1.0, 5.0), ("BMW", 2021, 7.0, None, 9.0, 1.0, 5.0), ("BMW", 2022, 0.0, True, 9.0, 1.0, 5.0), (None, None, 5.0, True, 9.0, 1.0, 5.0), ("Audi", 2020, 3.0, False, 9.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, schema)
    ranges = scores.market_ranges(df)
    assert "RDD" not in _plan(ranges) and _plan(scores.five_scores(df)).count("LogicalRDD") == 1
    got = {(r["brand"], r["year"]): (r["supply"], r["lowest"], r["highest"]) for r in ranges.collect()}
    assert got == {("BMW", 2020): (2, 9.0, 9.0), ("BMW", 2021): (2, 9.0, 9.0), ("BMW", 2022): (2, 9.0, 9.0), ("", 2020): (2, 9.0, 9.0), ("Audi", 2020): (0, None, None)}


def test_tasks_of_large_joins_grow_with_the_listings(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    whole = tables.listings(spark, d)
    assert "RepartitionByExpression" not in _plan(whole)
    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    monkeypatch.setattr(tables, "LARGE", 0)
    dealt, n = tables.listings(spark, d), tables.table(spark, d, "lineitem").count() // 200
    assert n > 4 and all(f"RepartitionByExpression [{k}" in _plan(dealt) for k in ("l_orderkey", "l_partkey")) and _plan(dealt).count(f", {n}\n") == 2
    assert dealt.count() == whole.count() and dealt.exceptAll(whole).isEmpty()
