"""Comparable estimates, taxes, identity groups and text attributes on small fixtures."""

import random
from itertools import pairwise

from pyspark.sql import functions as F

from marlstone.operators import comparables, fiscal, identity, search

VEHICLE = "make string, id long, year int, km double, price double, fuel string, gearbox string, rank int"


def test_first_level_with_enough_comparables_decides(spark):
    rows = [("a", i, 2019, 80000.0, p, "diesel", "manual", 0) for i, p in enumerate((10000.0, 11000.0, 12000.0, 13000.0))]
    rows += [("a", 9, 2014, 80000.0, 8000.0, "diesel", "manual", 0), ("b", 10, 2019, 80000.0, 9000.0, "diesel", "manual", 0), ("a", 11, None, 1.0, 1.0, None, None, None)]
    got = {r.id: r for r in comparables.comparable_estimates(spark.createDataFrame(rows, VEHICLE), ["make"]).collect()}
    assert set(got) == {0, 1, 2, 3, 9}
    assert (got[0].level, got[0].n, got[0].value) == (1, 3, 12000.0)
    assert got[9].level == 5 and got[9].n == 4
    assert all(r.low < r.value < r.high for r in got.values())


def test_outliers_go_and_other_fuels_are_converted(spark):
    rows = [("a", i, 2019, 80000.0, 10000.0 + 100 * i, "diesel", "manual", 0) for i in range(6)] + [("a", 7, 2019, 80000.0, 90000.0, "diesel", "manual", 0)]
    got = {r.id: r for r in comparables.comparable_estimates(spark.createDataFrame(rows, VEHICLE), ["make"]).collect()}
    assert got[0].n == 5
    assert got[0].value < 11000
    factor = spark.range(1).select(comparables.fuel_factor(F.lit("diesel"), F.lit("eletrico")), comparables.fuel_factor(F.lit("x"), F.lit("gasolina"))).first()
    assert tuple(factor) == (0.8, 1.0)


def test_pairs_are_counted_by_kinds_as_pair_by_pair(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i // 2 if i < 40 else i, rng.choice([2015, 2016, 2019, None]), rng.choice([None, 0.0, 50000.0, 250000.0]), rng.choice([9000.0, 12000.0, None, -1.0]), rng.choice([None, "diesel", "eletrico"]), rng.choice([None, "m", "a"]), rng.choice([None, 0, 1, 3])) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, 900, 2015, 1.0, 9000.0, "diesel", "m", 0), ("a", None, 2015, 1.0, 9000.0, "diesel", "m", 0)], VEHICLE)
    pairs = comparables.comparable_pairs(df, ["make"]).groupBy("level").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("t.id").alias("targets"), F.avg("sim").alias("mean_similarity"))
    want = {r.level: r for r in pairs.collect()}
    got = {r.level: r for r in comparables.comparable_levels(df, ["make"]).collect()}
    assert set(got) == set(want) == {1, 2, 3, 4, 5}
    for k, w in want.items():
        assert (got[k].pairs, got[k].targets) == (w.pairs, w.targets) and abs(got[k].mean_similarity - w.mean_similarity) < 1e-9
    assert comparables.comparable_levels(df.limit(0), ["make"]).collect() == comparables.comparable_estimates(df.limit(0), ["make"]).collect() == []


def test_copies_count_and_equal_mileages_give_no_elasticity(spark):
    rows = [("a", i, 2019, 80000.0, 10000.0 + i % 3, "diesel", "manual", 0) for i in range(3000)] + [("a", 5000, 2019, 20000.0, 10000.0, "diesel", "manual", 0)]
    got = {r.id: r for r in comparables.comparable_estimates(spark.createDataFrame(rows, VEHICLE), ["make"]).collect()}
    assert len(got) == 3001 and (got[5000].n, got[5000].value) == (3000, 10001.0)
    assert got[0].n == 3000


def test_registration_tax(spark):
    row = spark.range(1).select(
        fiscal.registration_tax(F.lit(999), F.lit(105.0), F.lit("gasolina"), F.lit(0), F.lit(True)).alias("petrol"),
        fiscal.registration_tax(F.lit(2000), F.lit(150.0), F.lit("diesel"), F.lit(6), F.lit(False)).alias("diesel"),
        fiscal.registration_tax(F.lit(2000), F.lit(None).cast("double"), F.lit("eletrico"), F.lit(None).cast("int"), F.lit(None).cast("boolean")).alias("electric"),
        fiscal.registration_tax(F.lit(600), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(1), F.lit(True), F.lit(True)).alias("bike"),
    ).first()
    assert abs(row.petrol - (999 * 1.09 - 849.03 + 105 * 0.44 - 43.02)) < 1e-9
    assert abs(row.diesel - (2000 * 5.61 - 6194.88 + 150 * 195.43 - 21720.92 + 500) * 0.48) < 1e-6
    assert row.electric == 0 and abs(row.bike - 184.45 * 0.9) < 1e-9


def test_identity_groups_equal_union_find(spark):
    rng = random.Random(5)
    rows = [(i, *[rng.choice([None, f"{k}{rng.randrange(60)}"]) for k in "uvw"]) for i in range(80)] + [(100 + i, f"c{i}", f"c{i + 1}", None) for i in range(20)] + [(7, None, None, None)]
    df = spark.createDataFrame(rows, "id long, u string, v string, w string")
    got = dict(identity.identity_groups(df, "id", [F.col("u"), F.col("v"), F.col("w")]).collect())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, *keys in rows:
        for a, b in pairwise([i, *[k for k in keys if k]]):
            parent[root(a)] = root(b)
    groups = {}
    for i in {r[0] for r in rows}:
        groups.setdefault(root(i), set()).add(i)
    assert got == {i: min(g) for g in groups.values() for i in g}
    assert identity.identity_groups(df.limit(0), "id", [F.col("u")]).count() == 0


def test_text_attributes(spark):
    df = spark.createDataFrame([("com 150 mil km",), ("9.999.999 km",), ("120.000 km, 03/2018",), ("120 000km",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(search.km_in(F.col("t")), search.registered_year(F.col("t"), 2026)).collect()]
    assert got == [(150000, None), (None, None), (120000, 2018), (120000, None), (None, None), (None, None)]


def test_identity_keys(spark):
    row = spark.range(1).select(identity.url_key(F.lit(" HTTP://x.pt/A//?q=1")), identity.url_key(F.lit("")), identity.plate_key(F.lit("AA-01-BB")), identity.plate_key(F.lit("A1"))).first()
    assert tuple(row) == ("url:http://x.pt/a", None, "plate:aa01bb", None)
