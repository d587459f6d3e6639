"""Deal economics, calibration, sweeps and profiles on small fixtures with nulls, ties and empty tables."""

from pyspark.sql import functions as F

from marlstone.operators import economics

V = F.col


def test_costs(spark):
    rows = [(9.0, 10000.0, False, None, 30), (None, 1000.0, True, None, -5), (1.0, 20000.0, False, 800.0, 365), (1.0, None, None, None, 1)]
    df = spark.createDataFrame(rows, "c double, p double, moto boolean, tax double, days int")
    got = df.select(economics.acquisition_costs(V("p"), V("c"), V("moto"), V("tax")).alias("a"), economics.selling_costs(V("p"), V("days"), V("moto")).alias("s")).collect()
    assert [round(r.a, 2) for r in got] == [237.30, 55.30 + 22 + 405, 55.30 + 32 + 800 + 550 + 5500, 55.30 + 32 + 5500]
    assert [round(r.s.total, 2) for r in got] == [299.32, 15.0, 1700.0, 0.0]


def test_verdicts_and_grades(spark):
    rows = [(100.0, 100.0), (110.0, 100.0), (111.0, 100.0), (None, 100.0), (50.0, None), (0.0, 100.0), (30.0, 100.0)]
    df = spark.createDataFrame(rows, "p double, v double")
    got = df.select(economics.buy_verdict(V("p"), V("v")).alias("b"), economics.statistical_score(V("p"), V("v")).alias("s"), economics.plausibility(V("p"), V("v"), F.lit(0.9)).alias("l")).collect()
    assert [r.b for r in got] == ["BUY_ZONE", "NEGOTIATE", "PASS", "PASS", "PASS", "PASS", "BUY_ZONE"]
    assert [r.s and r.s.grade for r in got] == ["fair", "poor", "poor", None, None, None, "exceptional"]
    assert [r.l for r in got] == ["preco_de_mercado", "preco_de_mercado", "preco_de_mercado", None, "indeterminado", "suspeito", "suspeito"]
    ratings = spark.createDataFrame([(9.0,), (7.5,), (6.0,), (4.0,), (3.9,), (None,)], "s double").select(economics.rating(V("s"))).collect()
    assert [r[0] for r in ratings] == ["Excelente", "Muito Bom", "Bom", "Razoável", "Fraco", "N/A"]


def test_net_profit(spark):
    df = spark.createDataFrame([(10000.0, 20000.0, 60000.0, False), (10000.0, None, None, True), (None, None, None, None)], "p double, v double, k double, a boolean")
    got = [tuple(r.n) for r in df.select(economics.net_profit(V("p"), V("v"), V("k"), V("a")).alias("n")).collect()]
    assert got == [(10000.0, 7450.0, 74.5), (0.0, -3850.0, -38.5), (0.0, -500.0 + 0.0, 0.0)]
    badges = spark.createDataFrame([(3001.0, 9.0), (3001.0, 6.0), (1.0, None), (-1.0, 0.0), (None, 1.0)], "n double, p double").select(economics.profit_badge(V("n"), V("p"))).collect()
    assert [b[0] for b in badges] == ["EXCELENTE", "BOM", "MARGINAL", "PREJUÍZO", "S/ DADOS"]


def test_threshold_sweep_equals_counting(spark):
    rows = [(0.1, True), (0.1, False), (0.55, True), (0.95, True), (0.94, False), (None, True), (0.3, None), (0.0, False)]
    sweep = economics.threshold_sweep(spark.createDataFrame(rows, "s double, y boolean"), "s", "y")
    got = {round(r.threshold, 2): r for r in sweep.collect()}
    assert len(got) == 18
    for t, r in got.items():
        known = [(s is not None and s >= t, y) for s, y in rows if y is not None]
        tp, fp, fn = (sum(h == a and y == b for h, y in known) for a, b in ((True, True), (True, False), (False, True)))
        assert abs(r.f1 - (2 * tp / (2 * tp + fp + fn) if tp else 0)) < 1e-9 and abs(r.accuracy - sum(h == y for h, y in known) / len(known)) < 1e-9
    top = max(got.values(), key=lambda r: (r.f1, -r.threshold))
    assert tuple(economics.best_threshold(sweep).first()) == (top.threshold, top.f1)
    empty = economics.threshold_sweep(spark.createDataFrame([], "s double, y boolean"), "s", "y")
    assert empty.count() == 0 and tuple(economics.best_threshold(empty).first()) == (0.5, 0.0)


def test_profile_and_calibration(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, "a"), (2.0, "b"), (2.0, None)], "x double, c string")
    got = {r.name: r for r in economics.column_profile(df, ["x"], ["c"]).collect()}
    assert (got["x"].n, got["x"].missing, got["x"].mean, got["x"].min, got["x"].max, got["x"].missing_pct) == (4, 1, 2.0, 1.0, 3.0, 20.0)
    assert (got["c"].n, got["c"].missing, got["c"].unique, got["c"].top) == (4, 1, 2, "a")
    assert {(r.name, r.n, r.top, r.missing_pct) for r in economics.column_profile(df.limit(0), ["x"], ["c"]).collect()} == {("x", 0, None, None), ("c", 0, None, None)}
    ratios = spark.createDataFrame([(float(k), 10.0) for k in range(1, 21)] + [(5.0, 0.0), (None, 3.0)], "p double, q double")
    row = economics.calibration_ratio(ratios, "p", "q").first()
    assert row.n == 18 and abs(row.median_ratio - 1.15) < 1e-9
    assert economics.calibration_ratio(ratios.limit(3), "p", "q").count() == 0


def test_calibration_ratio_has_no_gathered_median(spark):
    """Two ratios counted five and six times: median, mean and deviation; no aggregate that holds all values."""
    rows = spark.createDataFrame([(1.0, 1.0)] * 5 + [(2.0, 1.0)] * 6 + [(9.0, 1.0), (1.0, 0.0)], "p double, q double")
    found = economics.calibration_ratio(rows, "p", "q")
    n, middle, mean, std = found.first()
    assert (n, middle) == (11, 2.0) and abs(mean - 17 / 11) < 1e-12 and abs(std - (30 / 121) ** 0.5) < 1e-12
    assert not any(f"{k}(" in found._jdf.queryExecution().toString() for k in ("median", "percentile"))
