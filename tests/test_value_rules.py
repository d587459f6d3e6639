"""Values worked by hand for reference values, drivers, scores, the pricing engine, interval calibration and guard words."""

import math

import pytest
from marlstone.operators import drivers, pricing, reference, rules, scores, valuation
from pyspark.sql import functions as F

CURVES = reference.Curves({"media": (0.12, {0: 1.0, 5: 0.5, 6: 0.45}), "moto": (0.25, {0: 1.0, 5: 0.6})}, {"Dacia": "budget"})
CAT = "key string, new_price double, segment string, retention double, confidence string, from_year int"
CAR = "id string, brand string, model string, year int, km double, fuel string, vtype string, cc int"


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [
        ("bmw serie 3", 40_000.0, "media", None, "high", 2000), ("bmw x1", 35_000.0, "media", None, "high", None), ("mercedes-benz classe c", 45_000.0, "media", 1.1, "medium", None), ("mercedes-benz cla", 42_000.0, "media", None, "low", None),
        ("renault megane", 25_000.0, None, None, None, None), ("honda pcx", 3_500.0, "scooter", 0.5, "high", None),
    ]
    return spark.createDataFrame(rows, CAT)


def test_lookup_tiers(spark, catalogue):
    names = {
        ("bmw", "serie 3"): ("bmw serie 3", 1.0), ("bmw", "320d"): ("bmw serie 3", 0.9), ("bmw", "x1"): ("bmw x1", 1.0), ("mercedes-benz", "c220 cdi"): ("mercedes-benz classe c", 0.9), ("mercedes", "cla 200"): ("mercedes-benz cla", 0.9),
        ("mercedes-benz", "classe cla 200"): ("mercedes-benz cla", 0.8), ("renault", "megane sport tourer"): ("renault megane", 0.85), ("renault", "1.5 dci megane"): ("renault megane", 0.8), ("renault", "clio"): ("renault megane", 0.6), ("", "bmw x1"): ("bmw x1", 1.0),
        ("fiat", "uno"): None, ("", ""): None, ("x", "bmw x1"): ("bmw x1", 0.95),
    }
    got = {(r["b"], r["m"]): (r["key"], r["fit"]) for r in reference.find_entries(spark.createDataFrame(list(names), "b string, m string"), catalogue).collect()}
    assert got == {k: v for k, v in names.items() if v}


def test_reference_values(spark, catalogue):
    rows = [
        ("old", "BMW", "320d", 2018, 54_000.0, "diesel", "carros", None),  # five years at 18 000: half the new price
        ("low", "BMW", "Série 3", 2018, 30_000.0, "diesel", "carros", None),  # a third of what is expected: 12 % more
        ("none", "BMW", "320d", 2018, None, "diesel", "carros", None), ("early", "BMW", "320d", 1999, 1e6, "diesel", "carros", None), ("year", "Renault", "Megane", None, None, None, None, None),
        ("scooter", "Honda", "PCX", 2018, 25_000.0, "gasolina", "motos", 125), ("unknown", "Fiat", "Uno", 2018, 1.0, "diesel", "carros", None), ("moto", None, None, 2018, None, None, "motos", 600), ("brand", "Dacia", None, None, None, None, "carros", None),
    ]
    df = spark.createDataFrame(rows, CAR)
    got = {r["id"]: r["reference"] for r in reference.with_reference(df.withColumn("km", F.when(F.col("id") == "old", 90_000.0).otherwise(F.col("km"))), catalogue, CURVES, 2023).collect()}
    assert (got["old"]["value"], got["old"]["confidence"]) == (20_000.0, 0.81) and got["old"]["high"] == pytest.approx(20_000 * 1.19)
    assert got["low"]["value"] == pytest.approx(22_400) and got["low"]["confidence"] == 0.9
    assert got["none"]["confidence"] == pytest.approx(0.689) and got["none"]["low"] == pytest.approx(20_000 * 0.76)
    assert got["early"]["confidence"] == pytest.approx(0.243) and got["early"]["residual"] == pytest.approx(max(0.12, 0.45 - 18 * 0.012))
    assert (got["year"]["age"], got["year"]["segment"]) == (10, "media") and got["year"]["value"] == pytest.approx(25_000 * (0.45 - 4 * 0.012))
    assert got["scooter"]["segment"] == "scooter" and got["scooter"]["value"] == pytest.approx(3_500 * 0.5 * 0.5)
    assert (got["unknown"]["value"], got["unknown"]["confidence"], got["unknown"]["segment"]) == (None, 0.0, "media")
    assert got["moto"]["segment"] == "moto" and got["brand"]["segment"] == "budget"
    assert reference.with_reference(df.limit(0), catalogue, CURVES, 2023).count() == 0


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_checks_and_auctions(spark):
    ref = F.struct(F.lit(10_000.0).alias("value"), F.lit(8_000.0).alias("low"), F.lit(12_000.0).alias("high"), F.lit(0.8).alias("confidence"))
    check = lambda v, ask: reference.checked_estimate(F.lit(v), ref, F.lit(ask), F.lit("carros"), CURVES)
    r = one(spark, fine=check(11_000.0, 10_000.0), high=check(25_000.0, 24_000.0), some=check(15_000.0, 14_000.0), low=check(4_000.0, 4_000.0), asked=check(11_000.0, 4_000.0), none=check(0.0, 1.0))
    assert [(r[k]["severity"], r[k]["corrected"]) for k in ("fine", "high", "some", "low", "asked", "none")] == [
        ("ok", 11_000.0), ("critical", 12_000.0), ("warning", 12_000.0), ("warning", 8_000.0), ("critical", 10_000.0), ("critical", None),
    ]
    weak = F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("high"), F.lit(0.0).alias("confidence"))
    bid = lambda y, km, x: reference.auction_estimate(F.lit(1_000.0), F.lit(y).cast("int"), F.lit(km).cast("double"), F.lit(500.0), x, 2023)
    r = one(spark, new=bid(2020, 10_000, weak), old=bid(2000, 10_000, weak), unknown=bid(None, None, weak), capped=bid(2000, 10_000, ref))
    assert [r[k]["value"] for k in ("new", "old", "unknown", "capped")] == [2_100.0, 4_000.0, 2_100.0, 4_000.0] and r["unknown"]["confidence"] == 0.35 and r["old"]["high"] == 4_500.0


def test_price_drivers(spark):
    row = dict(brand="BMW", year=2013, km=180_000.0, fuel="diesel", vtype="carros", cc=2000, gearbox="Manual", text="M Sport, livro de revisões", condition=7.0, damaged=False, owners=1, national=None, power=150, place="Grande Porto", seller="stand")
    schema = "brand string, year int, km double, fuel string, vtype string, cc int, gearbox string, text string, condition double, damaged boolean, owners int, national boolean, power int, place string, seller string"
    empty = {k: None for k in row}
    got = drivers.with_drivers(spark.createDataFrame([tuple(row.values()), tuple(empty.values())], schema), F.lit(10_000.0), 2023, 6).orderBy(F.col("brand").isNull()).collect()
    f = got[0]["drivers"]["factors"]
    # ten years at 18 000: as expected; diesel of ten years; condition a point over six; service book and first owner; belt at 60 000 past 120 000 is not due, ten years are
    want = dict(km=1.0, combustivel=0.93, condicao=1.04, historico=1.04 * 1.04, manutencao=1.0, equipamento=1.04, liquidez=1.02, regiao=1.03, sazonalidade=1.0)
    assert {k: round(v, 6) for k, v in f.items()} == {k: round(v, 6) for k, v in want.items()}
    assert got[0]["drivers"]["adjusted"] == pytest.approx(10_000 * math.prod(want.values())) and got[0]["drivers"]["top"][:2] == ["historico", "combustivel"] and got[0]["drivers"]["days_to_sell"] == 55
    assert got[1]["drivers"]["factors"]["liquidez"] == 0.95 and got[1]["drivers"]["combined"] == pytest.approx(0.95)


def test_unified_and_five_scores(spark):
    n = lambda t: F.lit(None).cast(t)
    s = scores.unified_score(F.lit(10_000.0), F.lit(10_800.0), F.lit("particular"), n("double"), n("int"), F.lit("gasolina"), n("double"), n("boolean"), n("boolean"), n("int"), n("int"))
    t = scores.unified_score(F.lit(10_000.0), F.lit(8_000.0), F.lit("x"), F.lit(60_000.0), F.lit(5), F.lit("diesel"), F.lit(6.0), F.lit(True), F.lit(True), F.lit(3), F.lit(12))
    r = one(spark, s=s, t=t, bad=scores.unified_score(F.lit(0.0), F.lit(1.0), *[n("string")] + [n("double"), n("int"), n("string"), n("double"), n("boolean"), n("boolean"), n("int"), n("int")]))
    assert (r["s"]["score"], r["s"]["grade"], r["bad"]["grade"]) == (5.0, "fair", "invalid")
    # 11 200 asked for is the benchmark: 28.6 % off; mileage two thirds of expected .15; diesel -.36; condition .1; damage -.5; national .2; owners -.4; warranty .2
    assert r["t"]["score"] == pytest.approx(5 + (3_200 / 11_200) * 16.67 + 0.15 - 0.36 + 0.1 - 0.5 + 0.2 - 0.4 + 0.2)
    rows = [("BMW", 2020, 10_000.0, True, 11_000.0, 3.0, 8.0), ("BMW M", 2021, 30_000.0, True, None, None, None), ("BMW", 2016, 1.0, True, None, None, None), (None, None, None, True, None, None, None)]
    got = [r["score"] for r in scores.five_scores(spark.createDataFrame(rows, "brand string, year int, price double, active boolean, value double, risk double, condition double").coalesce(1)).orderBy(F.desc("price")).collect()]
    assert [x["anomaly"] for x in got] == [8.0, 8.0, 8.0, 2.0]  # no brand: all of them; no price: zero
    assert got[1]["market"] == pytest.approx(5 + (12_100 - 10_000) / 12_100 * 15) and (got[1]["risk"], got[1]["condition"], got[1]["demand"]) == (7.0, 8.0, 9.0)
    assert scores.market_ranges(spark.createDataFrame(rows, "brand string, year int, price double, active boolean, value double, risk double, condition double")).where("brand = 'BMW' and year = 2020").first()["supply"] == 2


def test_engine_price(spark):
    row = lambda i, price, km=None, year=2020, model="Golf 2.0", retail=True: (i, "VW", model, year, km, price, "carros", None, retail)
    rows = [row(1, 10_000.0), row(2, 12_000.0), row(3, 14_000.0, model="GOLF GTI"), row(4, 13_000.0, retail=False), row(5, 9_000.0, year=2016, model="Polo"), row(6, None)]
    cars = spark.createDataFrame(rows, "id int, brand string, model string, year int, km double, price double, vtype string, title string, retail boolean")
    none = spark.createDataFrame([], "brand string, model string, year int, price double")
    got = {r["id"]: r for r in pricing.engine_price(cars, none, 2023).collect()}
    assert got.keys() == {1, 2, 3, 4, 5} and got[4]["level"] == "model_year" and got[4]["n"] == 3
    assert got[4]["value"] == pytest.approx(12_000 * 0.7 + 13_000 * 0.3)  # the middle of 10, 12 and 14 thousand
    assert (got[5]["level"], got[5]["n"]) == ("brand", 4) and got[5]["value"] == pytest.approx(9_000 * 1.04)  # the middle of four is 11 000, at most 4 % more
    sold = spark.createDataFrame([("VW", "Golf", 2020, 9_000.0), ("VW", "Golf", 2021, 9_600.0)], "brand string, model string, year int, price double")
    got = {r["id"]: r for r in pricing.engine_price(cars, sold, 2023).collect()}
    assert got[4]["factor"] == pytest.approx(9_300 / 12_000) and got[5]["factor"] == pytest.approx(9_300 / 11_000)


def test_conformal_level_and_small_bands(spark):
    """Band a: ten values 1 % to 10 % above their bound; too few, so the factor of all sixty decides. Level .8 * (1 + 1 / 60) of places 0 to 59."""
    rows = [("a", math.exp(k / 100), 0.5, 1.0, 0.8) for k in range(1, 11)] + [("b", math.exp(k / 100), 0.5, 1.0, 0.8) for k in range(11, 61)]
    df = spark.createDataFrame(rows + [("b", -1.0, 0.5, 1.0, 0.8), ("b", 1.0, 2.0, 1.0, 0.8)], "band string, y double, lo double, hi double, mid double")
    got = {r["band"]: r for r in valuation.conformal_factor(df, ["band"], "y", "lo", "hi", "mid").collect()}
    at = 0.8 * (1 + 1 / 60) * 59  # 47.99 of misses .01 to .60
    assert got["a"]["factor"] == pytest.approx(math.exp((at + 1) / 100)) and got["a"]["n"] == 10
    at = 0.8 * (1 + 1 / 50) * 49  # of misses .11 to .60
    assert got["b"]["factor"] == pytest.approx(math.exp((at + 11) / 100)) and got["b"]["coverage_pct"] == 0
    assert valuation.conformal_factor(df.where("band = 'a'"), ["band"], "y", "lo", "hi", "mid").count() == 0


@pytest.mark.parametrize(
    "title, kind, label",
    [
        ("Golf, sinal de 500", "blocking", "preco_sinal"), ("Crédito obrigatório", "blocking", "credito_obrigatorio"), ("retoma obrigatória", "blocking", "retoma_obrigatoria"), ("só para desmantelamento", "blocking", "para_pecas"),
        ("carro capotado", "suspicious", "acidentado"), ("não trabalha", "suspicious", "avaria_grave"), ("documentos em falta", "blocking", "sem_documentos"), ("por legalizar", "suspicious", "sem_legalizacao"),
        ("mota de água", "blocking", "nao_e_automovel"), ("caixa aberta", "blocking", "comercial_nao_ligeiro"), ("Bom estado!!", "suspicious", "titulo_generico"), ("BMW bom estado", "suspicious", None),
    ],
)
def test_guard_words(spark, title, kind, label):
    c = lambda v: F.lit(v)
    r = one(spark, g=rules.guard(c(title), c(None).cast("string"), c(8_000.0), c(2015), c(90_000.0), c("BMW"), c("X"), c("Porto"), c(9_000.0), 2023))["g"]
    assert (label in r[kind]) if label else r[kind] == []


def test_folding_is_whole_decomposition(spark):
    import unicodedata

    from marlstone.operators import fields

    words = ["Škoda", "Citroën", "ﬁat ½ ™", "straße", "Åland ýž", "İzmir", "5 €/mês", "", None, "ａｂｃ", "㎏ №", "中文", "a" * 10 + "ü"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").coalesce(1).select(fields.fold_accents(F.col("w"))).collect()]
    assert got == [None if w is None else unicodedata.normalize("NFKD", w).encode("ascii", "ignore").decode().lower() for w in words]


def test_times_keep_their_zone(spark):
    from marlstone.operators import fields

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Lisbon")
        df = spark.createDataFrame([("2024-07-01T12:00:00Z",), ("2024-07-01T12:00:00",), ("1719835200",), ("x",)], "t string").coalesce(1)
        got = [r[0] for r in df.select(F.unix_timestamp(fields.timestamp_of(F.col("t")))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [1719835200, 1719835200 - 3600, 1719835200, None]


def test_validators_and_element_scores(spark):
    from marlstone.operators import validators

    c = F.lit
    r = one(spark, ok=validators.checked(c("https://a.pt/1"), c("9000"), c("car"), c(2015), c(None).cast("int"), 2023), bad=validators.checked(c("a.pt/1"), c("x"), c("moto"), c(1970), c(600_000), 2023),
            q=validators.data_quality([c("u"), c(0), c("t"), c(None).cast("string")], [c(2015), c("")], [c("u"), c(0), c(None).cast("string"), c("")]),
            ad=validators.element_score(c(" BMW 2018 45.000 km 12.500 € "), c("/anuncio-1"), c("h2"), c(True), c(1)), no=validators.element_score(c(None).cast("string"), c(None).cast("string"), c("p"), c(False), c(9)))
    assert r["ok"].asDict() == dict(url=None, price=None, year=None, km=None, valid=True) and r["bad"].asDict() == dict(url="format", price="not_numeric", year="below", km="above", valid=False)
    assert r["q"] == 5 and r["ad"]["confidence"] == 1.0 and r["ad"]["is_listing"] and (r["no"]["confidence"], r["no"]["is_listing"]) == (0.0, False)


def test_retail_gate_and_fitted_shrinkage(spark):
    p = lambda **k: valuation.credible_profit(F.lit(100.0), F.lit(121.0), F.lit(1), **k)
    r = one(spark, half=p(fitted=F.lit(0.5)), usual=p(fitted=F.lit(None).cast("double")), sold=p(retail=F.lit(False)), kept=p(fitted=F.lit(0.5), retail=F.lit(True)))
    assert r["half"] == pytest.approx(10) and r["usual"] == pytest.approx(100 * 1.21**0.07 - 100) and r["sold"] is None and r["kept"] == pytest.approx(10)
    rows = [(1, 100.0, 100.0 * math.exp(x)) for x in (0.1, -0.1)] + [(9, 100.0, 100.0 * math.exp(x)) for x in (0.2, -0.2)] + [(30, 100.0, 100.0)]
    got = {r["tier"]: r["lam"] for r in valuation.with_fitted_lambda(spark.createDataFrame(rows, "n int, p double, v double"), F.col("n"), "p", "v", 2).collect()}
    assert got["thin"] == pytest.approx(1) and got["solid"] == pytest.approx(0.25) and got["dense"] is None  # spreads .1 and .2; one row is too few


def test_names_are_folded_once_for_each_kind(spark, catalogue):
    """The rows' own pass has no pattern in it: names are folded on their distinct combinations."""
    df = spark.createDataFrame([("Dacia", "Sandero", 2018, 1.0, "diesel", "carros", 1000)] * 3, "brand string, model string, year int, km double, fuel string, vtype string, cc int")
    found = reference.with_reference(df, catalogue, CURVES, 2023)
    assert found.count() == 3 and "regexp" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_market_of_groups_without_windows_over_rows(spark):
    rows = [("a", "x", 1, 10.0), ("a", "x", 1, 20.0), ("a", "x", None, 60.0), ("a", None, 1, 7.0), ("b", "x", 1, None)]
    found = valuation.with_market(spark.createDataFrame(rows, "make string, model string, year int, price double"), ["make", "model"], ["year"], "price", "med", "comps")
    assert sorted((r["make"], r["model"] or "", r["med"], r["comps"]) for r in found.collect() if r["make"] == "a") == [("a", "", 7.0, 1), ("a", "x", 30.0, 1), ("a", "x", 30.0, 2), ("a", "x", 30.0, 2)]
    assert found.where("make = 'b'").first()["med"] is None and "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
