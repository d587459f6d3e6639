import pytest
from marlstone.operators import decisions, economics, estimates, rules
from pyspark.sql import functions as F

NONE = "cast(null as double)"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def val(x):
    return F.lit(None).cast("double") if x is None else F.lit(float(x))


@pytest.mark.parametrize(
    "given, verdict, failed",
    [
        ((0.9, 5000, 10, 0.1, 10, 9000, 10000), "BUY", []),
        ((0.9, 5000, 10, 0.1, 10, 10500, 10000), "NEGOTIATE", ["price"]),
        ((0.9, 5000, 10, 0.1, 10, 12000, 10000), "PASS", ["price"]),
        ((0.5, 5000, 10, 0.1, 10, 9000, 10000), "WATCH", ["confidence"]),
        ((None, 5000, None, None, None, None, None), "WATCH", ["confidence"]),
        ((0.9, None, 10, 0.1, 10, 9000, 10000), "PASS", ["profit"]),
        ((0.9, 500, 10, 0.1, 10, 9000, 10000), "WATCH", ["profit"]),
        ((0.9, 5000, 80, 0.1, 10, 9000, 10000), "PASS", ["risk"]),
        ((0.9, 5000, 10, 0.75, 10, 9000, 10000), "REVIEW", ["repair"]),
        ((0.9, 5000, 10, 0.1, 70, 9000, 10000), "PASS", ["discount"]),
        ((0.9, 5000, 70, 0.5, 55, 0, 10000), "PASS", []),
    ],
)
def test_gates(spark, given, verdict, failed):
    got = one(spark, decisions.gates(*map(val, given)))
    assert (got["verdict"], got["failed"]) == (verdict, failed)


def test_highest_price_leaves_exactly_the_target(spark):
    """At the price found profit and return hold; half a euro above one of them does not."""
    for value, condition, days in ((20000, 6, 45), (3000, 2, 60), (60000, 9, 30), (4000, 8, 45)):
        moto = F.lit(False)
        price = one(spark, decisions.max_buy_price(val(value), val(condition), moto, val(None), F.lit(days)))
        exit_value = round(value * 0.95 * 0.97, 2)
        selling = one(spark, economics.selling_costs(val(exit_value), F.lit(days), moto))["total"]

        def left(p):
            cost = p + one(spark, economics.acquisition_costs(val(p), val(condition), moto, val(None)))
            net = exit_value - cost - selling
            return net - 1000, net / cost - 0.12

        assert min(left(price)) >= -1e-6 and min(left(price + 0.5)) < 0
    assert one(spark, decisions.max_buy_price(val(None), val(6), F.lit(False), val(None), F.lit(45))) is None
    assert one(spark, decisions.max_buy_price(val(900), val(1), F.lit(False), val(None), F.lit(45))) is None


def test_realism(spark):
    def verdict(asking, estimate, low, high, conf, comps, cost):
        return one(spark, decisions.realism(*map(val, (asking, estimate, low, high, conf, comps, cost)), F.lit(60), F.lit(False)))["verdict"]

    assert verdict(None, 9000, 8000, 9900, 0.8, 9, 9000) == verdict(8000, 0, 0, 0, 0.8, 9, 9000) == "indeterminado"
    assert verdict(8000, 10000, 5000, 12000, 0.8, 3, 9000) == "indeterminado"  # few comparables and a wide interval
    assert verdict(3000, 10000, 9000, 11000, 0.8, 9, 3600) == "suspeito"
    assert verdict(9500, 10000, 9000, 11000, 0.8, 9, 10200) == "sem_margem"
    assert verdict(17500, 21000, 20000, 22000, 0.8, 9, 17800) == "marginal"
    assert verdict(15000, 21000, 20500, 22000, 0.8, 9, 15600) == "negocio"


EVIDENCE = [
    ("8.250 €", 8250, "EUR", "total", None), ("a partir de 149 EUR por mês", 149, "EUR", "monthly", "preco_monthly_nao_retail"), ("1.800 € sinal", 1800, "EUR", "entry", "preco_entry_nao_retail"),
    ("lance inicial 2 €", 2, "EUR", "auction_start", "preco_auction_start_nao_retail"), ("current bid £ 3,100", 3100, "GBP", "auction_current", "moeda_nao_eur"), ("Renault 5 turbo", None, None, "unknown", "preco_sem_evidencia_monetaria"),
    ("", None, None, "unknown", "preco_ausente"), (None, None, None, "unknown", "preco_ausente"), ("€ 12.345,67", 12345.67, "EUR", "total", None), ("$ 9,999.50", 9999.5, "USD", "total", "moeda_nao_eur"),
    ("17500", 17500, "EUR", "total", None), ("-5 €", -5, "EUR", "total", "preco_zero_ou_negativo"),
]


@pytest.mark.parametrize("raw, value, currency, kind, rejection", EVIDENCE)
def test_price_evidence(spark, raw, value, currency, kind, rejection):
    got = one(spark, rules.price_evidence(F.lit(raw).cast("string")))
    assert (got["value"], got["currency"], got["kind"], got["rejection"]) == (value, currency, kind, rejection)


def test_opportunity_labels(spark):
    label = lambda *a: one(spark, rules.opportunity_label(*map(val, a)))
    assert label(20500, 20000, 18500, 21500, 0.6, 9) == "dentro_do_mercado"
    assert label(20000, None, None, None, 0.6, 9) == label(20000, 21000, None, None, 0.6, 0) == "dados_insuficientes"
    assert label(17000, 20000, 18500, 21500, 0.6, 9) == "excelente_oportunidade" and label(17000, 20000, 18500, 21500, 0.4, 9) == "boa_oportunidade"
    assert label(17000, 20000, 18500, 21500, 0.6, 2) == label(12000, 20000, 18500, 21500, 0.6, 9) == label(20000, 20000, 18500, 21500, 0.1, 9) == "requer_validacao"
    assert label(22000, 20000, 18500, 21500, 0.6, 9) == "ligeiramente_acima" and label(25000, 20000, 18500, 21500, 0.6, 9) == "muito_acima_do_mercado"


def test_bounded_score_and_blend(spark):
    score = lambda d, c: one(spark, estimates.bounded_score(val(d), val(c)))
    assert score(0, 0.7) == 5 and score(60, 0.7) == 10 and score(60, 0.5) == 8 and score(-60, 0.3) == 3.5 and score(60, 0.1) == 5.5 and score(None, 0.9) is None
    b = one(spark, estimates.blended(*map(val, (10000, None, None, 0.5, 12000, 9000, 0.6))))
    assert b["value"] == pytest.approx((10000 * 0.5 + 12000 * 0.3 + 9000 * 0.2) / 1.0) and b["opinions"] == 2 and b["low"] < b["value"] < b["high"]
    assert one(spark, estimates.blended(*map(val, (10000, None, None, 0.5, 99000, None, None))))["opinions"] == 0
