"""Estimates: simple statistical pricer, blends of opinions with a band, interval-bound scores, depreciation, retention, resale profit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import fields

#: Yearly loss and its cap, expected mileage a year, bounds of the mileage adjustment.
YEARLY_LOSS, MOST_LOSS, KM_YEAR, KM_LOW, KM_HIGH = 0.08, 0.8, 15_000, 0.7, 1.15
#: Band in which another opinion counts, weights of model and reference, and their limits.
INLIER, MODEL_WEIGHT, REFERENCE_WEIGHT, MODEL_BELOW, REFERENCE_FROM = (0.4, 2.5), 0.30, 0.20, 0.60, 0.50
#: Bounds of a score by confidence.
SCORE_BOUNDS = ((0.65, 0.0, 10.0), (0.45, 2.0, 8.0), (0.25, 3.5, 6.5))
#: Repair cost by condition; stamp duty, transfer tax, sale commission and fixed expenses.
REPAIRS, REPAIR_WORST = ((8.0, 0.0), (6.0, 500.0), (4.0, 1500.0), (2.0, 3000.0)), 5000.0
STAMP, TRANSFER, SALE_COMMISSION, FIXED = 0.005, 0.05, 0.07, 250.0


def upper_median(df: DataFrame, keys: list[str], c: str, least: int) -> DataFrame:
    """Value at place n // 2 of each sorted group of at least ``least``, from counts of equal values."""
    g = df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*keys)
    g = g.withColumn("_hi", F.sum("_m").over(w.orderBy(c))).withColumn("_n", F.sum("_m").over(w)).where(F.col("_n") >= least)
    return g.where(F.col("_hi") > F.floor(F.col("_n") / 2)).groupBy(*keys).agg(F.min(c).alias("median"), F.first("_n").alias("n"))


def statistical_price(df: DataFrame, brand: str, year: str, km: str, price: str, asof_year: int) -> DataFrame:
    """``df`` with ``method`` and ``estimate``: the upper median of brand and year (three or more), of the brand, or of all.

    The latter two lose 8 % a year, at most 80 %; mileage far from 15 000 km a year moves the estimate within 0.7 to 1.15.
    """
    priced = df.where(F.col(price).between(500.000001, 499_999.999999) & F.col(year).isNotNull() & F.col(brand).isNotNull())
    by_year = upper_median(priced, [brand, year], price, 3).withColumnsRenamed({"median": "_m1", "n": "_n1"})
    by_brand = upper_median(priced, [brand], price, 3).withColumnsRenamed({"median": "_m2", "n": "_n2"})
    every = upper_median(priced.withColumn("_all", F.lit(1)), ["_all"], price, 1).select(F.col("median").alias("_m3"))
    x = df.join(by_year, [brand, year], "left").join(by_brand, brand, "left").join(F.broadcast(every), F.lit(True), "left")
    method = F.when(F.col("_m1").isNotNull(), "brand_year").when(F.col("_m2").isNotNull(), "brand").when(F.col("_m3").isNotNull(), "global")
    age = F.lit(asof_year) - F.col(year)
    worn = F.when((method != "brand_year") & (age > 0), 1 - F.least(F.lit(MOST_LOSS), age * YEARLY_LOSS)).otherwise(1.0)
    ratio = F.col(km) / (KM_YEAR * F.greatest(F.lit(1), F.coalesce(age, F.lit(0))))
    moved = F.when(ratio > 1.5, F.greatest(F.lit(KM_LOW), 1 - (ratio - 1.5) * 0.1)).when((ratio < 0.5) & (F.col(km) > 0), F.least(F.lit(KM_HIGH), 1 + (0.5 - ratio) * 0.1)).otherwise(1.0)
    return x.withColumn("method", method).withColumn("estimate", F.coalesce("_m1", "_m2", "_m3") * worn * moved).drop("_m1", "_n1", "_m2", "_n2", "_m3")


def bounded_score(discount_pct: Column, confidence: Column, doubtful: Column | None = None) -> Column:
    """5 and one point for each 6 % below the market, within bounds that the confidence widens; at most 6 for a doubtful offer."""
    raw = 5 + F.greatest(F.lit(-5.0), F.least(F.lit(5.0), discount_pct / 6))
    bound = lambda k, other: F.coalesce(*[F.when(confidence >= b[0], b[k]) for b in SCORE_BOUNDS], F.lit(other))
    lo, hi = bound(1, 4.5), bound(2, 5.5)
    if doubtful is not None:
        hi = F.when(F.coalesce(doubtful, F.lit(False)), F.least(hi, F.lit(6.0))).otherwise(hi)
    return F.when(discount_pct.isNotNull(), F.greatest(lo, F.least(hi, raw)))


def least_band(low: Column, high: Column, center: Column, confidence: Column) -> tuple[Column, Column]:
    """Bounds around a center, at least 6 to 35 % wide, the wider the less confident; bounds on the wrong side are not used."""
    share = F.least(F.lit(0.35), F.greatest(F.lit(0.06), 0.45 * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)))))
    floor, ceiling = center * (1 - share), center * (1 + share)
    return F.when(low <= center, F.least(low, floor)).otherwise(floor), F.when(high >= center, F.greatest(high, ceiling)).otherwise(ceiling)


def blended(value: Column, low: Column, high: Column, confidence: Column, model: Column, reference: Column, reference_confidence: Column) -> Column:
    """Struct value, low, high, confidence, opinions: the comparables' estimate joined by the model's, where confidence is low, and
    by a reliable reference, if they lie within 0.4 to 2.5 of it. Agreement raises the confidence; the band covers all of them."""
    near = lambda c: F.coalesce(F.try_divide(c, value).between(*INLIER) & (c > 0) & (value > 0), F.lit(False))
    base = F.greatest(F.lit(0.40), F.least(F.lit(0.95), confidence))
    with_model = near(model) & (confidence < MODEL_BELOW)
    with_ref = near(reference) & F.coalesce(reference_confidence >= REFERENCE_FROM, F.lit(False))
    part = lambda on, c, w: F.when(on, c * w).otherwise(0.0)
    agree = lambda on, c, by: F.when(on & (F.abs(c - value) / value <= by), 0.05).otherwise(0.0)
    one = F.lit(1.0)

    def joined(x: Column) -> Column:
        base, with_model, with_ref = x["base"], x["model"], x["reference"]
        center = (value * base + part(with_model, model, MODEL_WEIGHT) + part(with_ref, reference, REFERENCE_WEIGHT)) / (base + part(with_model, one, MODEL_WEIGHT) + part(with_ref, one, REFERENCE_WEIGHT))
        uncrossed = ~F.coalesce(low > high, F.lit(False))
        lo, hi = F.least(F.when(uncrossed, low), F.when(with_model, model * 0.9)), F.greatest(F.when(uncrossed, high), F.when(with_model, model * 1.1))
        conf = F.least(F.lit(0.95), F.greatest(base + agree(with_model, model, 0.15) + agree(with_ref, reference, 0.20), confidence))
        return F.struct(center.alias("value"), lo.alias("low"), hi.alias("high"), conf.alias("confidence"), (with_model.cast("int") + with_ref.cast("int")).alias("opinions"))

    def banded(x: Column) -> Column:
        band = least_band(x["low"], x["high"], x["value"], x["confidence"])
        return F.struct(x["value"].alias("value"), band[0].alias("low"), band[1].alias("high"), x["confidence"].alias("confidence"), x["opinions"].alias("opinions"))

    # each step is computed once for a row
    sides = F.struct(base.alias("base"), with_model.alias("model"), with_ref.alias("reference"))
    return F.when(value > 0, fields.computed_once(fields.computed_once(sides, joined), banded))


def combined_price(statistical: Column, comparable: Column, risk: Column, condition: Column) -> Column:
    """Eighty parts statistical, twenty parts comparable (either alone if the other is missing), moved by risk and condition."""
    base = F.when(statistical.isNull(), F.when(comparable > 0, comparable)).when(comparable > 0, statistical * 0.8 + comparable * 0.2).otherwise(statistical)
    risk_part = F.when(risk > 7, -0.10).when(risk < 3, 0.05).otherwise(0.0)
    state_part = F.when(condition < 5, -0.10).when(condition > 8, 0.05).otherwise(0.0)
    return F.when(base > 0, base * (1 + risk_part + state_part))


def yearly_loss(df: DataFrame, keys: list[str], year: str, c: str, n: str | None = None) -> DataFrame:
    """Euros a year between the medians of the oldest and the newest year of each group, where that is positive; ``n`` counts what a row stands for."""
    middle = F.percentile(c, F.lit(0.5), F.col(n)) if n else F.median(c)
    g = df.where(F.col(year).isNotNull() & F.col(c).isNotNull()).groupBy(*keys, year).agg(middle.alias("_p"))
    s = g.groupBy(*keys).agg(F.min_by("_p", year).alias("_old"), F.max_by("_p", year).alias("_new"), (F.max(year) - F.min(year)).alias("span"))
    return s.select(*keys, "span", F.try_divide(F.col("_old") - F.col("_new"), F.col("span")).alias("per_year")).where("per_year > 0")


def implied_retention(df: DataFrame, key: str, price: str, base: Column, old: Column, least: int = 5) -> DataFrame:
    """New retention of each catalogue key: half the old one, half the median of price over base within .3 to 2, between .5 and 1.5."""
    r = df.withColumn("_r", F.try_divide(F.col(price), base)).withColumn("_old", old).where("_r between 0.3 and 2.0")
    g = r.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.median("_r").alias("implied"), F.max("_old").alias("old")).where(F.col("n") >= least)
    return g.withColumn("retention", F.least(F.lit(1.5), F.greatest(F.lit(0.5), 0.5 * F.col("old") + 0.5 * F.col("implied"))))


def auction_multiple(age: Column, km: Column) -> Column:
    return F.when((age > 15) | (km > 250_000), 3.5).when((age > 10) | (km > 150_000), 2.5).when(age > 5, 2.0).otherwise(1.6)


def resale_profit(price: Column, resale: Column, auction: Column, condition: Column) -> Column:
    """Struct of taxes, repairs, commission, net profit and its share of the price; an auction's price holds the transfer tax."""
    p, r = F.coalesce(price, F.lit(0.0)), F.coalesce(resale, F.lit(0.0))
    repair = F.coalesce(*[F.when(F.coalesce(condition, F.lit(6.0)) >= t, c) for t, c in REPAIRS], F.lit(REPAIR_WORST))
    taxes = p * F.when(auction, STAMP).otherwise(STAMP + TRANSFER)
    fee = r * SALE_COMMISSION
    net = r - p - taxes - repair - fee - FIXED
    return F.struct(taxes.alias("taxes"), repair.alias("repairs"), fee.alias("commission"), net.alias("net"), F.when(p > 0, net / p * 100).otherwise(0.0).alias("net_pct"))


def fuel_proxy(fuel: Column, engine: Column) -> Column:
    """Five points for an electric, four for a hybrid, three for a diesel; else four under 1.5 litres, three under 2, two above or unknown."""
    return F.when(fuel == "Electric", 5.0).when(fuel == "Hybrid", 4.0).when(fuel == "Diesel", 3.0).when(engine < 1.5, 4.0).when(engine < 2.0, 3.0).otherwise(2.0)


def feature_vector(df: DataFrame, year: str, km: str, fuel: str, place: str, asof_year: int, premium: dict[str, float], places: dict[str, float]) -> DataFrame:
    """Model features of a listing: age, mileage terms, fuel and place premiums (1 where not listed)."""
    age = F.greatest(F.lit(0), F.lit(asof_year) - F.col(year))
    table = lambda m, c: F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col(c)], F.lit(1.0))
    k = F.col(km)
    return df.withColumns(
        {
            "f_age": age.cast("double"), "f_km_per_year": k / F.greatest(age, F.lit(1)), "f_log_km": F.log1p(k), "f_km_excess": F.greatest(F.lit(0.0), k - 150_000), "f_km_extreme": (k > 250_000).cast("double"),
            "f_fuel": table(premium, fuel), "f_place": table(places, place),
        }
    )
