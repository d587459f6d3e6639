"""Deal economics: running costs, verdicts, grades, price plausibility. Results are not rounded; null inputs as stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.quantiles import whole_quantiles
from marlstone.operators.kinds import written

#: Registration of ownership (online, at a desk), inspection (car, motorcycle), paperwork of an import.
REGISTRATION, INSPECTION, IMPORT_PAPERS = (55.30, 65.00), (32.00, 22.00), 550.00
#: Reconditioning cost from a condition score upwards; below all of them the last cost.
RECONDITIONING, RECONDITIONING_WORST = ((8.5, 150.0), (7.0, 400.0), (5.5, 900.0), (4.0, 1800.0), (2.5, 3200.0)), 5500.0
MOTORCYCLE_RECONDITIONING, RECONDITIONING_CAP, UNKNOWN_CONDITION = 0.45, 0.45, 6.0
#: Warranty provision, its motorcycle factor, yearly cost of capital, window of negotiation above the highest price.
WARRANTY, MOTORCYCLE_WARRANTY, CAPITAL, NEGOTIATION = 0.025, 0.6, 0.06, 0.10
#: Score steps of deal grades and rating texts.
GRADES = ((9.0, "exceptional"), (7.5, "excellent"), (6.0, "good"), (4.0, "fair"))
RATINGS = ((9.0, "Excelente"), (7.5, "Muito Bom"), (6.0, "Bom"), (4.0, "Razoável"))
#: Upper ends of price-to-reference bands (the fourth band holds its end).
PLAUSIBLE = ((0.35, "suspeito"), (0.60, "oportunidade_a_verificar"), (0.85, "bom_negocio"))
#: Fixed values of the net-profit estimate: tax share, fixed costs, repairs by mileage, auction commission.
NET_TAX, NET_FIXED, NET_REPAIRS, NET_REPAIRS_MOST, AUCTION_SHARE = 0.155, 500.0, ((50000, 0.0), (100000, 500.0), (150000, 1000.0)), 1500.0, 0.18


def _from(c: Column, steps: tuple, otherwise) -> Column:
    """Value of the highest step that ``c`` reaches."""
    return F.coalesce(*[F.when(c >= least, v) for least, v in steps], F.lit(otherwise))


def reconditioning(condition: Column, price: Column, motorcycle: Column) -> Column:
    """Cost before a resale by condition score (null: 6), at most 45 % of a positive price."""
    cost = _from(F.coalesce(condition, F.lit(UNKNOWN_CONDITION)), RECONDITIONING, RECONDITIONING_WORST) * F.when(motorcycle, MOTORCYCLE_RECONDITIONING).otherwise(1.0)
    return F.when(price > 0, F.least(cost, price * RECONDITIONING_CAP)).otherwise(cost)


def acquisition_costs(price: Column, condition: Column, motorcycle: Column, import_tax: Column, transport: Column | None = None, repairs: Column | None = None, online: bool = True, inspected: bool = True) -> Column:
    """All costs on top of the price; a null ``import_tax`` marks a national vehicle, null ``repairs`` are estimated."""
    work = reconditioning(condition, price, motorcycle)
    inspection = F.when(motorcycle, INSPECTION[1]).otherwise(INSPECTION[0]) if inspected else F.lit(0.0)
    imported = F.when(import_tax.isNotNull(), import_tax + IMPORT_PAPERS).otherwise(0.0)
    moved = F.lit(0.0) if transport is None else F.coalesce(transport, F.lit(0.0))
    return REGISTRATION[0 if online else 1] + inspection + imported + moved + (work if repairs is None else F.coalesce(repairs, work))


def selling_costs(price: Column, days: Column, motorcycle: Column, fees: Column | None = None) -> Column:
    """Struct of warranty, holding and total cost of a sale; a null price counts as zero, negative days as none."""
    p = F.coalesce(price, F.lit(0.0))
    warranty = p * WARRANTY * F.when(motorcycle, MOTORCYCLE_WARRANTY).otherwise(1.0)
    holding = p * CAPITAL * F.greatest(days, F.lit(0)) / 365
    return F.struct(warranty.alias("warranty"), holding.alias("holding"), (warranty + holding + (0.0 if fees is None else F.coalesce(fees, F.lit(0.0)))).alias("total"))


def buy_verdict(asking: Column, most: Column) -> Column:
    """BUY_ZONE up to the highest price, NEGOTIATE up to 10 % above it, else PASS (also if either is null or not positive)."""
    return F.when((asking > 0) & (most != 0) & (asking <= most), "BUY_ZONE").when((asking > 0) & (most != 0) & (asking <= most * (1 + NEGOTIATION)), "NEGOTIATE").otherwise("PASS")


def statistical_score(price: Column, value: Column) -> Column:
    """Struct of score (5 and one point per 5 % below the value, within 0..10), grade, profit; null without value or positive price."""
    saved = F.when(value > 0, (value - price) / value * 100).otherwise(0.0)
    score = F.least(F.lit(10.0), F.greatest(F.lit(0.0), 5 + saved / 5))
    out = F.struct(score.alias("score"), _from(score, GRADES, "poor").alias("grade"), F.greatest(F.lit(0.0), value - price).alias("profit"), F.greatest(F.lit(0.0), saved).alias("profit_pct"))
    return F.when((price > 0) & value.isNotNull(), out)


def rating(score: Column) -> Column:
    return F.when(score.isNull(), "N/A").otherwise(_from(score, RATINGS, "Fraco"))


def plausibility(price: Column, reference: Column, confidence: Column, least: float = 0.35) -> Column:
    """Band of price over reference; ``indeterminado`` without a reference of enough confidence, null for a null price."""
    r = F.try_divide(price, reference)
    band = F.when(r <= 1.15, "preco_de_mercado").when(r <= 1.4, "caro").when(r > 1.4, "muito_caro")
    for top, name in reversed(PLAUSIBLE):
        band = F.when(r < top, name).otherwise(band)
    return F.when(reference.isNull() | (reference == 0) | (F.coalesce(confidence, F.lit(0.0)) < least), "indeterminado").otherwise(band)


def net_profit(price: Column, value: Column, km: Column, auction: Column) -> Column:
    """Struct of gross (not below zero), net and net share in percent; a null value counts as the price, nulls else as zero."""
    p, k = F.coalesce(price, F.lit(0.0)), F.coalesce(km, F.lit(0.0))
    gross = F.greatest(F.lit(0.0), F.coalesce(value, p) - p)
    repairs = F.coalesce(*[F.when(k < top, cost) for top, cost in NET_REPAIRS], F.lit(NET_REPAIRS_MOST))
    net = gross - p * NET_TAX - repairs - NET_FIXED - F.when(auction, p * AUCTION_SHARE).otherwise(0.0)
    return F.struct(gross.alias("gross"), net.alias("net"), F.when(p > 0, net / p * 100).otherwise(0.0).alias("net_pct"))


def profit_badge(net: Column, pct: Column) -> Column:
    share = F.coalesce(pct, F.lit(0.0))
    return F.when(net.isNull(), "S/ DADOS").when((net > 3000) & (share > 8), "EXCELENTE").when((net > 1000) & (share > 5), "BOM").when(net > 0, "MARGINAL").otherwise("PREJUÍZO")


def price_range(predicted: Column, confidence: Column, tolerance: float = 0.1) -> Column:
    """Struct of bounds, wider the less confident; null confidence gives null bounds."""
    t = tolerance * (2 - confidence)
    return F.struct((predicted * (1 - t)).alias("low"), (predicted * (1 + t)).alias("high"), (t * 100).alias("tolerance_pct"))


def calibration_ratio(df: DataFrame, price: str, predicted: str, least: int = 10) -> DataFrame:
    """Median, mean and population deviation of price over a positive prediction within .3 to 3; no row below ``least`` of them.

    Equal ratios are counted first and so written; the median comes from running sums over ranges of them.
    """
    r = F.when(F.col(predicted) > 0, F.col(price) / F.col(predicted))
    kept = written(df.select(r.alias("r")).where("r between 0.3 and 3.0").groupBy("r").agg(F.count(F.lit(1)).alias("m")))
    total = kept.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), (F.sum(F.col("r") * F.col("m")) / F.sum("m")).alias("mean_ratio"))
    off = F.col("r") - F.col("mean_ratio")
    spread = kept.crossJoin(F.broadcast(total)).agg(F.sqrt(F.sum(off * off * F.col("m")) / F.sum("m")).alias("std_ratio"))
    middle = whole_quantiles(kept, "r", {"median_ratio": 0.5}, "m")
    return total.crossJoin(middle).crossJoin(spread).where(F.col("n") >= least).select("n", "median_ratio", "mean_ratio", "std_ratio")


def threshold_sweep(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Precision, recall, F1 and accuracy at thresholds .10 to .95 (undefined ratios are zero).

    Rows are counted once by how many thresholds they reach, so only 19 rows are spread over the thresholds. Null scores
    reach none; rows without a truth are out; an empty table gives no rows.
    """
    marks = F.array(*[F.lit(k / 20) for k in range(2, 20)])
    reached = df.where(F.col(truth).isNotNull()).select(F.size(F.filter(marks, lambda t: t <= F.coalesce(F.col(score), F.lit(-1.0)))).alias("k"), F.col(truth).cast("boolean").alias("y"))
    counts = reached.groupBy("k").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    at = counts.select("*", F.posexplode(marks).alias("i", "threshold")).withColumn("hit", F.col("i") < F.col("k")).groupBy("threshold")
    s = at.agg(F.sum(F.when(F.col("hit"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("hit"), F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, p, n = map(F.col, ("tp", "fp", "p", "n"))
    return s.select("threshold", ratio(tp, tp + fp).alias("precision"), ratio(tp, p).alias("recall"), ratio(2 * tp, tp + fp + p).alias("f1"), ratio(tp + n - fp, p + n).alias("accuracy"))


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """The lowest threshold of the best value; .5 and zero if no value is above zero."""
    top = sweep.where(F.col(metric) > 0).agg(F.max(F.struct(F.col(metric), (-F.col("threshold")).alias("t"))).alias("b"))
    return top.select(F.coalesce(-F.col("b.t"), F.lit(0.5)).alias("threshold"), F.coalesce(F.col(f"b.{metric}"), F.lit(0.0)).alias("value"))


def snapshot(df: DataFrame, value: str, score: str, exact: tuple = (500, 10000)) -> DataFrame:
    """One row of counts, exact values and bands of the scores that have a value."""
    v, s = F.col(value), F.col(score)
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count(v).alias("with_value"), F.count_if(v.isNull()).alias("without_value"), *[F.count_if(v == e).alias(f"exact_{e}") for e in exact],
        F.avg(F.when(v.isNotNull(), s)).alias("score_mean"), F.count_if(v.isNotNull() & (s < 3)).alias("score_lt3"), F.count_if(v.isNotNull() & (s >= 3) & (s < 7)).alias("score_3_7"), F.count_if(v.isNotNull() & (s >= 7)).alias("score_gte7"),
    )


def column_profile(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row per column: counts, missing share, moments of numeric columns, distinct values and the most frequent one (ties: the smallest) of others.

    All numeric columns share one aggregate; a categorical column is first counted by value.
    """
    rows = F.count(F.lit(1))
    cells = [F.struct(F.lit(c).alias("name"), F.lit("numerical").alias("type"), F.count(c).alias("n"), (rows - F.count(c)).alias("missing"), F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top")) for c in numeric]
    out = df.agg(F.array(*cells).alias("cells")).selectExpr("inline(cells)") if numeric else None
    for c in categorical:
        by = df.groupBy(F.col(c).cast("string").alias("v")).agg(rows.alias("k"))
        known, nothing = F.col("v").isNotNull(), F.lit(None).cast("double")
        top = F.min(F.when(known, F.struct((-F.col("k")).alias("k"), "v")))
        one = by.agg(F.coalesce(F.sum(F.when(known, F.col("k"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~known, F.col("k"))), F.lit(0)).alias("missing"), F.count("v").alias("unique"), top["v"].alias("top"))
        one = one.select(F.lit(c).alias("name"), F.lit("categorical").alias("type"), "n", "missing", *[nothing.alias(x) for x in ("mean", "std", "min", "max")], "unique", "top")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("missing_pct", F.try_divide(F.col("missing") * 100.0, F.col("n") + F.col("missing")))
