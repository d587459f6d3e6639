"""Valuation and ranking: market medians, deal scores, reliability, opportunity classes, comparables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import quantiles, stats
from marlstone.operators.kinds import written


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def market_median(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Median of the positive prices within 1.5 exclusive-quartile ranges; null below three prices, all of them if none is left.

    Equal prices of a group are counted first; order statistics then come from window sums of these counts, so a group is
    never gathered into one value.
    """
    g = df.where(F.col(c) > 0).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*keys)
    g = g.withColumn("_hi", F.sum("_m").over(w.orderBy(c))).withColumn("_lo", F.col("_hi") - F.col("_m") + 1).withColumn("_n", F.sum("_m").over(w))

    def at(pos: Column) -> Column:  # the value at a 1-based place of the sorted group
        return F.max(F.when((F.col("_lo") <= pos) & (pos <= F.col("_hi")), F.col(c))).over(w)

    n = F.col("_n")
    for q in (1, 3):
        j = F.greatest(F.lit(1), F.least(n - 1, F.floor((n + 1) * q / 4)))
        d = (n + 1) * q - j * 4
        g = g.withColumn(f"_q{q}", (at(j) * (4 - d) + at(j + 1) * d) / 4)
    reach = (F.col("_q3") - F.col("_q1")) * 1.5
    g = g.withColumn("_in", F.col(c).between(F.col("_q1") - reach, F.col("_q3") + reach))
    out = g.groupBy(*keys).agg(F.sum("_m").alias("n"), F.percentile(c, F.lit(0.5), F.when(F.col("_in"), F.col("_m")).otherwise(0)).alias("_kept"), F.percentile(c, F.lit(0.5), F.col("_m")).alias("_all"))
    return out.select(*keys, "n", F.when(F.col("n") >= 3, F.coalesce("_kept", "_all")).alias("market_median"))


def with_market(df: DataFrame, keys: list[str], within: list[str], c: str, mean: str, comps: str) -> DataFrame:
    """``df`` with the mean of ``c`` over listings of the same keys and the number of listings that agree in ``within`` too.

    One table of all groups is summed first and joined to the rows, so no group's rows are gathered or sorted in a task.
    """
    every = [*keys, *within]
    g = df.groupBy(*every).agg(F.sum(c).alias("_s"), F.count(c).alias("_n"), F.count(F.lit(1)).alias(comps))
    w = Window.partitionBy(*keys)  # over groups
    g = written(g.withColumn(mean, F.try_divide(F.sum("_s").over(w), F.sum("_n").over(w))).select(*[F.col(k).alias(f"_g_{k}") for k in every], mean, comps))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in every])
    return df.join(g, same).drop(*[f"_g_{k}" for k in every])


def deal_score(price: Column, median: Column, km: Column) -> Column:
    """5 plus 0.15 for each percent below the median, mileage tiers, within 0..10."""
    diff = F.try_divide((median - price) * 100, median)
    tier = F.when(km < 30_000, 1.0).when(km < 80_000, 0.3).when(km > 200_000, -2.0).when(km > 130_000, -1.0).otherwise(0.0)
    return clamp(F.lit(5.0) + diff * 0.15 + tier, 0.0, 10.0)


def price_delta(price: Column, market: Column) -> Column:
    """Struct ok, discount_eur, discount_pct, above_market_pct; ok needs plausible prices and a ratio in 0.2..3."""
    ratio = F.try_divide(price, market)
    ok = F.coalesce(price.between(300, 2e6) & (market > 0) & (market <= 2e6) & ratio.between(0.2, 3.0), F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, market - price).alias("discount_eur"), F.when(ok, (market - price) / market * 100).alias("discount_pct"), F.when(ok, F.greatest(F.lit(0.0), (price - market) / market * 100)).alias("above_market_pct"))


def step_round(v: Column) -> Column:
    """Steps of 100, 500 and 1000 by size, half to even."""
    step = F.when(v < 20_000, 100).when(v < 60_000, 500).otherwise(1000)
    return F.bround(v / step) * step


def tier(n: Column) -> Column:
    return F.when(n >= 20, "dense").when(n >= 8, "solid").when(n >= 3, "sparse").otherwise("thin")


#: Shrinkage of a valuation towards the asking price by comparable tier.
LAMBDA = {"thin": 0.07, "sparse": 0.20, "solid": 0.35, "dense": 1.0}


def shrink(price: Column, value: Column, n: Column, fitted: Column | None = None) -> Column:
    """Log-space shrinkage price * exp(lambda * ln(value / price)); lambda is the fitted one where there is one, else the tier's."""
    usual = F.coalesce(*[F.when(tier(n) == k, v) for k, v in LAMBDA.items()])
    lam = usual if fitted is None else F.coalesce(fitted, usual)
    return F.when((price > 0) & (value > 0), price * F.exp(lam * F.ln(value / price)))


def credible_profit(price: Column, value: Column, n: Column, cap: float = 0.20, gap: float = 0.50, fitted: Column | None = None, retail: Column | None = None) -> Column:
    """Profit after shrinkage; 0 if the raw gap is implausible, at most ``cap`` of the price, null without price or value and for a price that is not ``retail``."""
    raw = (value - price) / price
    p = F.least(shrink(price, value, n, fitted) - price, price * cap)
    known = (price > 0) & (value > 0)
    return F.when(known if retail is None else known & retail, F.when(F.abs(raw) > gap, 0.0).otherwise(p))


def with_fitted_lambda(df: DataFrame, n: Column, price: str, value: str, least: int = 30) -> DataFrame:
    """``df`` with ``tier`` and ``lam``, fitted on its own rows; null for a tier of fewer than ``least`` rows. There are four tiers."""
    x = df.withColumn("tier", tier(n))
    return x.join(F.broadcast(lambda_fit(x, "tier", price, value, least).select("tier", "lam")), "tier", "left")


def opportunity(price: Column, low: Column, high: Column, value: Column, conf: Column, n: Column) -> Column:
    """Class of an offer against its interval."""
    below, above = (low - price) / low, (price - high) / high
    return (
        F.when(value.isNull() | price.isNull() | (price <= 0) | (n <= 0), "insufficient").when(below > 0.30, "review")
        .when((below > 0.12) & (conf >= 0.45) & (n >= 6), "excellent").when(below > 0, "good").when(above > 0.10, "well_above").when(above > 0, "above").otherwise("within")
    )


def lambda_fit(df: DataFrame, tier_col: str, price: str, value: str, least: int = 30) -> DataFrame:
    """Fitted shrinkage of each tier: (smallest spread / own spread) squared, at most 1; spreads are population deviations."""
    r = F.ln(F.col(value) / F.col(price))
    g = df.where((F.col(price) > 0) & (F.col(value) > 0)).groupBy(tier_col).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(r).alias("sd")).where(F.col("n") >= least)
    floor = F.min("sd").over(Window.partitionBy())
    return g.withColumn("lam", F.least(F.lit(1.0), F.try_divide(floor, F.col("sd")) ** 2))


def conformal_factor(df: DataFrame, keys: list[str], y: str, low: str, high: str, center: str, target: float = 0.8, least: int = 50, least_band: int = 30) -> DataFrame:
    """(keys, n, factor, coverage_pct) of each band: what its intervals must be multiplied by so that ``target`` of the values fall inside.

    The factor is the exponential of the linear quantile, at level target * (1 + 1 / n) and at most 1, of how far (in
    logarithms) a value lies outside, and 1 at least. A band of fewer than ``least_band`` values takes the factor of all
    values; below ``least`` values in all there is no row. Values and centers must be positive and bounds in order. Places
    come from range-dealt misses, so no band is sorted in one task.
    """
    tiny = F.lit(1e-9)
    log = lambda c: F.ln(F.greatest(F.col(c), tiny))
    miss = F.greatest(log(y) - log(high), log(low) - log(y))
    x = df.where((F.col(center) > 0) & (F.col(y) > 0) & (F.col(high) >= F.col(low)))
    hit = ((F.col(y) >= F.col(low)) & (F.col(y) <= F.col(high))).cast("double")
    x = x.select(*keys, miss.alias("_miss"), hit.alias("_hit"))
    bands = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.avg("_hit") * 100).alias("coverage_pct"))

    def factor(order: list[str], groups: list[str]) -> DataFrame:
        placed = quantiles.dealt(x.select(*groups, "_miss"), order)
        starts = placed.groupBy(*groups).agg(F.min("_upto").alias("_first"), F.count(F.lit(1)).alias("_n"))
        p = placed.join(starts, groups) if groups else placed.crossJoin(F.broadcast(starts))  # one row
        at = F.least(F.lit(target) * (1 + 1 / F.col("_n")), F.lit(1.0)) * (F.col("_n") - 1)
        i = F.col("_upto") - F.col("_first")
        value = lambda k: F.max(F.when(i == k, F.col("_miss")))
        g = p.groupBy(*groups).agg(value(F.floor(at)).alias("_lo"), value(F.ceil(at)).alias("_hi"), F.max(at - F.floor(at)).alias("_part"), F.max("_n").alias("_n"))
        return g.select(*groups, F.exp(F.greatest(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"), F.lit(0.0))).alias("factor"), "_n")

    own = factor([*keys, "_miss"], keys).withColumnRenamed("factor", "_own").drop("_n")
    every = factor(["_miss"], []).where(F.col("_n") >= least).select(F.col("factor").alias("_all"))
    out = bands.join(own, keys).crossJoin(F.broadcast(every))  # one row
    return out.select(*keys, "n", F.when(F.col("n") >= least_band, F.col("_own")).otherwise(F.col("_all")).alias("factor"), "coverage_pct")


def hierarchy(df: DataFrame, levels: list[list[str]], c: str, least: int = 3) -> DataFrame:
    """Median of the first level of group keys that has enough rows: one aggregate for each level, then coalesce."""
    out = df
    for i, keys in enumerate(levels):
        g = df.groupBy(*keys).agg(F.count(c).alias(f"_n{i}"), stats.quantile(c, 0.5).alias(f"_v{i}"))
        out = out.join(g, keys, "left") if keys else out.crossJoin(F.broadcast(g))
    pick = [F.when(F.col(f"_n{i}") >= least, F.struct(F.lit(i).alias("level"), F.col(f"_v{i}").alias("value"), F.col(f"_n{i}").alias("n"))) for i in range(len(levels))]
    return out.withColumn("estimate", F.coalesce(*pick)).drop(*[f"_{k}{i}" for i in range(len(levels)) for k in "nv"])


def km_elasticity(df: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Log-log slope of price on mileage, within [-0.45, -0.05]."""
    x = df.where("price > 0 and mileage > 0").withColumns({"_y": F.ln("price"), "_x": F.ln("mileage")})
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope")).withColumn("elasticity", F.when(F.col("n") >= least, clamp(F.col("slope"), -0.45, -0.05)))


def weighted_median(df: DataFrame, keys: list[str], c: str, weight: Column, q: float = 0.5) -> DataFrame:
    """First value whose cumulative weight reaches q of the whole; equal values are summed first."""
    g = df.groupBy(*keys, c).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    g = g.withColumn("_c", F.sum("_w").over(w.orderBy(c))).withColumn("_t", F.sum("_w").over(w))
    return g.where(F.col("_c") >= F.col("_t") * q).groupBy(*keys).agg(F.min(c).alias("weighted_median"))
