"""Grouped market statistics: summaries, shares, concentration, seasonality, sufficiency, opportunities."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import buckets, stats
from marlstone.functions.quantiles import group_medians, whole_quantiles
from marlstone.operators.kinds import written


def known(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose group keys are all set."""
    return df.dropna(subset=list(keys))


def group_aggregate(df: DataFrame, keys: list[str], columns: dict[str, list[str]]) -> DataFrame:
    """Several functions per column, named ``column_function``; groups with a null key are dropped."""
    make = {"mean": F.avg, "median": lambda c: stats.quantile(c, 0.5), "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "sum": F.sum}
    return known(df, *keys).groupBy(*keys).agg(*[make[f](c).alias(f"{c}_{f}") for c, fs in columns.items() for f in fs])


def basic_stats(df: DataFrame, c: str) -> DataFrame:
    """One row of moments, which partial sums give, and quartiles, which counted values give."""
    moments = df.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), stats.skew(c).alias("skew"), stats.kurt(c).alias("kurtosis")
    )
    quartiles = whole_quantiles(df, c, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return moments.crossJoin(F.broadcast(quartiles)).withColumn("iqr", F.col("q75") - F.col("q25"))


def describe_by(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    return known(df, *keys).groupBy(*keys).agg(*stats.describe(c))


def percentiles(df: DataFrame, c: str, levels=(10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    return whole_quantiles(df, c, {f"p{p}": p / 100 for p in levels})


def price_ranges(df: DataFrame, c: str) -> DataFrame:
    return whole_quantiles(df, c, {"budget_from": 0.0, "mid_from": 0.33, "premium_from": 0.66, "top": 1.0})


def ranked(df: DataFrame, by: list[Column], out: str) -> DataFrame:
    """Row number over an aggregate (never over raw rows)."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*by)))


def location_stats(df: DataFrame, key: str, c: str) -> DataFrame:
    g = known(df, key).groupBy(key).agg(F.avg(c).alias("mean_price"), stats.quantile(c, 0.5).alias("median_price"), F.count(c).alias("n"))
    return ranked(g, [F.desc("mean_price"), F.asc(key)], "price_rank")


def competition(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Share of rows and competitiveness of each group against the overall mean, which the groups' own sums give."""
    g = known(df, *keys).groupBy(*keys).agg(F.avg(c).alias("mean_price"), stats.quantile(c, 0.5).alias("median_price"), F.count(c).alias("n"), F.sum(c).alias("_s"))
    every = Window.partitionBy()
    g = g.withColumn("market_share", 100.0 * F.col("n") / F.sum("n").over(every)).withColumn("price_competitiveness", 100.0 * F.col("mean_price") / (F.sum("_s").over(every) / F.sum("n").over(every)))
    return ranked(g.drop("_s"), [F.desc("n"), *[F.asc(k) for k in keys]], "share_rank")


def concentration(df: DataFrame, key: str) -> DataFrame:
    """HHI, CR4 and top share; shares are of all rows, null keys included in the total only."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).where(F.col(key).isNotNull())
    g = ranked(g, [F.desc("n"), F.asc(key)], "r")
    hhi = F.sum(F.col("share") * F.col("share"))
    label = F.when(hhi < 1000, "Low").when(hhi < 1800, "Medium").otherwise("High")
    return g.agg(hhi.alias("hhi"), F.sum(F.when(F.col("r") <= 4, F.col("share"))).alias("cr4"), F.max("share").alias("top_share"), label.alias("concentration"))


def segment_share(df: DataFrame, key: str, c: str) -> DataFrame:
    """Tercile segments of ``c`` within each key; every key lists all three, empty ones with zero."""
    seg = buckets.with_scalars(known(df, key), F.percentile(c, F.array(F.lit(0.33), F.lit(0.66))).alias("_e"))
    name = F.when(F.col(c) <= F.get("_e", F.lit(0)), "Budget").when(F.col(c) <= F.get("_e", F.lit(1)), "Mid").otherwise("Premium")
    count = lambda s: F.count(F.when(name == s, 1))
    g = seg.where(F.col(c).isNotNull()).groupBy(key).agg(*[count(s).alias(s) for s in ("Budget", "Mid", "Premium")])
    long = g.unpivot([key], ["Budget", "Mid", "Premium"], "segment", "n")
    return long.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def geography(df: DataFrame, key: str, c: str) -> DataFrame:
    g = known(df, key).groupBy(key).agg(F.avg(c).alias("mean_price"), F.count(c).alias("n"), F.sum(c).alias("_s"))
    every = Window.partitionBy()
    g = g.withColumn("price_premium", (F.col("mean_price") / (F.sum("_s").over(every) / F.sum("n").over(every)) - 1) * 100).drop("_s")
    return ranked(g, [F.desc("n"), F.asc(key)], "count_rank")


def seasonality(df: DataFrame, ts: str, c: str) -> DataFrame:
    """Mean and count by month, quarter and weekday (Monday 0) in one pass."""
    x = df.select(F.month(ts).alias("m"), F.quarter(ts).alias("q"), F.weekday(ts).alias("d"), F.col(c).alias("x"))
    g = x.groupingSets([["m"], ["q"], ["d"]], "m", "q", "d").agg(F.grouping_id().alias("_g"), F.avg("x").alias("mean_price"), F.count("x").alias("n"))
    kind = F.when(F.col("_g") == 3, "month").when(F.col("_g") == 5, "quarter").otherwise("weekday")
    out = g.select(kind.alias("period_type"), F.coalesce("m", "q", "d").alias("period"), "mean_price", "n")
    peak = F.row_number().over(Window.partitionBy("period_type").orderBy(F.desc("mean_price"), "period")) == 1
    return out.withColumn("is_peak", peak)


def sufficiency(df: DataFrame, outer: str, inner: str) -> DataFrame:
    g = known(df, outer, inner).groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(outer)))
    return g.withColumn("level", buckets.cut(F.col("n"), buckets.SUFFICIENCY))


def opportunities(df: DataFrame, loc: str, make: str, c: str, few_loc: int = 10, few_pair: int = 5, premium: float = 0.2) -> DataFrame:
    """Scarce places, scarce (place, make) pairs and places priced well above the overall mean."""
    g = known(df, loc).groupBy(loc).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_price"), F.sum(c).alias("_s"), F.count(c).alias("_n"))
    overall = F.sum("_s").over(Window.partitionBy()) / F.sum("_n").over(Window.partitionBy())
    g = g.withColumn("overall", overall)
    a = g.where(F.col("n") < few_loc).select(F.lit("scarce_location").alias("kind"), loc, F.lit(None).cast("string").alias(make), "n", F.lit(None).cast("double").alias("gap"))
    p = known(df, loc, make).groupBy(loc, make).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < few_pair)
    b = p.select(F.lit("scarce_make").alias("kind"), loc, make, "n", F.lit(None).cast("double").alias("gap"))
    h = g.where(F.col("mean_price") - F.col("overall") > premium * F.col("overall"))
    return a.unionByName(b).unionByName(h.select(F.lit("high_price").alias("kind"), loc, F.lit(None).cast("string").alias(make), "n", (F.col("mean_price") - F.col("overall")).alias("gap")))


def price_per_mileage(df: DataFrame) -> DataFrame:
    x = df.withColumn("bracket", buckets.cut(F.col("mileage"), buckets.MILEAGE)).withColumn("ratio", F.try_divide("price", "mileage")).where("bracket is not null")
    return x.groupBy("bracket").agg(F.avg("price").alias("mean_price"), stats.quantile("price", 0.5).alias("median_price"), F.count("price").alias("n"), F.avg("ratio").alias("mean_ratio"), stats.quantile("ratio", 0.5).alias("median_ratio"))


def elasticity(df: DataFrame, c: str, n: int = 10) -> DataFrame:
    """Counts of equal-frequency bins and their change against the change of bin means."""
    g = buckets.qcut(df, c, n, "bin").where("bin is not null").groupBy("bin").agg(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    w = Window.orderBy("bin")
    g = g.withColumn("mid", (F.col("lo") + F.col("hi")) / 2)
    return g.withColumn("price_change", stats.pct_change("mid", w)).withColumn("count_change", stats.pct_change("n", w)).withColumn("elasticity", F.coalesce(F.try_divide("count_change", "price_change"), F.lit(0.0)))


def value_counts(df: DataFrame, c: str, k: int | None = None) -> DataFrame:
    g = known(df, c).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), F.asc(c)).limit(k) if k else g


def summary(df: DataFrame, ts: str, *dims: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), *[F.countDistinct(d).alias(f"n_{d}") for d in dims])


def consecutive_depreciation(df: DataFrame, keys: list[str], year: str, c: str) -> DataFrame:
    """Loss in percent a year between consecutive model years of a group, and the advice tier."""
    g = known(df, *keys, year).groupBy(*keys, year).agg(F.avg(c).alias("mean_price"))
    w = Window.partitionBy(*keys).orderBy(F.desc(year))
    prev, prev_year = F.lag("mean_price").over(w), F.lag(year).over(w)
    r = g.withColumn("rate", F.try_divide((prev - F.col("mean_price")) * 100, prev * (prev_year - F.col(year))))
    avg = r.groupBy(*keys).agg(F.avg("rate").alias("avg_rate"), F.count(F.lit(1)).alias("n_years"))
    return avg.withColumn("advice", F.when(F.col("avg_rate") > 15, "fast").when(F.col("avg_rate") > 5, "normal").when(F.col("avg_rate").isNotNull(), "slow"))


def location_variation(df: DataFrame, key: str, c: str) -> DataFrame:
    g = known(df, key).groupBy(key).agg(F.avg(c).alias("mean_price"))
    return g.withColumn("variation_pct", (F.col("mean_price") / F.avg("mean_price").over(Window.partitionBy()) - 1) * 100)


def saturation(df: DataFrame, key: str, c: str, k: int = 20) -> DataFrame:
    return known(df, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("avg_price")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def facets(df: DataFrame, *dims: str) -> DataFrame:
    """Counts of every value of every dimension in one pass of grouping sets."""
    g = df.groupingSets([[d] for d in dims], *dims).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    n = len(dims)
    names, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        here = F.col("_g") == (2**n - 1) - 2 ** (n - 1 - i)
        names, value = F.when(here, d).otherwise(names), F.when(here, F.col(d).cast("string")).otherwise(value)
    return g.select(names.alias("facet"), value.alias("value"), "n")


def missing_profile(df: DataFrame, *columns: str) -> DataFrame:
    """Missing share and uniqueness of each column; strings count as missing when empty."""
    text = {c for c, t in df.dtypes if t == "string"}
    full = lambda c: F.nullif(F.col(c), F.lit("")) if c in text else F.col(c)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.struct((100.0 - 100.0 * F.count(full(c)) / F.count(F.lit(1))).alias("missing"), (100.0 * F.countDistinct(c) / F.count(F.lit(1))).alias("unique")).alias(c) for c in columns])
    long = one.select("rows", F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column", "p"))
    return long.select("column", "rows", F.col("p.missing").alias("missing_pct"), F.col("p.unique").alias("unique_pct"))


def correlations(df: DataFrame, target: str, *columns: str) -> DataFrame:
    one = df.agg(*[F.corr(c, target).alias(c) for c in columns]).unpivot([], list(columns), "feature", "r")
    return one.withColumn("strength", F.abs("r"))


def error_report(df: DataFrame, actual: str, predicted: str, *keys: str) -> DataFrame:
    """MAE, median AE, RMSE, median APE in percent and RMSPE of each group."""
    # equal predictions of equal values are counted, so a group holds its distinct ones only
    x = df.where(F.col(actual) > 0).groupBy(*keys, F.col(actual).alias("_a"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    e = F.col("_p") - F.col("_a")
    x = written(x.select(*keys, F.abs(e).alias("_ae"), (F.abs(e) / F.col("_a")).alias("_ape"), "_n", F.when(e.isNotNull(), F.col("_n")).alias("_known")))
    mean = lambda c: F.sum(c * F.col("_n")) / F.sum("_known")
    out = x.groupBy(*keys).agg(
        F.sum("_n").alias("n"), mean(F.col("_ae")).alias("mae"), F.sqrt(mean(F.col("_ae") * F.col("_ae"))).alias("rmse"), (F.sqrt(mean(F.col("_ape") * F.col("_ape"))) * 100).alias("rmspe_pct"),
    )
    met = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    for c, name, times in (("_ae", "median_ae", 1), ("_ape", "median_ape_pct", 100)):
        middle = group_medians(x, list(keys), c, "_n").withColumn("median", F.col("median") * times).withColumnRenamed("median", name)
        out = out.join(middle, met, "left").drop(*[f"_k_{k}" for k in keys])
    return out.select(*keys, "n", "mae", "median_ae", "rmse", "median_ape_pct", "rmspe_pct")


def with_group_mean(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the mean of its group (nulls are a group) by a join with one written table of groups: no group is held in one task."""
    means = written(df.groupBy(*keys).agg(F.avg(value).alias(name)).withColumnsRenamed({k: f"_g_{k}" for k in keys}))
    met = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(means, met, "left").drop(*[f"_g_{k}" for k in keys])
