"""Time series and window operators: trends, momentum, depreciation, indices, rolling means, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import stats
from marlstone.functions.quantiles import positions


def direction(c: Column, limit: float = 0.0) -> Column:
    return F.when(c > limit, "increasing").when(c < -limit, "decreasing").otherwise("stable")


def trends(df: DataFrame, ts: str, c: str, m: str) -> DataFrame:
    """Monthly and weekly summaries under ``period_type``."""
    one = lambda unit: (
        df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, ts).alias("period"))
        .agg(F.avg(c).alias("mean_price"), stats.quantile(c, 0.5).alias("median_price"), F.count(c).alias("n"), F.avg(m).alias("mean_mileage"), stats.quantile(m, 0.5).alias("median_mileage"))
        .withColumn("period_type", F.lit(unit))
    )
    return one("month").unionByName(one("week"))


def trend(df: DataFrame, ts: str, c: str, unit: str) -> DataFrame:
    """Mean per period with its change in percent; the window runs over periods, not rows."""
    g = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, ts).alias("period")).agg(F.avg(c).alias("mean_price"), F.count(c).alias("n"))
    g = g.withColumn("change_pct", stats.pct_change("mean_price", Window.orderBy("period")) * 100)
    return g.withColumn("trend", direction(F.col("change_pct")))


def momentum(df: DataFrame, ts: str, c: str, unit: str = "week") -> DataFrame:
    w = Window.orderBy("period")
    g = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, ts).alias("period")).agg(F.avg(c).alias("mean_price"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("price_momentum", stats.pct_change("mean_price", w) * 100).withColumn("volume_momentum", stats.pct_change("n", w) * 100)
    g = g.withColumn("score", (F.col("price_momentum") + F.col("volume_momentum")) / 2)
    return g.withColumn("market", F.when(F.col("score") <= -2, "Bearish").when(F.col("score") <= 2, "Neutral").when(F.col("score") > 2, "Bullish"))


def depreciation(df: DataFrame, year: str, c: str) -> DataFrame:
    w = Window.orderBy(year)
    g = df.where(F.col(year).isNotNull()).groupBy(year).agg(F.avg(c).alias("mean_price"), F.count(c).alias("n"))
    first = F.first("mean_price").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("change", stats.pct_change("mean_price", w)).withColumn("cumulative", F.try_divide(F.col("mean_price") - first, first))


def price_index(df: DataFrame, ts: str, c: str, base_year: int) -> DataFrame:
    """Monthly means over the mean of the base year's monthly means; 100 if the base year is missing."""
    g = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc("month", ts).alias("month")).agg(F.avg(c).alias("mean_price"))
    base = F.avg(F.when(F.year("month") == base_year, F.col("mean_price"))).over(Window.partitionBy())
    return g.withColumn("index", F.when(base.isNull(), 100.0).otherwise(F.try_divide(F.col("mean_price") * 100, base)))


def rolling(df: DataFrame, keys: list[str], order: list[str], c: str, sizes=(7, 30), full: bool = True) -> DataFrame:
    """Row-level change and rolling means over the last n rows of each key; with ``full`` null until the window is full."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("change", stats.pct_change(c, w))
    for n in sizes:
        r = w.rowsBetween(-(n - 1), 0)
        mean = F.avg(c).over(r)
        out = out.withColumn(f"mean_{n}", F.when(F.count(c).over(r) == n, mean) if full else mean)
    return out.withColumn("move", F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("stable"))


def group_outliers(df: DataFrame, keys: list[str], c: str, limit: float = 3.0) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("z", stats.zscore(c, w)).withColumn("is_outlier", F.coalesce(F.abs("z") > limit, F.lit(False)))


def volatility(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("volatility", F.try_divide(F.stddev_samp(c).over(w), F.avg(c).over(w)))


def frequency_encode(df: DataFrame, c: str, k: int = 10) -> DataFrame:
    """Count of the value, rarity against the most frequent one, and membership of the top k; counts join back, sized by Spark."""
    g = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("freq"))
    most = g.agg(F.max("freq").alias("_most"))  # one row
    top = g.orderBy(F.desc("freq"), c).limit(k).select(c, F.lit(True).alias("_top"))  # k rows
    g = g.crossJoin(F.broadcast(most)).join(F.broadcast(top), c, "left")
    return df.join(g.select(c, "freq", (1 - F.col("freq") / F.col("_most")).alias("rarity"), F.coalesce("_top", F.lit(False)).alias("is_top")), c, "left")


def comparable_count(df: DataFrame, keys: list[str], year: str, reach: int = 2) -> DataFrame:
    """Listings of the same keys within ``reach`` years, the row itself not counted.

    Counts are taken per (key, year) first, so a hot key has as many rows as years.
    """
    g = df.groupBy(*keys, year).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(year).rangeBetween(-reach, reach)
    return df.join(g.withColumn("comparables", F.sum("_n").over(w) - 1).drop("_n"), [*keys, year])


def percentile_grade(df: DataFrame, score: Column, *order: str) -> DataFrame:
    """Whole-table order by score: percentile and grade."""
    x = positions(df.withColumn("ratio", score), "ratio", *order)
    x = x.withColumn("pct", F.col("position") / F.col("total") * 100).drop("position", "total")
    return x.withColumn("grade", F.when(F.col("pct") >= 99, "A+").when(F.col("pct") >= 95, "A").when(F.col("pct") >= 85, "B").when(F.col("pct") >= 60, "C").otherwise("D"))


def week_label(ts: str) -> Column:
    """Year and Monday-first week of the year, 00 before the first Monday."""
    w = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.format_string("%d-%02d", F.year(ts), w.cast("int"))


def days_on_market(df: DataFrame, keys: list[str], since: str, asof: str) -> DataFrame:
    days = (F.unix_timestamp(F.lit(asof).cast("timestamp")) - F.unix_timestamp(since)) / 86400
    return df.groupBy(*keys).agg(F.avg(days).alias("avg_days"))
