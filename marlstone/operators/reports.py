"""Reports over listings, searches, duplicates and predictions: one-row summaries, histograms, shares, floor-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N = F.count


def table_statistics(df: DataFrame, price: str, ts: str, asof: str, days: int = 7) -> DataFrame:
    """Row count, mean, least and greatest positive price, and rows of the last days."""
    p = F.when(F.col(price) > 0, F.col(price))
    return df.agg(N(F.lit(1)).alias("n"), F.avg(p).alias("mean_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.count_if(F.col(ts) >= F.date_sub(F.lit(asof).cast("date"), days)).alias("recent"))


def dashboard_counts(df: DataFrame, brand: str, wanted: Column) -> DataFrame:
    return df.agg(N(F.lit(1)).alias("n"), F.countDistinct(brand).alias("brands"), F.count_if(wanted).alias("wanted"))


def demand(df: DataFrame, keys: list[str], price: str, deal: str, days: str, ts: str, asof: str) -> DataFrame:
    """Demand score from days on market, deal quality and supply, its level, and the price trend of 30 days against the 30 before (within 1 %: stable)."""
    age = F.datediff(F.lit(asof).cast("date"), F.col(ts).cast("date"))
    g = df.groupBy(*keys).agg(
        N(F.lit(1)).alias("n"), F.avg(days).alias("_d"), F.avg(deal).alias("_s"), F.avg(F.when(age.between(0, 30), F.col(price))).alias("_new"), F.avg(F.when(age.between(31, 60), F.col(price))).alias("_old"),
    )
    quick = F.greatest(F.lit(0.0), 10 - F.coalesce("_d", F.lit(100.0)) / 10)
    good = F.greatest(F.lit(0.0), 10 - F.col("_s") * 1.5)
    supply = F.least(F.lit(10.0), F.greatest(F.lit(1.0), 10 - F.col("n") / 20))
    score = 0.4 * quick + 0.3 * F.when(good > 0, good).otherwise(5.0) + 0.3 * supply
    change = (F.col("_new") - F.col("_old")) / F.col("_old") * 100
    level = F.when(F.col("score") >= 8, "very_high").when(F.col("score") >= 6, "high").when(F.col("score") >= 4, "medium").when(F.col("score") >= 2, "low").otherwise("very_low")
    return g.select(*keys, "n", score.alias("score"), F.when(change > 1, "rising").when(change < -1, "falling").otherwise("stable").alias("trend")).withColumn("level", level)


def daily_trend(df: DataFrame, ts: str, price: str) -> DataFrame:
    """First and last daily mean and the change between them in percent; days are aggregated first."""
    d = df.groupBy(F.col(ts).cast("date").alias("day")).agg(F.avg(price).alias("mean"))
    g = d.agg(N(F.lit(1)).alias("days"), F.min_by("mean", "day").alias("first_mean"), F.max_by("mean", "day").alias("last_mean"))
    return g.withColumn("change_pct", F.try_divide((F.col("last_mean") - F.col("first_mean")) * 100, F.col("first_mean")))


def score_distribution(df: DataFrame, score: Column) -> DataFrame:
    """Mean, median, deviation and bands of scores that are set and not zero."""
    x = df.select(score.alias("s")).where("s <> 0")
    band = lambda lo, hi: F.count_if((F.col("s") >= lo) & (F.col("s") < hi))
    return x.agg(N("s").alias("n"), F.avg("s").alias("mean"), F.median("s").alias("median"), F.stddev_samp("s").alias("std"), band(8, 1e9).alias("excellent"), band(6, 8).alias("good"), band(4, 6).alias("fair"), band(-1e9, 4).alias("poor"))


def portfolio(df: DataFrame, cost: Column, value: Column, net: Column) -> DataFrame:
    """Totals of a portfolio: invested, value, net profit, return in percent, winners and losers."""
    x = df.select(cost.alias("c"), value.alias("v"), net.alias("p"))
    g = x.agg(N(F.lit(1)).alias("n"), F.sum("c").alias("invested"), F.sum("v").alias("value"), F.sum("p").alias("net"), F.count_if(F.col("p") > 0).alias("winners"), F.count_if(F.col("p") <= 0).alias("losers"))
    return g.withColumn("roi_pct", F.try_divide(F.col("net") * 100, F.col("invested")))


def segment_summary(df: DataFrame, key: str, profit: Column, roi: Column, days: Column) -> DataFrame:
    return df.groupBy(key).agg(N(F.lit(1)).alias("n"), F.avg(profit).alias("mean_profit"), F.avg(roi).alias("mean_roi"), F.avg(days).alias("mean_days"))


def shares(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent values with their share in percent and rank (ties: by value); the total includes rows without a value."""
    g = df.groupBy(key).agg(N(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("_t"))
    top = g.where(F.col(key).isNotNull()).orderBy(F.desc("n"), key).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), key))  # over k rows
    return top.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n") * 100.0 / F.col("_t")).alias("share"), rank.alias("rank"))


def histogram_stats(df: DataFrame, bin_of: Column) -> DataFrame:
    """Total, number of bins, most and least common bin (ties: the least label) and rows per bin."""
    h = df.groupBy(bin_of.alias("bin")).agg(N(F.lit(1)).alias("n")).where("bin is not null")
    return h.agg(F.sum("n").alias("total"), N("bin").alias("bins"), F.min(F.struct(-F.col("n"), "bin"))["bin"].alias("most"), F.min(F.struct("n", "bin"))["bin"].alias("least"), F.avg("n").alias("per_bin"))


def floor_rank(df: DataFrame, keys: list[str], c: str, levels=(0.1, 0.5, 0.9)) -> DataFrame:
    """Values at place int(p * (n - 1)) of each sorted group, from counts of equal values: a group is never gathered."""
    g = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(N(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*keys)
    g = g.withColumn("_hi", F.sum("_m").over(w.orderBy(c))).withColumn("_n", F.sum("_m").over(w))
    at = lambda p: F.min(F.when(F.col("_hi") > F.floor(p * (F.col("_n") - 1)), F.col(c)))
    return g.groupBy(*keys).agg(F.sum("_m").alias("n"), *[at(p).alias(f"p{round(p * 100)}") for p in levels])


def exploded_histogram(df: DataFrame, items: Column, name: str = "reason") -> DataFrame:
    """Counts of the elements of an array column."""
    return df.select(F.explode(items).alias(name)).groupBy(name).agg(N(F.lit(1)).alias("n"))


def duplicate_patterns(df: DataFrame, methods: dict[str, list[str]]) -> DataFrame:
    """Share of rows in groups of two or more for each set of keys, with the number of groups and the largest one."""
    total, out = df.agg(N(F.lit(1)).alias("_t")), None
    for name, keys in methods.items():
        g = df.groupBy(*keys).agg(N(F.lit(1)).alias("k"))
        one = g.agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("rows"), F.count_if(F.col("k") > 1).alias("groups"), F.max("k").alias("largest"))
        one = one.crossJoin(F.broadcast(total)).select(F.lit(name).alias("method"), "rows", "groups", "largest", F.try_divide(F.col("rows") * 100.0, F.col("_t")).alias("pct"))
        out = one if out is None else out.unionByName(one)
    return out


def prediction_stats(df: DataFrame, predicted: str, confidence: str) -> DataFrame:
    c = F.col(confidence)
    return df.agg(
        N(predicted).alias("n"), F.avg(predicted).alias("mean"), F.stddev_samp(predicted).alias("std"), F.min(predicted).alias("min"), F.max(predicted).alias("max"), F.avg(c).alias("mean_confidence"),
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"),
    )


def collapsed(df: DataFrame, keys: list[str], ts: str, asof: str, minutes: int = 10) -> DataFrame:
    """One row for the events of a kind in the last minutes before ``asof``: count, first and last."""
    end = F.lit(asof).cast("timestamp")
    x = df.where((F.col(ts) > end - F.expr(f"interval {minutes} minutes")) & (F.col(ts) <= end))
    return x.groupBy(*keys).agg(N(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def funnel(df: DataFrame, stage: str, order: list[str], who: str) -> DataFrame:
    """Distinct visitors of each stage and the share of the stage before and of the first, in percent; unseen stages count zero."""
    cells = [F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.countDistinct(F.when(F.col(stage) == s, F.col(who))).alias("n")) for i, s in enumerate(order)]
    g = df.agg(F.array(*cells).alias("c")).selectExpr("inline(c)")
    w = Window.orderBy("step")  # over the stages
    return g.select("step", "stage", "n", F.try_divide(F.col("n") * 100.0, F.lag("n").over(w)).alias("of_previous"), F.try_divide(F.col("n") * 100.0, F.first("n").over(w)).alias("of_first"))


#: Rate, volume discount and least commission of a sale by kind of seller; sales a month that multiply the discount.
COMMISSION = {"private": (0.025, 0.0, 5.0), "professional": (0.02, 0.1, 10.0), "premium": (0.015, 0.15, 15.0), "enterprise": (0.01, 0.2, 25.0)}
OTHER_SELLER = (0.02, 0.0, 5.0)
VOLUME = ((201, 2.0), (51, 1.5), (11, 1.0))


def commission(amount: Column, seller: Column, sales: Column) -> Column:
    """Rate of the seller's kind, at least its least commission, less its discount times the factor of the month's sales."""
    of = lambda k: F.coalesce(*[F.when(seller == s, rule[k]) for s, rule in COMMISSION.items()], F.lit(OTHER_SELLER[k]))
    factor = F.coalesce(*[F.when(sales >= n, f) for n, f in VOLUME], F.lit(0.0))
    return F.greatest(amount * of(0), of(2)) * (1 - of(1) * factor)


def range_validation(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Least and greatest value, missing rows and whether all lie within the bounds, one row per column, one pass."""
    cells = []
    for c, (lo, hi) in bounds.items():
        v = F.col(c).cast("double")
        cells.append(F.struct(F.lit(c).alias("name"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v.isNull()).alias("missing"), F.coalesce((F.min(v) >= lo) & (F.max(v) <= hi), F.lit(True)).alias("ok")))
    return df.agg(F.array(*cells).alias("c")).selectExpr("inline(c)")


def coverage_diagnosis(df: DataFrame, value: str, reference: str, model: str) -> DataFrame:
    """Of the rows without a value, how many the reference, the model, both or neither could give one."""
    bare, ref, ml = F.col(value).isNull(), F.col(reference).isNotNull(), F.col(model).isNotNull()
    return df.agg(N(F.lit(1)).alias("n"), F.count_if(bare).alias("without"), F.count_if(bare & ref).alias("by_reference"), F.count_if(bare & ml).alias("by_model"), F.count_if(bare & ref & ml).alias("by_both"), F.count_if(bare & ~ref & ~ml).alias("by_none"))


def before_after(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and set values of each column before and after a cleaning step."""
    def one(df: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("name"), N(c).alias("filled"), N(F.lit(1)).alias("rows")) for c in columns]
        return df.agg(F.array(*cells).alias("c")).selectExpr("inline(c)").withColumnsRenamed({"filled": f"filled_{name}", "rows": f"rows_{name}"})
    return one(before, "before").join(one(after, "after"), "name")


def price_summary(df: DataFrame, c: str) -> DataFrame:
    """Report bundle of one price column: counts, moments, quartiles and the spread between the tenths, one row."""
    q = F.percentile(c, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    g = df.agg(N(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), q.alias("_q"))
    return g.select("n", "mean", "std", "min", "max", *[F.get("_q", F.lit(i)).alias(k) for i, k in enumerate(("p10", "p25", "p50", "p75", "p90"))]).withColumn("spread", F.col("p90") / F.col("p10"))
