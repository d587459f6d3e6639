"""Market estimates of a listing against its group: similarity parts, robust filters, deal grades, brand names, upsert probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import fields, joins

#: Grades of mileage against 15 000 km a year, and scores of condition words.
MILEAGE_GRADES = ((0.5, "excellent", 100), (0.7, "good", 80), (0.9, "fair", 60), (1.1, "average", 40))
CONDITION_SCORES = {"excellent": 100, "good": 80, "fair": 60, "poor": 20}


def robust_rows(df: DataFrame, keys: list[str], c: str, limit: float = 3.5) -> DataFrame:
    """Rows of each group without those over ``limit`` modified deviations from its median.

    Groups under four rows or without spread keep all, and so do groups that would lose more than a quarter (one row at least may go).
    """
    mid = df.groupBy(*keys).agg(F.count(c).alias("_n"), F.median(c).alias("_med"))
    x = df.join(mid, keys).withColumn("_d", F.abs(F.col(c) - F.col("_med")))
    x = x.join(x.groupBy(*keys).agg(F.median("_d").alias("_mad")), keys)
    far = F.coalesce((F.col("_n") >= 4) & (F.col("_mad") > 0) & (0.6745 * F.col("_d") / F.col("_mad") > limit), F.lit(False))
    x = x.withColumn("_far", far)
    lost = x.groupBy(*keys).agg(F.count_if("_far").alias("_lost"))
    kept = ~F.col("_far") | (F.col("_lost") > F.greatest(F.lit(1), F.floor(F.col("_n") / 4)))
    return x.join(lost, keys).where(kept).select(*df.columns)


def winsorized(df: DataFrame, keys: list[str], c: str, share: float = 0.05) -> DataFrame:
    """``df`` with ``winsorized``: values of groups of five or more pulled to their 5 % order statistics (one row at least on each side)."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*keys)
    g = counts.withColumn("_hi", F.sum("_m").over(w.orderBy(c))).withColumn("_n", F.sum("_m").over(w))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    at = lambda i: F.min(F.when(F.col("_hi") > i, F.col(c)))
    ends = g.where("_n >= 5").groupBy(*keys).agg(at(k).alias("_lo"), at(F.col("_n") - 1 - k).alias("_up"))
    x = df.join(ends, keys, "left")
    return x.withColumn("winsorized", F.when(F.col("_lo").isNull(), F.col(c)).otherwise(F.least(F.greatest(F.col(c), F.col("_lo")), F.col("_up")))).drop("_lo", "_up")


def market_estimate(df: DataFrame, keys: list[str], year: str, price: str, km: str, reach: int = 2) -> DataFrame:
    """``df`` with estimate, confidence and deal score from the listings of its keys within ``reach`` years.

    The mean price rises by a tenth for mileage under half the mean one and falls by a tenth above half as much again;
    ten listings give full confidence.
    """
    means = joins.year_range_mean(df, keys, year, price, reach).withColumnsRenamed({"range_mean": "_p", "range_n": "_n"})
    kms = joins.year_range_mean(df, keys, year, km, reach).select(*keys, year, F.col("range_mean").alias("_km"))
    x = df.join(means, [*keys, year], "left").join(kms, [*keys, year], "left")
    moved = F.when(F.col("_km") > 0, F.when(F.col(km) < F.col("_km") * 0.5, 1.1).when(F.col(km) > F.col("_km") * 1.5, 0.9).otherwise(1.0)).otherwise(1.0)
    x = x.withColumn("estimate", F.col("_p") * moved).withColumn("confidence", F.least(F.col("_n") / 10, F.lit(1.0)))
    off = (F.col("estimate") - F.col(price)) / F.col("estimate")
    return x.withColumn("discount", off).withColumn("sample", F.col("_n")).drop("_p", "_n", "_km")


def mileage_grade(km: Column, age: Column) -> Column:
    """Struct score and grade of a mileage against 15 000 km a year; unknown for an age of none."""
    ratio = km / (age * 15_000)
    pick = lambda k, other: F.coalesce(*[F.when(ratio <= g[0], g[k]) for g in MILEAGE_GRADES], F.lit(other))
    return F.struct(F.when(age > 0, pick(2, 20)).otherwise(0).alias("score"), F.when(age > 0, pick(1, "poor")).otherwise("unknown").alias("grade"))


def brand_name(c: Column, names: dict[str, str]) -> Column:
    """Struct brand and confidence: 1 if it stands so in the table, .95 if its folded form does, .5 for itself, 0 for none."""
    raw = F.trim(c)
    key = F.regexp_replace(F.regexp_replace(fields.fold_accents(raw), r"[_\-/]+", " "), r"\s+", " ")
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key]
    none = raw.isNull() | (raw == "")
    conf = F.when(none, 0.0).when(known.isNull(), 0.5).when(raw == known, 1.0).otherwise(0.95)
    return F.struct(F.when(~none, F.coalesce(known, raw)).alias("brand"), conf.alias("confidence"))


def probe(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``delta`` with ``exists``: whether their key stands in ``base``; null keys never do."""
    known = base.select(*keys).distinct().withColumn("_known", F.lit(True))
    return delta.join(known, keys, "left").withColumn("exists", F.coalesce("_known", F.lit(False))).drop("_known")
