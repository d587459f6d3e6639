"""Joins: range comparables through pre-aggregated keys, watchlists, references, duplicates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import stats


def year_range_mean(df: DataFrame, keys: list[str], year: str, c: str, reach: int = 2) -> DataFrame:
    """Mean of ``c`` over listings of the same keys within ``reach`` years, the row included: sums per (key, year), then a range frame."""
    g = df.groupBy(*keys, year).agg(F.sum(c).alias("_s"), F.count(c).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(year).rangeBetween(-reach, reach)
    return g.select(*keys, year, (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("range_mean"), F.sum("_n").over(w).alias("range_n"))


def watchlist_matches(df: DataFrame, watchlist: DataFrame, equal: dict[str, str], at_least: dict[str, str], at_most: dict[str, str], max_watch: int | None = None) -> DataFrame:
    """Every (listing, criterion) pair in which each criterion column is null or satisfied.

    Criteria of any number: those that name the first ``equal`` column meet its listings by an equi-join, the others meet all
    listings, in blocks of both tables where they are too many to broadcast. A ``max_watch`` that is given refuses a larger table.
    """
    if max_watch is not None and watchlist.limit(max_watch + 1).count() > max_watch:
        raise ValueError("the watchlist exceeds its bound")
    w = watchlist.select(*[F.col(c).alias(f"w_{c}") for c in watchlist.columns])
    free = lambda c: F.col(f"w_{c}").isNull()
    cond = F.lit(True)
    for c, v in list(equal.items())[1:]:
        cond = cond & (free(c) | (F.col(v) == F.col(f"w_{c}")))
    for c, v in at_least.items():
        cond = cond & (free(c) | (F.col(v) >= F.col(f"w_{c}")))
    for c, v in at_most.items():
        cond = cond & (free(c) | (F.col(v) <= F.col(f"w_{c}")))
    if not equal:
        return df.join(w, cond)
    c, v = next(iter(equal.items()))
    return df.join(w.where(~free(c)), (F.col(v) == F.col(f"w_{c}")) & cond).unionByName(df.join(w.where(free(c)), cond))


def watchlist_top(df: DataFrame, watchlist: DataFrame, id_col: str, equal: dict[str, str], at_least: dict[str, str], most: tuple[str, str], order: list[Column], k: int) -> DataFrame:
    """The ``k`` first matches of each criterion by the capped column, then ``order``: top_per_group of :func:`watchlist_matches` without its pairs.

    A cap leaves out the end of what is ordered by the capped column first, so for each combination of the other named columns only
    its ``k`` first listings (and its ``k`` first without a value) can be among a criterion's. Criteria that are alike meet them once.
    """
    c, v = most
    dims = [*equal.values(), *at_least.values()]
    by = [F.col(v), *order]
    first = top_per_group(df.withColumn("_none", F.col(v).isNull()), [*dims, "_none"], by, k).drop("_none", "rank")
    asked = [*equal, *at_least, c]
    kinds = watchlist.select(*asked).distinct()
    top = top_per_group(watchlist_matches(first, kinds, equal, at_least, {c: v}), [f"w_{a}" for a in asked], by, k)
    same = reduce(and_, [F.col(f"w_{a}").eqNullSafe(F.col(f"_i_{a}")) for a in asked])
    ids = watchlist.select(F.col(id_col).alias("w_id"), *[F.col(a).alias(f"_i_{a}") for a in asked])
    return ids.join(top, same).drop(*[f"_i_{a}" for a in asked])


def watchlist_counts(df: DataFrame, watchlist: DataFrame, id_col: str, equal: dict[str, str], at_least: dict[str, str], most: tuple[str, str], width: float = 100.0) -> DataFrame:
    """(w_id, n, best) of each criterion that any listing satisfies: how many do, and the least value of the capped column.

    Gives what counting :func:`watchlist_matches` gives without its pairs. Listings are counted by the columns that criteria
    name and by steps of ``width`` of the capped column; criteria meet those cells, running sums give all whole steps below
    the cap, and only listings of the cap's own step are compared one by one.
    """
    c, v = most
    dims = list(equal.values()) + list(at_least.values())
    step = F.floor(F.col(v) / width).cast("long")
    x = df.where(F.col(v).isNotNull()).select(*[F.col(d).alias(f"d_{d}") for d in dims], F.col(v).alias("_v"), step.alias("_b"))
    keys = [f"d_{d}" for d in dims]
    cells = x.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"))
    groups = cells.groupBy(*keys).agg(F.max("_b").alias("_top"))
    w = watchlist.select(F.col(id_col).alias("w_id"), *[F.col(k).alias(f"w_{k}") for k in [*equal, *at_least]], F.col(c).alias("_cap"))
    fits = F.lit(True)
    for k, d in equal.items():
        fits = fits & (F.col(f"w_{k}").isNull() | (F.col(f"w_{k}") == F.col(f"d_{d}")))
    for k, d in at_least.items():
        fits = fits & (F.col(f"w_{k}").isNull() | (F.col(f"d_{d}") >= F.col(f"w_{k}")))
    # the groups of a few named columns against the criteria, never listings
    met = groups.join(w, fits).withColumn("_b", F.when(F.col("_cap").isNull(), F.col("_top") + 1).otherwise(F.floor(F.col("_cap") / width).cast("long")))
    below = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = cells.select(*keys, "_b", F.sum("_n").over(below).alias("_sum"), F.min("_lo").over(below).alias("_min"))
    # the last filled step below the cap, by one pass over steps and caps together
    asked = met.select(*keys, (F.col("_b") - F.lit(0.5)).alias("_at"), F.lit(None).cast("long").alias("_sum"), F.lit(None).cast("double").alias("_min"), "w_id")
    known = sums.select(*keys, F.col("_b").cast("double").alias("_at"), F.col("_sum"), F.col("_min").cast("double"), F.lit(None).cast(w.schema["w_id"].dataType).alias("w_id"))
    upto = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = known.unionByName(asked).withColumn("_n", F.last("_sum", True).over(upto)).withColumn("_lo", F.last("_min", True).over(upto)).where("w_id is not null and _n is not null").select("w_id", "_n", "_lo")
    own = x.select(*[F.col(k).alias(f"x_{k}") for k in keys], F.col("_b").alias("x_b"), "_v")
    same = F.col("_b") == F.col("x_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"x_{k}"))
    edge = met.where(F.col("_cap").isNotNull()).join(own, same).where(F.col("_v") <= F.col("_cap")).groupBy("w_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").cast("double").alias("_lo"))
    return whole.unionByName(edge).groupBy("w_id").agg(F.sum("_n").alias("n"), F.min("_lo").alias("best"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reference_deviation(df: DataFrame, keys: list[str], c: str, least: int = 5, limit: float = 0.5) -> DataFrame:
    """Rows that deviate from their group's mean by more than ``limit`` of it, for groups of at least ``least`` rows."""
    g = df.groupBy(*keys).agg(F.avg(c).alias("reference"), F.count(c).alias("_n")).where(F.col("_n") >= least).drop("_n")
    x = df.join(g, keys).withColumn("deviation", F.abs(F.col(c) - F.col("reference")) / F.col("reference"))
    return x.where(F.col("deviation") > limit)


def near_pairs(df: DataFrame, keys: list[str], row_id: str, price: str, ts: str, pct: float = 0.10, days: int = 7) -> DataFrame:
    """Pairs of the same keys whose prices differ by under ``pct`` and dates by at most ``days``: day buckets make the band an equi-join."""
    day = F.floor(F.unix_timestamp(ts) / 86400 / days).cast("long")
    x = df.select(*keys, row_id, price, ts, day.alias("_d"))
    y = x.select(*keys, F.col(row_id).alias("other_id"), F.col(price).alias("other_price"), F.col(ts).alias("other_ts"), F.explode(F.array(F.col("_d") - 1, F.col("_d"), F.col("_d") + 1)).alias("_d"))
    p = x.join(y, [*keys, "_d"]).where(F.col(row_id) < F.col("other_id"))
    near = (F.abs(F.col(price) - F.col("other_price")) < pct * F.greatest(price, "other_price")) & (F.abs(F.unix_timestamp(ts) - F.unix_timestamp("other_ts")) <= days * 86400)
    return p.where(near).drop("_d")


def factor_levels(ask: DataFrame, sold: DataFrame, levels: list[list[str]], c: str, least: int = 3) -> DataFrame:
    """Sale-to-ask factor at the first level with enough of both, within [0.55, 0.95]."""
    base = ask.select(*levels[0]).distinct()
    for i, keys in enumerate(levels):
        a = ask.groupBy(*keys).agg(stats.quantile(c, 0.5).alias("_a"), F.count(c).alias("_na"))
        s = sold.groupBy(*keys).agg(stats.quantile(c, 0.5).alias("_s"), F.count(c).alias("_ns"))
        f = (a.join(s, keys) if keys else a.crossJoin(s)).where((F.col("_na") >= least) & (F.col("_ns") >= least)).select(*keys, (F.col("_s") / F.col("_a")).alias(f"_f{i}"))
        base = base.join(f, keys, "left") if keys else base.join(f, F.lit(True), "left")
    return base.withColumn("factor", F.greatest(F.lit(0.55), F.least(F.lit(0.95), F.coalesce(*[f"_f{i}" for i in range(len(levels))])))).drop(*[f"_f{i}" for i in range(len(levels))])
