"""Comparable estimates: for each listing, the first of five widening levels with enough similar listings, robustly averaged.

Listings meet by the group keys, and those alike in all that is read here are of one kind, counted and not repeated. Kinds of a
group meet in bounded matrices inside a task (see ``kinds.meet``), so no pair is ever shuffled; the work is distinct targets times
distinct comparables of a group. ``comparable_pairs`` writes the pairs themselves out for callers who want them, by an equi-join on keys and year.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import kinds

#: Year span, same gearbox, same fuel, neighbouring class allowed, least comparables, penalty, least similarity.
LEVELS = (
    (1, True, True, False, 3, 1.00, 0.35),
    (2, False, True, False, 3, 0.92, 0.30),
    (3, False, False, False, 4, 0.82, 0.25),
    (3, False, False, True, 6, 0.72, 0.20),
    (5, False, False, True, 3, 0.62, 0.18),
)
#: Market premium of a fuel against petrol.
FUEL_PREMIUM = {"gasolina": 1.00, "diesel": 0.88, "mild_hybrid": 0.94, "hibrido": 1.12, "phev": 1.12, "eletrico": 1.30, "gpl": 0.92, "gnc": 0.90}
#: Cumulative weights within this of a quantile's share reach it, so that the order of a sum does not decide.
SLACK = 1e-9
#: Targets of a slice, cells of a matrix, and cells of a group up to which its targets are parted by fuel only.
SLICE, CELLS, SMALL = 8192, 32_768, 512

_NUMBERS, _NAMES = ("year", "km", "rank"), ("fuel", "gearbox")
_READ = [*_NUMBERS, *_NAMES, "dup"]
_KIND = ["price", *_READ]
_OUT = "level int, n long, value double, low double, high double, mean_similarity double"


def similarity(t: str = "t", c: str = "c") -> Column:
    """Product of penalties for each way in which two listings (structs year, km, rank, fuel, gearbox) differ."""
    d = lambda f: F.abs(F.col(f"{t}.{f}") - F.col(f"{c}.{f}"))
    differs = lambda f: ~F.col(f"{t}.{f}").eqNullSafe(F.col(f"{c}.{f}"))
    # greatest() skips nulls, so what is missing is asked for first
    year = F.when(d("year").isNull(), 0.75).otherwise(F.greatest(F.lit(0.25), 1.0 - d("year") * 0.14))
    km = F.when(d("km").isNull(), 0.85).otherwise(F.greatest(F.lit(0.35), 1.0 - d("km") / 200000.0))
    rank = F.when(differs("rank"), F.greatest(F.lit(0.3), 0.85 - 0.15 * F.coalesce(d("rank"), F.lit(0)))).otherwise(1.0)
    gearbox = F.when(F.col(f"{t}.gearbox") != F.col(f"{c}.gearbox"), 0.85).otherwise(1.0)
    return year * km * rank * F.when(differs("fuel"), 0.7).otherwise(1.0) * gearbox


def fuel_factor(target: Column, comp: Column, premium: dict[str, float] = FUEL_PREMIUM) -> Column:
    """Factor that converts a price between fuels, within 0.8..1.25."""
    of = lambda c: F.coalesce(*[F.when(c == k, v) for k, v in premium.items()], F.lit(1.0))
    return F.greatest(F.lit(0.8), F.least(F.lit(1.25), of(target) / of(comp)))


def _levels() -> Column:
    """Numbers (from 1) of the levels that a pair satisfies."""
    t, c = (lambda f: F.col(f"t.{f}")), (lambda f: F.col(f"c.{f}"))
    each = []
    for i, (span, gearbox, fuel, near, _, _, least) in enumerate(LEVELS, 1):
        ok = (F.abs(t("year") - c("year")) <= span) & (F.col("sim") >= least)
        ok &= (F.abs(t("rank") - c("rank")) <= 1) if near else t("rank").eqNullSafe(c("rank"))
        if fuel:
            ok &= t("fuel").eqNullSafe(c("fuel"))
        if gearbox:
            ok &= t("gearbox").eqNullSafe(c("gearbox"))
        each.append(F.when(ok, i))
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def comparable_pairs(df: DataFrame, keys: list[str], premium: dict[str, float] = FUEL_PREMIUM) -> DataFrame:
    """Target, comparable, level and converted price of every pair and level that fit; needs id, year, km, price, fuel, gearbox, rank."""
    row = F.struct("id", "year", "km", "price", "fuel", "gearbox", "rank")
    priced = df.where("price > 0 and year is not null")
    reach = max(x[0] for x in LEVELS)
    targets = priced.select(*keys, row.alias("t"), F.explode(F.sequence(F.col("year") - reach, F.col("year") + reach)).alias("_y"))
    pairs = targets.join(priced.select(*keys, row.alias("c"), F.col("year").alias("_y")), [*keys, "_y"]).where("t.id <> c.id")
    pairs = pairs.withColumn("sim", similarity()).where(F.col("sim") >= min(x[-1] for x in LEVELS))
    out = pairs.withColumn("level", F.explode(_levels()))
    # a level that asks for the same fuel has a factor of 1 anyway
    return out.withColumn("price", F.col("c.price") * fuel_factor(F.col("t.fuel"), F.col("c.fuel"), premium))


def _kinds(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The priced listings with their kind, and the kinds with their number; null keys and ids meet nothing."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c)
    rows = df.where("price > 0 and year is not null and id is not null").dropna(subset=keys)
    rows = rows.select("id", F.struct(*keys).alias("g"), F.col("price").cast("double").alias("price"), *map(number, _NUMBERS), *map(name, _NAMES))
    rows = kinds.with_repeats(kinds.dealt(rows, ["g", *_KIND[:-1]]))
    return rows, kinds.written(rows.groupBy("g", *_KIND, "k1", "k2").agg(F.count(F.lit(1)).cast("double").alias("n")))


def _parts(t: dict[str, np.ndarray], c: dict[str, np.ndarray]) -> Iterator[tuple[float, np.ndarray]]:
    """Fuel and places of targets that go together: those of one fuel, in large groups also of one year and rank."""
    by = t["fuel"][None, :] if len(c["n"]) <= SMALL else np.stack([t["fuel"], t["year"], np.nan_to_num(t["rank"], nan=-1e9)])
    groups, which = np.unique(by, axis=1, return_inverse=True)
    order = np.argsort(which.reshape(-1), kind="stable")
    yield from zip(groups[0], np.split(order, np.cumsum(np.bincount(which.reshape(-1)))[:-1]))


def _fitting(t: dict[str, np.ndarray], c: dict[str, np.ndarray], at: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of each target (row) and cell, and how many listings of the cell fit the target at level ``at``."""
    span, gearbox, fuel, near, _, _, least = LEVELS[at - 1]
    col = lambda k: t[k][:, None]
    years, km, ranks = np.abs(col("year") - c["year"]), np.abs(col("km") - c["km"]), np.abs(col("rank") - c["rank"])
    same_rank = (ranks == 0) | (np.isnan(col("rank")) & np.isnan(c["rank"]))
    other_fuel, other_gearbox = col("fuel") != c["fuel"], col("gearbox") != c["gearbox"]
    sim = np.maximum(0.25, 1.0 - years * 0.14) * np.where(np.isnan(km), 0.85, np.maximum(0.35, 1.0 - km / 200000.0))
    sim = sim * np.where(same_rank, 1.0, np.maximum(0.3, 0.85 - 0.15 * np.nan_to_num(ranks))) * np.where(other_fuel, 0.7, 1.0)
    sim = sim * np.where(other_gearbox & (col("gearbox") > 0) & (c["gearbox"] > 0), 0.85, 1.0)
    pick = (years <= span) & (sim >= least) & ((ranks <= 1) if near else same_rank) & ~((col("dup") == c["dup"]) & (col("dup") > 0))
    if fuel:
        pick &= ~other_fuel
    if gearbox:
        pick &= ~other_gearbox
    count = np.where(pick, c["n"], 0.0)
    own = np.flatnonzero((t["own"] >= 0) & pick[np.arange(len(pick)), t["own"]] & (t["dup"] == 0))
    count[own, t["own"][own]] -= 1  # a listing is no comparable of itself
    return sim, count


def _blocks(t: dict[str, np.ndarray], c: dict[str, np.ndarray], premium: dict[str, float], block: Callable) -> Iterator[tuple[int, np.ndarray, Any]]:
    """(level, rows, result) of ``block(targets, cells by ascending converted price, level)`` in parts of CELLS cells.

    ``block`` tells first which of its rows are done: those are not asked at the next levels.
    """
    for k in (*_NAMES, "dup"):
        t[k], c[k], names = kinds.codes(t[k], c[k])
        if k == "fuel":
            of = np.array([premium.get(x[1:], 1.0) for x in names])
    for fuel, left in _parts(t, c):
        price = c["price"] * np.maximum(0.8, np.minimum(1.25, of[int(fuel)] / of[c["fuel"]]))
        years = t["year"][left].min(), t["year"][left].max()
        for level, (span, _, same, _, _, _, _) in enumerate(LEVELS, 1):
            may = (c["year"] >= years[0] - span) & (c["year"] <= years[1] + span)
            some = np.flatnonzero(may & (c["fuel"] == fuel) if same else may)
            if not len(some) or not len(left):
                continue
            some = some[np.argsort(price[some], kind="stable")]
            among, done = {k: v[some] for k, v in c.items()} | {"price": price[some]}, []
            place = np.full(len(price) + 1, -1)  # the last for targets without a cell
            place[some] = np.arange(len(some))
            step = max(1, CELLS // len(some))
            for s in range(0, len(left), step):
                rows = left[s : s + step]
                found, got = block({k: v[rows] for k, v in t.items()} | {"own": place[t["own"][rows]]}, among, level)
                done.append(rows[found])
                yield level, rows, got
            left = np.setdiff1d(left, np.concatenate(done))


def comparable_levels(df: DataFrame, keys: list[str], premium: dict[str, float] = FUEL_PREMIUM) -> DataFrame:
    """level, pairs, targets, mean_similarity of ``comparable_pairs`` without writing a pair; targets are distinct ids."""
    counted = _kinds(df, keys)[1]

    def block(t: dict, c: dict, level: int) -> tuple[np.ndarray, tuple]:
        sim, count = _fitting(t, c, level)
        return np.zeros(0, np.int64), (count.sum(1), (count * sim).sum(1))

    def run(t: dict, c: dict) -> Iterator[pd.DataFrame]:
        parts = [pd.DataFrame({"k1": t["k1"][rows], "k2": t["k2"][rows], "level": level, "pairs": got[0], "sims": got[1]}) for level, rows, got in _blocks(t, c, premium, block)]
        if parts:
            out = pd.concat(parts)
            yield out[out["pairs"] > 0]

    found = kinds.meet(counted.select("g", *_READ, "k1", "k2"), counted, ["year", "fuel", "rank"], run, "k1 long, k2 long, level int, pairs double, sims double", SLICE)
    x = counted.select("k1", "k2", "n", "dup").join(found, ["k1", "k2"])
    # an id that stands once is a target of its own
    x = x.groupBy("level", "dup").agg(F.sum(F.col("n") * F.col("pairs")).alias("pairs"), F.sum(F.col("n") * F.col("sims")).alias("sims"), F.when(F.col("dup") == "", F.sum("n")).otherwise(1.0).alias("targets"))
    x = x.groupBy("level").agg(*[F.sum(c).alias(c) for c in ("pairs", "targets", "sims")])
    return x.select("level", F.col("pairs").cast("long").alias("pairs"), F.col("targets").cast("long").alias("targets"), (F.col("sims") / F.col("pairs")).alias("mean_similarity"))


def estimate_block(t: dict[str, np.ndarray], c: dict[str, np.ndarray], at: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Places and estimates of the targets that level ``at`` can value from the cells (by ascending price)."""
    least, penalty = LEVELS[at - 1][4:6]
    sim, count = _fitting(t, c, at)
    n0 = count.sum(1).astype(np.int64)
    found = np.flatnonzero(n0 >= max(least, 3))
    if not len(found):
        return found, {}
    price, sim, count, n0 = c["price"], sim[found], count[found], n0[found]
    off, mad = kinds.deviation(price, count, n0)
    with np.errstate(invalid="ignore", divide="ignore"):
        far = ((n0 >= 4) & (mad > 0))[:, None] & (0.6745 * off / mad[:, None] > 3.5)
    gone = np.where(far, count, 0).sum(1).astype(np.int64)
    gone = np.where(gone <= np.maximum(1, n0 // 4), gone, 0)
    some = n0 - gone >= 3
    found, sim, n = found[some], sim[some], (n0 - gone)[some]
    if not len(found):
        return found, {}
    use = np.where(far & (gone > 0)[:, None], 0.0, count)[some]
    ty, tk = t["year"][found], t["km"][found]
    # order statistics: winsorised price, middle year and mileage (unknown ones stand first)
    upto, k = np.cumsum(use, axis=1), np.maximum(1, n // 20)
    lo, hi = kinds.at_place(upto, price, k), kinds.at_place(upto, price, np.maximum(n - k - 1, 0))
    pulled = np.where((n >= 5)[:, None], np.minimum(np.maximum(price, lo[:, None]), hi[:, None]), price)

    def middle(x: np.ndarray) -> np.ndarray:
        order = np.argsort(np.where(np.isnan(x), -np.inf, x), kind="stable")
        return kinds.at_place(np.cumsum(use[:, order], axis=1), x[order], n // 2)

    mid_year, mid_km = middle(c["year"]), middle(c["km"])
    weight = sim / (1 + np.abs(ty[:, None] - c["year"])) / (1 + np.nan_to_num(np.abs(tk[:, None] - c["km"])) / 60000.0)
    reached = np.cumsum(weight * use, axis=1)
    rows, last = np.arange(len(found)), len(price) - 1
    # cells that are not used add nothing, so the first that reaches a share is a used one
    share = lambda q: pulled[rows, (reached < (reached[:, -1] * q - SLACK)[:, None]).sum(1).clip(0, last)]
    center, q25, q75 = share(0.5), share(0.25), share(0.75)
    known = np.flatnonzero(c["km"] > 0)
    year_slope = kinds.slope(c["year"], price, use, 2)
    with np.errstate(invalid="ignore", divide="ignore"):
        km_slope = kinds.slope(np.log(c["km"][known]), np.log(price[known]), use[:, known], 2)
        shift = np.where((n >= 5) & (year_slope > 0), (ty - mid_year) * year_slope, 0.0)
        shift = np.maximum(center * -0.25, np.minimum(center * 0.25, shift))
        factor = np.clip((tk / mid_km) ** np.clip(km_slope, -0.45, -0.05), 0.75, 1.25)
        factor = np.where((n >= 5) & (mid_km > 0) & (tk > 0) & (np.abs(mid_km - tk) > 5000) & (np.abs(factor - 1) > 0.02), factor, 1.0)
        lowest, highest = kinds.at_place(upto, price, np.zeros(len(n), np.int64)), kinds.at_place(upto, price, n - 1)
        value = np.maximum(lowest * 0.75, np.minimum(highest * 1.25, (center + shift) * factor))
        sd = np.sqrt((use * (price - (use @ price / n)[:, None]) ** 2).sum(1) / (n - 1))
        radius = (np.maximum(q75 - q25, value * 0.04) * 0.5 + 1.96 * 1.253 * sd / np.sqrt(n)) * (2.0 - penalty)
        radius = np.minimum(radius, value * 0.4)
    low, high = np.maximum(np.maximum(value - radius, value * 0.55), 300.0), np.maximum(value + radius, value * 1.03)
    return found, {"n": n, "value": value, "low": low, "high": high, "mean_similarity": (use * sim).sum(1) / n, "place": found}


def comparable_estimates(df: DataFrame, keys: list[str], premium: dict[str, float] = FUEL_PREMIUM) -> DataFrame:
    """id, level, n, value, low, high, mean_similarity of each listing that any level can value; others are left out.

    Within a level, prices over 3.5 modified deviations from the median go unless that is more than a quarter; the first level
    with its least number and three left decides. Prices are then pulled to the 5 % order statistics, the weighted median is
    shifted by the year slope and scaled by the mileage elasticity (where mileages differ), and the interval grows with spread, error and penalty.
    Ids name listings: rows of one id are no comparables of each other, and each is valued.
    """
    rows, counted = _kinds(df, keys)

    def run(t: dict, c: dict) -> Iterator[pd.DataFrame]:
        parts = [pd.DataFrame(got | {"k1": t["k1"][rows[got["place"]]], "k2": t["k2"][rows[got["place"]]], "level": level}) for level, rows, got in _blocks(t, c, premium, estimate_block) if got]
        if parts:
            yield pd.concat(parts)[["k1", "k2", *[x.split()[0] for x in _OUT.split(", ")]]]

    found = kinds.meet(counted.select("g", *_READ, "k1", "k2"), counted, ["year", "fuel", "rank"], run, f"k1 long, k2 long, {_OUT}", SLICE)
    return rows.select("id", "k1", "k2").join(found, ["k1", "k2"]).select("id", *[x.split()[0] for x in _OUT.split(", ")])
