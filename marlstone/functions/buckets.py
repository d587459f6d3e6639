"""Right-closed and left-closed bins as ordered CASE expressions, and data-dependent edges."""

from __future__ import annotations

from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds and labels of the named bin tables.
MILEAGE = ([0, 20_000, 50_000, 100_000, 150_000, 200_000, inf], ["0-20k", "20k-50k", "50k-100k", "100k-150k", "150k-200k", "200k+"])
AGE = ([0, 2, 5, 10, 15, 20, inf], ["0-2", "2-5", "5-10", "10-15", "15-20", "20+"])
ENGINE = ([0, 1, 1.6, 2, 3, 4, inf], ["0-1.0", "1.0-1.6", "1.6-2.0", "2.0-3.0", "3.0-4.0", "4.0+"])
ENGINE_NAMES = ([0, 1, 1.6, 2, 3, inf], ["Small", "Medium", "Large", "Very Large", "Extra Large"])
MILEAGE_NAMES = ([0, 20_000, 50_000, 100_000, 150_000, inf], ["Very Low", "Low", "Medium", "High", "Very High"])
AGE_NAMES = ([0, 2, 5, 10, 15, inf], ["New", "Nearly New", "Used", "Old", "Very Old"])
PRICE = ([0, 5_000, 10_000, 20_000, 35_000, 50_000, 75_000, 100_000, inf], ["0-5k", "5k-10k", "10k-20k", "20k-35k", "35k-50k", "50k-75k", "75k-100k", "100k+"])
SUFFICIENCY = ([0, 5, 20, 50, inf], ["Very Low", "Low", "Medium", "High"])
MOMENTUM = ([-inf, -2, 2, inf], ["Bearish", "Neutral", "Bullish"])
VALUE = ([0, 20, 40, 60, 80, 100], ["Poor", "Fair", "Good", "Very Good", "Excellent"])
PRICE_RANGES = ([0, 5_000, 10_000, 20_000, 30_000, 50_000, inf], ["<5k", "5-10k", "10-20k", "20-30k", "30-50k", ">=50k"])
ERROR_BANDS = ([0, 5_000, 15_000, 30_000, 60_000, inf], ["0-5k", "5-15k", "15-30k", "30-60k", "60k+"])


def cut(c: Column, bins: tuple[list[float], list[str]], include_lowest: bool = False) -> Column:
    """Right-closed ``(lo, hi]``; out of range and null give null."""
    bounds, labels = bins
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(bounds, bounds[1:], labels))):
        low = F.lit(True) if lo == -inf else (c >= lo) if include_lowest and lo == bounds[0] else (c > lo)
        high = F.lit(True) if hi == inf else c <= hi
        out = F.when(c.isNotNull() & low & high, label).otherwise(out)
    return out


def cut_left(c: Column, bins: tuple[list[float], list[str]]) -> Column:
    """Left-closed ``[lo, hi)``."""
    bounds, labels = bins
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(bounds, bounds[1:], labels))):
        out = F.when(c.isNotNull() & (c >= lo) & (F.lit(True) if hi == inf else c < hi), label).otherwise(out)
    return out


def sql_cut(c: str, bins: tuple[list[float], list[str]], include_lowest: bool = False) -> str:
    """The right-closed table as a SQL CASE."""
    bounds, labels = bins
    rows = []
    for lo, hi, label in zip(bounds, bounds[1:], labels):
        low = "true" if lo == -inf else f"{c} >= {lo}" if include_lowest and lo == bounds[0] else f"{c} > {lo}"
        rows.append(f"when {low} and {'true' if hi == inf else f'{c} <= {hi}'} then '{label}'")
    return f"case when {c} is null then null {' '.join(rows)} end"


def sql_cut_left(c: str, bins: tuple[list[float], list[str]]) -> str:
    bounds, labels = bins
    rows = [f"when {c} >= {lo} and {'true' if hi == inf else f'{c} < {hi}'} then '{label}'" for lo, hi, label in zip(bounds, bounds[1:], labels)]
    return f"case {' '.join(rows)} end"


def with_scalars(df: DataFrame, *aggs: Column) -> DataFrame:
    """``df`` beside a one-row aggregate of itself (one row, so its broadcast is bounded)."""
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def qcut(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    """Equal-frequency ordinal 0..n-1 from exact linear quantile edges, lowest included."""
    x = with_scalars(df, F.percentile(c, F.array(*[F.lit(i / n) for i in range(n + 1)])).alias("_edges"))
    rank = F.lit(None).cast("int")
    for i in reversed(range(n)):
        rank = F.when(F.col(c).isNotNull() & (F.col(c) <= F.get("_edges", F.lit(i + 1))), i).otherwise(rank)
    return x.withColumn(out, rank).drop("_edges")


def equal_width(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    """Equal-width ordinal 0..n-1 over [min, max], lowest included."""
    x = with_scalars(df, F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    pos = F.ceil(F.try_divide((F.col(c) - F.col("_lo")) * n, F.col("_hi") - F.col("_lo"))) - 1
    return x.withColumn(out, F.greatest(F.lit(0), F.least(F.lit(n - 1), pos)).cast("int")).drop("_lo", "_hi")
