"""Statistics with the reference semantics: corrected moments, exact quantiles, average ranks, weighted quantiles."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def skew(c: str) -> Column:
    """Bias-corrected skewness; null below three values or without spread."""
    n = F.count(c)
    return F.when((n >= 3) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt(c: str) -> Column:
    """Bias-corrected excess kurtosis; null below four values or without spread."""
    n = F.count(c)
    return F.when((n >= 4) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def quantile(c: str, q: float) -> Column:
    """Exact linear quantile."""
    return F.percentile(c, F.lit(q))


def describe(c: str) -> list[Column]:
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), quantile(c, 0.25).alias("q25"), quantile(c, 0.5).alias("median"), quantile(c, 0.75).alias("q75"), F.max(c).alias("max")]


def pct_rank(c: str, partition: list[str] | None = None) -> Column:
    """Average rank over count (ties share their mean rank)."""
    by = Window.partitionBy(*(partition or []))
    peers = Window.partitionBy(*(partition or []), c)
    return F.when(F.col(c).isNotNull(), (F.rank().over(by.orderBy(F.col(c).asc_nulls_last())) + (F.count(c).over(peers) - 1) / 2.0) / F.count(c).over(by))


def zscore(c: str, w: WindowSpec) -> Column:
    return F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w))


def pct_change(c: Column | str, w: WindowSpec) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    prev = F.lag(x).over(w)
    return F.try_divide(x - prev, prev)
