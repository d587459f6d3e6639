"""Relevance of search results, and attributes read from listing texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def completeness(required: list[str], optional: list[str]) -> Column:
    share = lambda cols: sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) / len(cols)
    return 0.7 * share(required) + 0.3 * share(optional)


def relevance(deal: Column, age_days: Column, price: Column, value: Column, complete: Column) -> Column:
    """Weighted deal score, recency, price position and completeness, within 0..1; no valuation counts as half."""
    recency = F.when(age_days <= 7, 1.0).when(age_days <= 30, 0.7).when(age_days <= 60, 0.4).otherwise(0.1)
    gap = F.try_divide(value - price, value)
    position = F.when(gap.isNull(), 0.5).when(gap > 0.2, 1.0).when(gap > 0.1, 0.8).when(gap > 0, 0.6).when(gap > -0.1, 0.5).otherwise(0.3)
    return 0.4 * F.least(F.coalesce(deal, F.lit(0.0)) / 10, F.lit(1.0)) + 0.2 * recency + 0.2 * position + 0.2 * complete


def km_in(text: Column, most: int = 1_500_000) -> Column:
    """First mileage of a text: ``120.000 km``, ``120 000 km`` or ``150 mil km``; null above ``most``."""
    found = r"(?i)([0-9]{1,3}(?:[. ][0-9]{3})+|[0-9]+)\s*(mil\s+)?kms?\b"
    n = F.regexp_replace(F.regexp_extract(text, found, 1), "[. ]", "").try_cast("long") * F.when(F.regexp_extract(text, found, 2) != "", 1000).otherwise(1)
    return F.when(n <= most, n)


def registered_year(text: Column, last: int) -> Column:
    """Year of the first ``mm/yyyy`` or ``mm-yyyy`` of a text, 1950 to ``last``."""
    y = F.regexp_extract(text, r"\b(0?[1-9]|1[0-2])[/-]((?:19|20)[0-9]{2})\b", 2).try_cast("int")
    return F.when(y.between(1950, last), y)
