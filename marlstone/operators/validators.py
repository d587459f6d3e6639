"""Validators of single values of a listing, and the weighted score by which an element of a page is taken for a listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price range by kind (others as cars), least year and years ahead, kilometres.
PRICES, FIRST_YEAR, YEARS_AHEAD, KM = {"car": (500, 500_000), "moto": (200, 100_000)}, 1980, 1, (0, 500_000)
#: Weights of the signs of a listing, and the score from which an element is one.
WEIGHTS = {"price": 0.3, "link": 0.25, "year": 0.15, "km": 0.15, "title": 0.1, "image": 0.05, "depth": -0.02, "length": 0.01}
THRESHOLD = 0.5


def url_error(url: Column) -> Column:
    """empty or format (no scheme or host), else null."""
    return F.when(F.coalesce(url, F.lit("")) == "", "empty").when(~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]"), "format")


def range_error(c: Column, lo, hi) -> Column:
    """missing, not_numeric (a text that is no number), below or above, else null."""
    v = c.try_cast("double")
    return F.when(c.isNull(), "missing").when(v.isNull(), "not_numeric").when(v < lo, "below").when(v > hi, "above")


def price_error(price: Column, kind: Column) -> Column:
    bound = lambda k: F.coalesce(*[F.when(F.lower(kind) == name, r[k]) for name, r in PRICES.items()], F.lit(PRICES["car"][k]))
    return range_error(price, bound(0), bound(1))


def checked(url: Column, price: Column, kind: Column, year: Column, km: Column, asof_year: int) -> Column:
    """Struct of what is wrong with each value, null if nothing is; mileage may be missing and only warns."""
    errors = {"url": url_error(url), "price": price_error(price, kind), "year": range_error(year, FIRST_YEAR, asof_year + YEARS_AHEAD)}
    valid = F.lit(True)
    for e in errors.values():
        valid = valid & e.isNull()
    return F.struct(*[e.alias(k) for k, e in errors.items()], F.when(km.isNotNull(), range_error(km, *KM)).alias("km"), valid.alias("valid"))


def data_quality(required: list[Column], recommended: list[Column], every: list[Column]) -> Column:
    """Score of 0 to 10: two points off for each required value that is missing (null, empty or zero), one if any recommended is, one if less than half of all are filled."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0", "false")
    off = sum((none(c).cast("int") * 2 for c in required), F.lit(0))
    lacks = F.lit(False)
    for c in recommended:
        lacks = lacks | none(c)
    filled = sum(((F.coalesce(c.cast("string"), F.lit("")) != "").cast("int") for c in every), F.lit(0)) / max(len(every), 1)
    return F.greatest(F.lit(0), F.lit(10) - off - lacks.cast("int") - (filled < 0.5).cast("int"))


def element_score(text: Column, href: Column, tag: Column, image: Column, depth: Column) -> Column:
    """Struct confidence (0 to 1) and is_listing of an element: its text, first link, tag, whether it holds an image, and its depth; nulls count as none."""
    t = F.trim(F.coalesce(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("")))
    signs = {
        "price": t.rlike(r"\d"), "link": F.coalesce(href.contains("/anuncio-"), F.lit(False)), "year": t.rlike(r"\b(19[89]\d|20[0-2]\d)\b"),
        "km": F.lower(t).rlike(r"\d{1,3}(?:[.\s]\d{3})*\s*(?:km|quilómetros)"), "title": F.coalesce(tag.rlike("^h[1-6]$"), F.lit(False)), "image": F.coalesce(image, F.lit(False)),
    }
    raw = sum((v.cast("int") * WEIGHTS[k] for k, v in signs.items()), F.coalesce(depth, F.lit(0)) * WEIGHTS["depth"] + F.length(t) * WEIGHTS["length"])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / sum(w for w in WEIGHTS.values() if w > 0)))
    return F.struct(score.alias("confidence"), (score >= THRESHOLD).alias("is_listing"))
