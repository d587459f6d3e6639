"""Bundles of operators and readers of structured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import clean, joins, rules, valuation


def json_ld(html: Column) -> Column:
    """Struct name, offer_price, currency, production_year of the first vehicle in a page's linked data: an object, a list or a @graph."""
    raw = F.regexp_extract(html, r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    node = "array<struct<`@type`:string,name:string,offers:struct<price:double,priceCurrency:string>,productionDate:int>>"
    graph, listed = F.from_json(raw, f"struct<`@graph`:{node}>")["@graph"], F.from_json(raw, node)
    found = F.filter(F.coalesce(graph, listed, F.array().cast(node)), lambda n: n["@type"].isin("Vehicle", "Car", "Product", "Motorcycle"))
    one = F.get(found, F.lit(0))
    return F.struct(one["name"].alias("name"), one["offers"]["price"].alias("offer_price"), one["offers"]["priceCurrency"].alias("currency"), one["productionDate"].alias("production_year"))


def page_cards(df: DataFrame, page: str, html: str) -> DataFrame:
    """(page, title, price) of every card of a listing page: a heading and a price paragraph."""
    card = r'(?s)<h2>([^<]*)</h2>\s*<p class="price">([^<]*)</p>'
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(card), F.lit(1)).alias("title"), F.regexp_extract_all(html, F.lit(card), F.lit(2)).alias("price"))
    return df.select(page, F.explode(pairs).alias("c")).select(page, "c.title", clean.number(F.col("c.price")).alias("price"))


def staged_dedupe(df: DataFrame, stages: list[list[str]], order: list[str]) -> DataFrame:
    """Rows left after each stage of keeping the first row of a key; stage 0 is the input."""
    out = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("stage"), "n")
    for i, keys in enumerate(stages, 1):
        df = clean.keep_first(df, keys, [F.col(c) for c in order])
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("stage"), "n"))
    return out


def description(c: str) -> Column:
    """Struct of a description without contacts and markup, whether it had contacts, and its words."""
    bare = clean.strip_contacts(F.col(c))
    return F.struct(clean.text_clean(bare).alias(f"{c}_cleaned"), (bare != F.col(c)).alias("has_contact"), F.regexp_count(bare, F.lit(r"[^ \n\t\r]+")).cast("long").alias("n_words"))


def record_status(df: DataFrame, asof_year: int) -> DataFrame:
    """``df`` with ``status`` and ``reason``: rejected with the first reason that applies, else success."""
    reason = rules.reject_reason(F.col("price"), F.col("year"), F.col("mileage"), F.col("make"), F.col("version"), asof_year)
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNotNull(), "rejected").otherwise("success"))


def score_in_range(df: DataFrame, keys: list[str], year: str, price: str, km: str, reach: int = 2) -> DataFrame:
    """``df`` with the mean of its keys within ``reach`` years and the deal score against it."""
    means = joins.year_range_mean(df, keys, year, price, reach).drop("range_n")
    return df.join(means, [*keys, year]).withColumn("score", valuation.deal_score(F.col(price), F.col("range_mean"), F.col(km)))


def relevance_parts(deal: Column, age_days: Column, price: Column, value: Column) -> Column:
    """Struct of what deal score, recency and price position add to the relevance."""
    gap = F.try_divide(value - price, value)
    recency = F.when(age_days <= 7, 1.0).when(age_days <= 30, 0.7).when(age_days <= 60, 0.4).otherwise(0.1)
    position = F.when(gap.isNull(), 0.5).when(gap > 0.2, 1.0).when(gap > 0.1, 0.8).when(gap > 0, 0.6).when(gap > -0.1, 0.5).otherwise(0.3)
    return F.struct((0.4 * F.least(F.coalesce(deal, F.lit(0.0)) / 10, F.lit(1.0))).alias("deal"), (0.2 * recency).alias("recency"), (0.2 * position).alias("position"))


def trending(df: DataFrame, key: str, ts: str, asof: str, days: int, k: int) -> DataFrame:
    """The k keys that grew most in the last days against as many days before."""
    end = F.lit(asof).cast("date")
    recent, before = F.col(ts) >= F.date_sub(end, days), (F.col(ts) >= F.date_sub(end, 2 * days)) & (F.col(ts) < F.date_sub(end, days))
    g = df.groupBy(key).agg(F.count_if(recent).alias("recent"), F.count_if(before).alias("before")).where("recent > 0")
    return g.withColumn("growth", F.col("recent") / F.greatest("before", F.lit(1))).orderBy(F.desc(F.round("growth", 6)), key).limit(k)


def user_insights(df: DataFrame, user: str, ts: str, kind: str, value: str) -> DataFrame:
    """Events, active days, mean value and the most frequent kind (ties: the least) of each user."""
    kinds = df.groupBy(user, kind).agg(F.count(F.lit(1)).alias("_k")).groupBy(user).agg(F.min(F.struct(-F.col("_k"), kind))[kind].alias("favourite"))
    g = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col(ts).cast("date")).alias("days"), F.avg(value).alias("mean_value"))
    return g.join(kinds, user)


def year_and_km(c: Column) -> Column:
    """Struct of the two parts of ``year – km``."""
    parts = r"(?i)((?:19|20)[0-9]{2})\s*[–-]\s*([0-9. ]+?)\s*km"
    return F.struct(F.regexp_extract(c, parts, 1).try_cast("int").alias("found_year"), F.regexp_replace(F.regexp_extract(c, parts, 2), "[. ]", "").try_cast("long").alias("found_km"))


def ceiling(c: Column, table: tuple, other: str) -> Column:
    """Label of the first bracket whose ceiling is not below the value."""
    return F.when(c.isNotNull(), F.coalesce(*[F.when(c <= top, label) for top, label in table], F.lit(other)))


def criteria_union(df: DataFrame, criteria: dict[str, str]) -> DataFrame:
    """Every row once for each criterion that it meets, with the criterion's name."""
    names = F.array_compact(F.array(*[F.when(F.expr(e), F.lit(k)) for k, e in criteria.items()]))
    return df.withColumn("criterion", F.explode(names))


def numbers_by_kind(c: Column) -> Column:
    """Struct of arrays: years from 1900 to 2099, numbers before a currency sign, numbers before km."""
    take = lambda p: F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda x: x.try_cast("long"))
    return F.struct(take(r"\b((?:19|20)[0-9]{2})\b").alias("years"), take(r"([0-9]+)\s*[€$£¥]").alias("prices"), take(r"([0-9]+)\s*(?:kms|km|quilómetros)").alias("km"))


