"""Cleaning, deduplication, imputation, outliers, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import buckets
from marlstone.functions.quantiles import positions, whole_quantiles


def number(c: Column) -> Column:
    """Localised number: the last separator decides; one separator before exactly three digits groups thousands."""
    return F.transform(F.array(F.regexp_replace(c, r"[^0-9.,]", "")), _number)[0]


def _number(s: Column) -> Column:
    both = s.contains(".") & s.contains(",")
    dot_last = F.length(s) - F.length(F.substring_index(s, ".", -1)) > F.length(s) - F.length(F.substring_index(s, ",", -1))
    grouped = s.rlike(r"^[0-9]{1,3}([.,][0-9]{3})+$")
    t = (
        F.when(both & dot_last, F.replace(s, F.lit(","), F.lit(""))).when(both, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(grouped, F.regexp_replace(s, "[.,]", "")).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    )
    return t.try_cast("double")


def year_of(c: Column, last: int) -> Column:
    y = F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")
    return F.when(y.between(1900, last), y)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key (nulls equal), the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def flag_exact_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("is_duplicate", F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def content_hash(*columns: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]))


def price_duplicates(df: DataFrame, keys: list[str], c: str, tolerance: float = 0.05) -> DataFrame:
    w = Window.partitionBy(*keys)
    near = F.try_divide(F.abs(F.col(c) - F.avg(c).over(w)), F.avg(c).over(w)) <= tolerance
    return df.withColumn("is_price_duplicate", F.coalesce((F.count(F.lit(1)).over(w) >= 2) & near, F.lit(False)))


def impute(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    """Fill nulls from one row of statistics."""
    if how == "median":
        x = df
        for c in columns:
            x = x.crossJoin(F.broadcast(whole_quantiles(df, c, {f"_{c}": 0.5})))
    else:
        make = {"mean": F.avg, "zero": lambda c: F.lit(0.0), "mode": lambda c: F.mode(c, True)}[how]
        x = buckets.with_scalars(df, *[make(c).alias(f"_{c}") for c in columns])
    return x.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def iqr_flags(df: DataFrame, c: str, k: float = 1.5) -> DataFrame:
    x = df.crossJoin(F.broadcast(whole_quantiles(df, c, {"_q1": 0.25, "_q3": 0.75})))
    reach = (F.col("_q3") - F.col("_q1")) * k
    return x.withColumn("iqr_outlier", (F.col(c) < F.col("_q1") - reach) | (F.col(c) > F.col("_q3") + reach)).drop("_q1", "_q3")


def z_flags(df: DataFrame, c: str, limit: float = 3.0) -> DataFrame:
    x = buckets.with_scalars(df, F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"))
    return x.withColumn("z_outlier", F.abs(F.try_divide(F.col(c) - F.col("_m"), F.col("_s"))) > limit).drop("_m", "_s")


def mad_flags(df: DataFrame, c: str, limit: float = 3.5) -> DataFrame:
    x = df.crossJoin(F.broadcast(whole_quantiles(df, c, {"_med": 0.5}))).withColumn("_d", F.abs(F.col(c) - F.col("_med")))
    x = x.crossJoin(F.broadcast(whole_quantiles(x, "_d", {"_mad": 0.5})))
    return x.withColumn("mad_outlier", 0.6745 * F.col("_d") / (F.col("_mad") + 1e-8) > limit).drop("_med", "_d", "_mad")


def consistency(df: DataFrame, asof_year: int) -> DataFrame:
    """Repair impossible years, mileage and prices; the age is not taken anew after the year is repaired."""
    age = F.lit(asof_year) - F.col("year")
    year = F.when(age < 0, asof_year).when(age > 50, asof_year - 50).otherwise(F.col("year")).cast("int")
    mileage = F.when((age > 0) & (F.col("mileage") > 30_000 * age), 30_000.0 * age).otherwise(F.col("mileage"))
    price = F.when((age > 20) & (F.col("price") > 50_000), 50_000.0).otherwise(F.col("price"))
    return df.withColumns({"year": year, "mileage": mileage, "price": price})


def label_encode(df: DataFrame, c: str) -> DataFrame:
    """Codes 0.. in sorted order; the distinct values are numbered, then joined back."""
    codes = df.where(F.col(c).isNotNull()).select(c).distinct().transform(lambda d: positions(d, c)).select(c, (F.col("position") - 1).cast("int").alias(f"{c}_code"))
    return df.join(codes, c, "left")


def scale(df: DataFrame, c: str) -> DataFrame:
    x = buckets.with_scalars(df, F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"), F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    x = x.crossJoin(F.broadcast(whole_quantiles(df, c, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})))
    v = F.col(c)
    return x.withColumns(
        {
            "standard": (v - F.col("_m")) / (F.col("_s") + 1e-8),
            "minmax": F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo")),
            "robust": F.try_divide(v - F.col("_q2"), F.col("_q3") - F.col("_q1")),
        }
    ).drop("_m", "_s", "_lo", "_hi", "_q1", "_q2", "_q3")


def target_encode(df: DataFrame, key: str, y: str, strength: int = 20) -> DataFrame:
    """Smoothed group means; groups join back as a small table."""
    g = df.groupBy(key).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    whole = g.agg((F.sum("_s") / F.sum("_n")).alias("_prior"))  # one row
    return g.crossJoin(F.broadcast(whole)).select(key, ((F.col("_s") + F.col("_prior") * strength) / (F.col("_n") + strength)).alias("encoded"), F.col("_n").alias("n"))


def text_clean(c: Column) -> Column:
    """Tags out, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"[ \t\n\x0B\f\r]+", " ")))


def strip_contacts(c: Column) -> Column:
    for p, r in ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<mail>"), (r"https?://[^ \n\t]+", "<url>"), (r"(\+351[ ]?)?[29][0-9]{2}[ .-]?[0-9]{3}[ .-]?[0-9]{3}", "<phone>")):
        c = F.regexp_replace(c, p, r)
    return c


def squeeze_runs(c: Column) -> Column:
    return F.regexp_replace(c, r"(.)\1{2,}", "$1$1")


def text_features(c: Column) -> list[Column]:
    n = F.length(c)
    return [
        n.cast("long").alias("length"), F.regexp_count(c, F.lit(r"[^ \n\t\r]+")).cast("long").alias("words"), F.regexp_count(c, F.lit("[0-9]")).cast("long").alias("digits"),
        F.try_divide(F.regexp_count(c, F.lit("[A-Z]")), n).alias("upper_ratio"),
    ]


def numbers_in(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("long"))
