"""Exact quantiles of a whole column and positions of whole tables, without one task that holds all values."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.shared import fresh_path


def dealt(df: DataFrame, order: list[str], rows: str | None = None) -> DataFrame:
    """``df`` with ``_upto`` (rows up to and with this one in the order of the columns) and ``_total``; ``rows`` names a count that a row stands for.

    Rows are dealt by sampled splitters of the order and written so; each part is summed on its own and moved by the sums of
    the parts before it.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession)
    n = F.col(rows) if rows else F.lit(1)
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    x = spark.read.schema(df.withColumn("_part", F.lit(0)).schema).parquet(path)
    parts = x.groupBy("_part").agg(F.sum(n).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over parts
    moved = parts.select("_part", before.alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("_total"))
    own = F.sum(n).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return x.withColumn("_own", own).join(F.broadcast(moved), "_part").withColumn("_upto", F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")


def positions(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``position`` from 1 in the order of the columns, and ``total``."""
    return dealt(df, list(order)).withColumnsRenamed({"_upto": "position", "_total": "total"})


def whole_quantiles(df: DataFrame, c: str, levels: dict[str, float], rows: str | None = None) -> DataFrame:
    """One row with the exact linear quantile of each level under its name; nulls are left out, an empty table gives nulls.

    ``rows`` names a count that a row stands for. Equal values are counted first, so what is dealt and summed are distinct values.
    """
    g = dealt(df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("_v")).agg(F.sum(F.col(rows) if rows else F.lit(1)).alias("_m")), ["_v"], "_m")
    place = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    at = lambda i: F.max(F.when((F.col("_upto") - F.col("_m") <= i) & (i < F.col("_upto")), F.col("_v")))
    cells = [x for k, q in levels.items() for x in (at(F.floor(place(q))).alias(f"{k}_lo"), at(F.ceil(place(q))).alias(f"{k}_hi"))]
    one = g.agg(F.max("_total").alias("_total"), *cells)
    return one.select(*[(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * (place(q) - F.floor(place(q)))).alias(k) for k, q in levels.items()])


def group_medians(df: DataFrame, keys: list[str], c: str, rows: str) -> DataFrame:
    """(``_k_`` before each key, median): exact median of each group's values, which ``rows`` counts; nulls are left out, a null key is a group.

    Values of all groups are dealt together in their order, so no group is held in one task.
    """
    g = df.where(F.col(c).isNotNull()).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(c).cast("double").alias("_v"), F.col(rows).alias("_m"))
    by = [f"_k_{k}" for k in keys]
    g = dealt(g.groupBy(*by, "_v").agg(F.sum("_m").alias("_m")), [*by, "_v"], "_m")
    size = g.groupBy(*by).agg(F.min(F.col("_upto") - F.col("_m")).alias("_first"), F.sum("_m").alias("_n")).withColumnsRenamed({k: f"_s{k}" for k in by})
    met = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in by])
    lo, hi = (F.col("_first") + part((F.col("_n") - 1) / 2) for part in (F.floor, F.ceil))
    at = lambda i: F.max(F.when((F.col("_upto") - F.col("_m") <= i) & (i < F.col("_upto")), F.col("_v")))
    return g.join(size, met).groupBy(*by).agg(((at(lo) + at(hi)) / 2).alias("median"))
