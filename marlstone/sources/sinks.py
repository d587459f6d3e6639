"""Sinks: file writers and keyed upserts as pure DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.csv(path, header=True, mode=mode)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.json(path, mode=mode)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    df.write.parquet(path, mode=mode, partitionBy=partition_by)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """Rows of ``base`` with those of ``delta`` put in by key; of several rows of a key in ``delta`` the first by ``newest``.

    Adds ``action``: kept, updated or inserted. A null key never matches, so such rows are inserted.
    """
    w = Window.partitionBy(*keys).orderBy(*newest)
    d = delta.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    rest = base.join(d.select(*keys), keys, "left_anti").withColumn("action", F.lit("kept"))
    known = base.select(*keys).distinct().withColumn("_known", F.lit(True))
    put = d.join(known, keys, "left").withColumn("action", F.when(F.col("_known"), "updated").otherwise("inserted")).drop("_known")
    return rest.unionByName(put)


def merge_non_empty(base: DataFrame, delta: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Evidence-gated upsert: a new value replaces the old one only where it is neither null nor an empty string."""
    d = delta.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(d, keys, "full_outer")
    text = {c for c, t in delta.dtypes if t == "string"}
    new = lambda c: F.nullif(F.col(f"_new_{c}"), F.lit("")) if c in text else F.col(f"_new_{c}")
    return joined.select(*keys, *[F.coalesce(new(c), F.col(c)).alias(c) for c in columns])


def price_changes(history: DataFrame, key: str, ts: str, price: str, *tie: str) -> DataFrame:
    """Rows that a price history appends: first sight of a key, and every change of its price."""
    w = Window.partitionBy(key).orderBy(ts, *tie)
    prev = F.lag(price).over(w)
    return history.withColumn("previous_price", prev).where(~F.col(price).eqNullSafe(F.col("previous_price")))
