"""Listings that are alike in all that an estimate reads are of one kind: estimated once, and given to each of them.

Kinds carry counts, so a table with many copies costs what its kinds cost. Keys of kinds are 128 bits of hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.shared import fresh_path, written

#: Packed rows (some 100 bytes each) that a task gets on average at most.
PACKED = 500_000


def hashes(columns: list[str]) -> dict[str, Column]:
    return {"k1": F.xxhash64(F.lit(1), *columns), "k2": F.xxhash64(F.lit(2), *reversed(columns))}


def keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with its kind, ``k1`` and ``k2``, over the columns named."""
    return df.withColumns(hashes(columns))


def dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with their kind, written so that those of a kind lie together: what groups or joins them by kind moves none of them again."""
    spark = rows.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), fresh_path(spark)
    name = f"marlstone_{path.rsplit('/', 1)[1]}"
    together = keyed(rows.repartition(n, *hashes(columns).values()), columns)
    together.write.bucketBy(n, "k1", "k2").sortBy("k1", "k2").option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # its files stay
    return out


def with_repeats(rows: DataFrame, *within: str) -> DataFrame:
    """``rows``, dealt by kind, with ``dup``: the id if another row of its group (without one: of the table) may have it, else empty; a clash of hashes only names an id too many.

    Ids that repeat are kinds of their own; only where there are any do rows leave their places.
    """
    h = F.xxhash64(*within, "id").alias("_h")
    many = written(rows.select(h).groupBy("_h").count().where("count > 1").select("_h", F.lit(True).alias("_many")))
    if many.isEmpty():
        return rows.withColumn("dup", F.lit(""))
    named = rows.select("*", h).join(many, "_h", "left").withColumn("dup", F.when(F.col("_many"), F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), F.lit("n"))).otherwise("")).drop("_h", "_many")
    own = lambda k: F.when(F.col("dup") == "", F.col(k)).otherwise(F.xxhash64(F.lit(k), k, "dup"))
    return named.withColumns({k: own(k) for k in ("k1", "k2")})


def meet(targets: DataFrame, cells: DataFrame, near: list[str], run: Callable[[dict, dict], Iterator[pd.DataFrame]], schema: str, size: int) -> DataFrame:
    """What ``run`` yields of each slice of a group's targets and all cells of the group, both as dictionaries of arrays.

    Both have ``g``, ``k1`` and ``k2``. Targets near one another by ``near`` share a slice of ``size``. A target also gets ``own``, the place of its cell, or -1;
    where targets and cells are not of the same kinds, ``o1`` and ``o2`` of a target name its cell.
    """
    spark = cells.sparkSession
    names, own = ([c for c in df.columns if c != "g"] for df in (cells, targets))
    mine = ("o1", "o2") if "o1" in own else ("k1", "k2")
    pack = written(cells.groupBy("g").agg(F.collect_list(F.struct(*names)).alias("p")).select("g", F.size("p").alias("c_size"), *[F.col(f"p.{c}").alias(f"c_{c}") for c in names]))
    place = F.row_number().over(Window.partitionBy("g").orderBy(*near, "k1"))
    slices = targets.withColumn("_k", F.floor((place - 1) / size)).groupBy("g", "_k").agg(F.collect_list(F.struct(*own)).alias("t"))
    slices = written(slices.select("g", F.size("t").alias("t_size"), *[F.col(f"t.{c}").alias(f"t_{c}") for c in own]))
    packed = slices.select("g", "t_size").join(pack.select("g", "c_size"), "g").agg(F.sum(F.col("t_size") + F.col("c_size"))).first()[0]

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                t, c = ({k: getattr(r, f"{side}_{k}") for k in keys} for side, keys in (("t", own), ("c", names)))
                place = {k: i for i, k in enumerate(zip(c["k1"].tolist(), c["k2"].tolist()))}
                t["own"] = np.array([place.get(k, -1) for k in zip(t[mine[0]].tolist(), t[mine[1]].tolist())], np.int64)
                yield from run(t, c)

    # few bytes stand for much work here, so what is joined is dealt anew
    tasks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (packed or 0) // PACKED)
    return slices.drop("t_size").join(pack.drop("c_size"), "g").drop("g").repartition(tasks).mapInPandas(block, schema)


def codes(t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Numbers of the names on both sides, and the names; empty is 0."""
    names = ["", *sorted({*t, *c} - {""})]
    at = {v: i for i, v in enumerate(names)}
    return np.array([at[v] for v in t], np.int64), np.array([at[v] for v in c], np.int64), names


def at_place(upto: np.ndarray, values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Value at a place (from 0) of each row's counted values; ``upto`` are running counts in the order of ``values``."""
    at = np.minimum((upto <= place[:, None]).sum(1), upto.shape[1] - 1)
    return values[at] if values.ndim == 1 else values[np.arange(len(values)), at]


def deviation(price: np.ndarray, count: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each price (ascending) is from the row's counted median, and the median of that."""
    middle = lambda upto, v: (at_place(upto, v, np.maximum(n - 1, 0) // 2) + at_place(upto, v, n // 2)) / 2
    off = np.abs(price - middle(np.cumsum(count, axis=1), price)[:, None])
    order = np.argsort(off, axis=1)
    return off, middle(np.cumsum(np.take_along_axis(count, order, 1), axis=1), np.take_along_axis(off, order, 1))


def slope(x: np.ndarray, y: np.ndarray, count: np.ndarray, least: int) -> np.ndarray:
    """Least-squares slope of each row over its counted points; NaN below ``least`` points or without spread."""
    n = count.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        dx = x - (count @ x / n)[:, None]
        wx = count * dx
        den = (wx * dx).sum(1)
        return np.where((n >= least) & (den > 1e-12), (wx * (y - (count @ y / n)[:, None])).sum(1) / den, np.nan)
