"""Readers: driver tables, the listings view over them, and file sources with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.sources.shared import written

#: Schema of a listing frame as files carry it.
LISTING_SCHEMA = (
    "make string, model string, year int, price double, mileage double, fuel_type string, transmission string, engine_size double, location string, "
    "condition string, description string, source string, seller_type string, date_scraped timestamp"
)

#: Listings for each task where they are joined to a large table, and rows from which a table is large.
TASK_ROWS, LARGE = 1_000_000, 2_000_000
#: Suppliers up to which they go to every task, and rows from which the other side of a join is hashed and the listings not sorted.
FEW, HASHED = 500_000, 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | StructType = LISTING_SCHEMA) -> DataFrame:
    """CSV with a header; rows that do not parse become nulls."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_json(spark: SparkSession, path: str, schema: str | StructType = LISTING_SCHEMA) -> DataFrame:
    """A file that holds one array of objects."""
    return spark.read.json(path, schema=schema, multiLine=True)


def with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items as often as orders have their key, without columns of orders.

    Only keys that orders do not hold exactly once are joined: mostly none, so no line item is moved.
    """
    items, per = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("_n"))
    asked = items.where("l_orderkey is not null").select("l_orderkey").distinct()
    odd = asked.join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left").where("_n is null or _n <> 1")
    odd = written(odd.select(F.col("l_orderkey").alias("_k"), F.coalesce("_n", F.lit(0)).alias("_n")))
    items = items.where("l_orderkey is not null")
    if odd.isEmpty():
        return items
    some = items.join(odd, F.col("l_orderkey") == F.col("_k"), "left").withColumn("_n", F.coalesce("_n", F.lit(1))).where("_n > 0")
    return some.withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).drop("_k", "_n")


def listings(spark: SparkSession, sf_dir: str, orders: bool = True) -> DataFrame:
    """The marketplace view over the star schema; small dimensions are left to the optimiser's size checks.

    Where both sides of a join are large, the number of its tasks grows with the listings (counts come from the files'
    footers), so what a task sorts is bounded. Without ``orders`` the columns that orders have are left out.
    """
    t = lambda n: table(spark, sf_dir, n)
    tasks = t("lineitem").count() // TASK_ROWS
    many = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df, key, other: df.repartition(tasks, key) if many and t(other).count() > LARGE else df
    hashed = lambda name: t(name).hint("shuffle_hash") if t(name).count() > HASHED else t(name)
    sellers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sellers = F.broadcast(sellers.select("s_suppkey", "s_name", "n_name", "r_name")) if t("supplier").count() <= FEW else sellers
    if orders:
        ordered = spread(t("lineitem"), "l_orderkey", "orders").join(hashed("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    else:
        ordered = with_orders(spark, sf_dir)
    joined = spread(ordered, "l_partkey", "part").join(hashed("part"), F.col("l_partkey") == F.col("p_partkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    own = lambda *names: [F.col(c).alias(k) for c, k in names] if orders else []
    return joined.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.col("p_name").alias("version"),
        F.year("l_shipdate").alias("year"), (F.col("l_quantity") * 4000).alias("mileage"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("fuel_type"),
        F.col("l_linestatus").alias("transmission"), (F.col("p_size") / 10.0).alias("engine_size"), F.col("n_name").alias("location"), F.col("r_name").alias("source"),
        *own(("o_orderpriority", "condition")), F.col("s_name").alias("seller"), *own(("o_orderstatus", "status"), ("o_orderdate", "date_scraped")), F.col("l_shipdate").alias("last_seen"),
    )


#: The same view in DuckDB SQL, as the head of a WITH list.
LISTINGS_SQL = """with listings as (select l_orderkey as order_id, l_linenumber as line, p_brand as make, p_type as model, p_name as version, year(l_shipdate)::int as year,
 l_quantity * 4000 as mileage, l_extendedprice as price, l_returnflag as fuel_type, l_linestatus as transmission, p_size / 10e0 as engine_size, n_name as location, r_name as source,
 o_orderpriority as condition, s_name as seller, o_orderstatus as status, o_orderdate as date_scraped, l_shipdate as last_seen
 from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
"""
