"""Keyed upserts that survive a restart, merged when read, and evidence-gated upserts with outcome counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.sources.shared import fresh_path

#: Deltas after which a batch folds them into a new base.
COMPACT_AFTER = 8


def _finished(spark: SparkSession, out: str) -> tuple[int | None, list[int]]:
    """Number of the newest finished base under ``out``, and of the finished deltas after it, from the folder alone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None, []
    found: dict[str, list[int]] = {"base": [], "delta": []}
    for s in fs.listStatus(path):
        kind, _, number = s.getPath().getName().partition("-")
        if kind in found and fs.exists(s.getPath().suffix("/_SUCCESS")):
            found[kind].append(int(number))
    base = max(found["base"], default=None)
    return base, sorted(n for n in found["delta"] if base is None or n > base)


def newest_of(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def current(spark: SparkSession, out: str, schema, keys: list[str], newest: list[Column]) -> DataFrame:
    """The newest row of each key: the base and the deltas after it, merged now. Empty before the first batch."""
    base, deltas = _finished(spark, out)
    paths = ([f"{out}/base-{base:09d}"] if base is not None else []) + [f"{out}/delta-{n:09d}" for n in deltas]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*paths)
    return newest_of(rows, keys, newest) if deltas else rows


def put_batch(spark: SparkSession, batch: DataFrame, number: int, out: str, keys: list[str], newest: list[Column], compact_after: int = COMPACT_AFTER) -> None:
    """Write the newest rows of one micro-batch as delta ``number``; a batch that is repeated writes the same delta again.

    What counts is the folder: a delta without its mark of success is not read, and nothing is kept in the driver, so a job
    started anew goes on where the folder ends. The table as a whole is only written when deltas are folded into a new base.
    """
    base, deltas = _finished(spark, out)
    if base is not None and number <= base:
        return  # folded already
    newest_of(batch, keys, newest).write.mode("overwrite").parquet(f"{out}/delta-{number:09d}")
    if len({*deltas, number}) >= compact_after:
        current(spark, out, batch.schema, keys, newest).write.mode("overwrite").parquet(f"{out}/base-{number:09d}")


# --- evidence-gated upserts

#: What an observation may come to; the first three are rejected.
OUTCOMES = ("unknown_source", "invalid", "duplicate", "updated", "inserted")
_UNKNOWN = ("", "unknown", "none")


def valid_url(c: Column) -> Column:
    """Ten characters and more, http or https, and a host."""
    t = F.trim(c)
    return F.coalesce((F.length(t) >= 10) & t.rlike(r"^(?i)https?://[^/?#\s]+"), F.lit(False))


def _first_claims(rows: DataFrame) -> DataFrame:
    """(ord) of the rows that are taken when rows come in order and a row is refused whose identity or url a taken one has.

    A row that is the first undecided one of both is taken, those that share either with it are refused; rounds go on over
    the undecided rows, which are only those that share an identity or url with another, each round written.
    """
    spark, taken, open_ = rows.sparkSession, None, rows.select("ord", "identity", "url")
    while True:
        path = fresh_path(spark)
        open_.write.parquet(path)
        open_ = spark.read.schema("ord long, identity string, url string").parquet(path)
        if open_.isEmpty():
            return taken if taken is not None else open_.select("ord")
        first = lambda k: F.min("ord").over(Window.partitionBy(k))
        now = open_.withColumn("_i", first("identity")).withColumn("_u", first("url")).where("ord = _i and ord = _u").select("ord", "identity", "url")
        open_ = open_.join(now.select("identity"), "identity", "left_anti").join(now.select("url"), "url", "left_anti").select("ord", "identity", "url")
        path = fresh_path(spark)
        (now if taken is None else now.select("ord").unionByName(taken)).select("ord").write.parquet(path)
        taken = spark.read.schema("ord long").parquet(path)


def gated_upsert(base: DataFrame, observed: DataFrame, core: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table after the observations, and the observations with ``outcome`` (of OUTCOMES), ``valid_price`` and ``price_change``.

    ``observed``: ord (long, unique), source, source_id, url, price, currency, price_kind, conflict (whether its evidence
    contradicts itself), quality, brand, observed_at and the ``core`` columns; ``base``: source, source_id, url, price,
    last_seen and ``core``. An observation of no source, no web address, no total price in EUR above zero, a conflict, an
    invalid quality or no brand changes nothing. A row is known by (source, source_id), the address standing in for a missing
    id; a known row takes the values that are neither null, empty nor zero, the latest first. A new row whose identity or
    address an earlier taken one or the table has is a duplicate. A null quality counts as invalid; an empty table of
    observations changes nothing.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    name = lambda: F.concat_ws("\x1f", F.col("source"), F.substring(F.coalesce(blank("source_id"), F.trim("url")), 1, 100))
    old = base.withColumn("identity", name())
    x = observed.withColumn("identity", name()).withColumn("url", F.trim("url"))
    x = x.join(old.select("identity", F.col("price").alias("_old_price"), F.lit(True).alias("_known")), "identity", "left")
    x = x.join(old.select(F.trim("url").alias("url"), F.lit(True).alias("_url_known")).distinct(), "url", "left")
    good_price = F.coalesce((F.col("price") > 0) & (F.col("price_kind") == "total") & (F.col("currency") == "EUR") & ~F.coalesce("conflict", F.lit(False)), F.lit(False))
    good = good_price & (F.coalesce("quality", F.lit("invalid")) != "invalid") & ~F.lower(F.coalesce(F.trim("brand"), F.lit(""))).isin(*_UNKNOWN)
    known = F.coalesce("_known", F.lit(False))
    step = F.when(F.col("source").isNull(), "unknown_source").when(~valid_url(F.col("url")), "invalid").when(~known & F.col("_url_known"), "duplicate")
    x = x.withColumns({"_good": good, "valid_price": good_price, "_step": F.coalesce(step, F.when(known, F.when(good, "updated").otherwise("invalid")), F.lit("new"))})
    path = fresh_path(observed.sparkSession)
    x.write.parquet(path)
    x = observed.sparkSession.read.schema(x.schema).parquet(path)
    taken = _first_claims(x.where("_step = 'new' and _good"))
    claims = x.where("_step = 'new'").join(taken.withColumn("_taken", F.lit(True)), "ord", "left")
    first = claims.where("_taken").select("identity", "url", F.col("ord").alias("_ord"))
    # what comes after a taken row of its identity or address is a duplicate, good or not
    by = claims.join(first.select("identity", F.col("_ord").alias("_oi")), "identity", "left").join(first.select("url", F.col("_ord").alias("_ou")), "url", "left")
    late = (F.col("_oi") < F.col("ord")) | (F.col("_ou") < F.col("ord"))
    new = by.select("ord", F.when(F.col("_taken"), "inserted").when(late, "duplicate").otherwise("invalid").alias("_new"))
    x = x.join(new, "ord", "left").withColumn("outcome", F.coalesce("_new", "_step"))
    before = F.coalesce(F.lag("price").over(Window.partitionBy("identity", "outcome").orderBy("ord")), "_old_price")
    x = x.withColumn("price_change", F.when(F.col("outcome") == "updated", ~F.col("price").eqNullSafe(before)).otherwise(F.col("outcome") == "inserted"))
    valid = F.col("valid_price") & ~F.col("outcome").isin("unknown_source", "duplicate") & valid_url(F.col("url"))

    types = dict(observed.dtypes)
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if types[c] == "string" else F.when(F.col(c) != 0, F.col(c)) if types[c] not in ("boolean", "timestamp", "date") else F.col(c)
    # of the latest observation that has a value; max_by leaves rows without one out
    latest = lambda c: F.max_by(some(c), F.when(some(c).isNotNull(), F.col("ord"))).alias(f"_new_{c}")
    changed = x.where("outcome = 'updated'").groupBy("identity").agg(*[latest(c) for c in core], F.max_by("price", "ord").alias("_price"), F.max("observed_at").alias("_seen"))
    kept = old.join(changed, "identity", "left").select(
        "source", "source_id", "url", F.coalesce("_price", "price").alias("price"), F.greatest("last_seen", "_seen").alias("last_seen"), *[F.coalesce(f"_new_{c}", c).alias(c) for c in core]
    )
    added = x.where("outcome = 'inserted'").select("source", F.substring(F.coalesce(blank("source_id"), "url"), 1, 100).alias("source_id"), "url", "price", F.col("observed_at").alias("last_seen"), *core)
    out = x.withColumn("valid_price", valid).select(*observed.columns, "outcome", "valid_price", "price_change")
    return kept.unionByName(added), out


def outcome_counts(outcomes: DataFrame, complete: list[str]) -> DataFrame:
    """One row: observations found, persisted, updated, rejected, duplicates, quarantined, with a valid price, with all ``complete`` fields."""
    seen = ~F.col("outcome").isin("unknown_source", "duplicate") & valid_url(F.col("url"))
    full = F.lit(True)
    for c in complete:
        full = full & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    put = F.col("outcome").isin("updated", "inserted")
    return outcomes.agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(put).alias("persisted"), F.count_if(F.col("outcome") == "updated").alias("updated"), F.count_if(~put).alias("rejected"),
        F.count_if(F.col("outcome").isin("updated", "duplicate")).alias("duplicates"), F.count_if(seen & (F.col("quality") == "quarantined")).alias("quarantined"),
        F.count_if("valid_price").alias("valid_price"), F.count_if(seen & full).alias("complete_fields"), F.count_if(F.col("outcome") == "unknown_source").alias("unknown_sources"),
    )
