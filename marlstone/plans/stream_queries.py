"""Queries that read and write files and streams through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.plans import rounded, sql_rounded
from marlstone.plans.domain_queries import on_table
from marlstone.registry import register
from marlstone.sources import sinks, tables
from marlstone.sources.shared import fresh_path
from marlstone.sources.tables import table
from marlstone.streaming import breakers, jobs, upserts

V = F.col
CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _round_trip(write, read, source: str):
    def run(spark, d):
        path = fresh_path(spark)
        write(table(spark, d, source), path)
        return rounded(read(spark, path))

    return run


def _write_array(df, path: str) -> None:
    """Files that hold one array of objects each: a few hundred rows a file."""
    n = F.lit(8)
    rows = df.select(F.to_json(F.struct("*")).alias("j"), F.pmod(F.xxhash64("c_custkey"), n).alias("k")).groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    rows.select("value", "k").repartition(8, "k").write.partitionBy("k").text(path)


ALL = sql_rounded("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer", "c_acctbal")
register("op_s03_csv", _round_trip(sinks.write_csv, lambda s, p: tables.read_csv(s, p, CUSTOMER), "customer"), ALL)
register("op_s04_csv_in_parts", _round_trip(lambda df, p: sinks.write_csv(df.repartition(8, "c_custkey"), p), lambda s, p: tables.read_csv(s, p, CUSTOMER).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total")), "customer"),
         sql_rounded("select c_mktsegment, count(*) as n, sum(c_acctbal) as total from customer group by c_mktsegment", "total"))
register("op_s05_json_array", _round_trip(_write_array, lambda s, p: tables.read_json(s, p, CUSTOMER).drop("k"), "customer"), ALL)
register("op_k01_json_export", _round_trip(sinks.write_json, lambda s, p: s.read.schema(CUSTOMER).json(p), "customer"), ALL)


def _appended(spark, d):
    path, c = fresh_path(spark), table(spark, d, "customer")
    sinks.write_parquet(c.where("c_acctbal < 0"), path, partition_by=["c_mktsegment"])
    sinks.write_parquet(c.where("c_acctbal >= 0"), path, mode="append", partition_by=["c_mktsegment"])
    return rounded(spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")))


register("op_k02_append", _appended, sql_rounded("select c_mktsegment, count(*) as n, min(c_acctbal) as lo, max(c_acctbal) as hi from customer group by c_mktsegment", "lo hi"))


def _gated(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    new = p.where("p_partkey % 3 = 0").select("p_partkey", F.when(V("p_partkey") % 2 == 0, "").otherwise(F.upper("p_name")).alias("p_name"), F.when(V("p_partkey") % 5 != 0, V("p_retailprice") * 2).alias("p_retailprice"))
    return rounded(sinks.merge_non_empty(p, new, ["p_partkey"], ["p_name", "p_retailprice"]))


register("op_k04_merge_non_empty", _gated, sql_rounded("select p_partkey, case when p_partkey % 3 = 0 and p_partkey % 2 <> 0 then upper(p_name) else p_name end as p_name, case when p_partkey % 3 = 0 and p_partkey % 5 <> 0 then p_retailprice * 2 else p_retailprice end as p_retailprice from part", "p_retailprice"))


def _updated(spark, d):
    """Derived columns overwrite the table by key, as one new table."""
    path, p = fresh_path(spark), table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    sinks.write_parquet(p.withColumn("value", F.lit(None).cast("double")), path)
    derived = p.where("p_size > 10").select("p_partkey", (V("p_retailprice") * 0.9).alias("new"))
    old = spark.read.parquet(path)
    out = fresh_path(spark)
    sinks.write_parquet(old.join(derived, "p_partkey", "left").withColumn("value", F.coalesce("new", "value")).drop("new"), out)
    return rounded(spark.read.parquet(out))


register("op_k06_bulk_update", _updated, sql_rounded("select p_partkey, p_size, p_retailprice, case when p_size > 10 then p_retailprice * 0.9e0 end as value from part", "p_retailprice value"))


# --- streams over the events, split into files
def _stream(spark, d):
    src = fresh_path(spark)
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    events.repartition(8, "event_id").write.parquet(src)
    return jobs.follow(spark, src, events.schema), events.schema


def _scored(spark, d):
    stream, _ = _stream(spark, d)
    out = fresh_path(spark)
    jobs.append_all(stream.where("value > 20").select("event_id", "user_id", (V("value") * 0.5 + 1).alias("score")), out)
    return rounded(spark.read.parquet(out))


SCORED = sql_rounded("select event_id, user_id, value * 0.5e0 + 1 as score from events where value > 20", "score")
register("op_r09_micro_batch_scoring", _scored, SCORED)
register("op_s11_stream_prediction", _scored, SCORED)
register("op_k09_appended_predictions", _scored, SCORED)


def _daily(spark, d):
    stream, _ = _stream(spark, d)
    out = fresh_path(spark)
    jobs.append_all(jobs.once_a_day(stream, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type", "day"), out)
    return spark.read.parquet(out)


register("op_r10_once_a_day", _daily, "select distinct user_id, event_type, ts::date::timestamp as day from events")


def _newest(spark, d):
    stream, _ = _stream(spark, d)
    return rounded(jobs.keep_newest(spark, stream, fresh_path(spark), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]))


register("op_r08_keep_newest", _newest, sql_rounded("select event_id, ts, user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) where k = 1", "value"))


def _captured(spark, d):
    """Change capture: every row is delivered once, however the files are batched."""
    stream, schema = _stream(spark, d)
    out = fresh_path(spark)
    jobs.append_all(stream, out)
    got = spark.read.schema(schema).parquet(out)
    return rounded(got.groupBy(V("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"), F.sum("value").alias("total")))


CAPTURED = sql_rounded("select ts::date as day, count(*) as n, max(event_id) as last_id, sum(value) as total from events group by 1", "total")
register("op_r01_change_capture", _captured, CAPTURED)
register("op_s12_polled_changes", _captured, CAPTURED)

on_table("op_r06_breaker", "events", lambda df: jobs.breaker(df.withColumn("failed", V("value") > 50), "user_id", "ts", "failed", ["event_id"], 3, 60),
         "with x as (select *, sum(case when value > 50 then 0 else 1 end) over (partition by user_id order by ts, event_id) as island from events), y as (select *, row_number() over (partition by user_id, island order by ts, event_id) as k from x where value > 50) select user_id, ts as opened, ts + interval 60 seconds as half_open from y where k = 3")
on_table("op_r07_late_policy", "events", lambda df: jobs.late_policy(df.withColumn("seen", F.expr("timestamp '2024-01-15 00:00:00'")).withColumn("ts", F.when(V("event_id") % 11 != 0, V("ts"))), "ts", "seen", 86400 * 10, 86400 * 5).groupBy("policy").agg(F.count(F.lit(1)).alias("n")),
         "with e as (select case when event_id % 11 <> 0 then ts end as ts from events), l as (select ts, floor(epoch(timestamp '2024-01-15 00:00:00')) - floor(epoch(ts)) as lag from e) select case when ts is null then 'not_measured' when lag < -432000 then 'rejected_future' when lag > 864000 then 'quarantined_late' else 'accepted' end as policy, count(*) as n from l group by 1")


# --- breakers as state machines, gated upserts
_MACHINE = """with recursive e as (select event_id, user_id, epoch(ts)::bigint as at, value > 50 as failed, row_number() over (partition by user_id order by ts, event_id) as k from events),
m as (select user_id, 0::bigint as k, null::bigint as event_id, 'closed' as state, 0 as failures, 0::bigint as last_failure, 0 as probes, true as allowed from (select distinct user_id from events)
 union all select n.user_id, n.k, n.event_id,
  case when n.now = 'open' then 'open' when n.failed then case when n.now = 'half_open' or n.failures + 1 >= 3 then 'open' else n.now end when n.now = 'half_open' and n.probes + 1 >= 2 then 'closed' else n.now end,
  case when n.now = 'open' then n.failures when n.failed then n.failures + 1 else 0 end, case when n.now <> 'open' and n.failed then n.at else n.last_failure end,
  case when n.now = 'open' then n.probes when n.now = 'half_open' and not n.failed and n.probes + 1 < 2 then n.probes + 1 when n.now = 'half_open' then 0 else n.probes end, n.now <> 'open'
 from (select e.user_id, e.k, e.event_id, e.at, e.failed, m.failures, m.last_failure, case when m.state = 'open' and e.at - m.last_failure >= 3600 then 'half_open' else m.state end as now,
  case when m.state = 'open' and e.at - m.last_failure >= 3600 then 0 else m.probes end as probes from m join e on e.user_id = m.user_id and e.k = m.k + 1) n)
select user_id, event_id, state, allowed from m where k > 0"""
register(
    "op_r06_breaker_states",
    lambda spark, d: breakers.breaker_states(table(spark, d, "events").withColumn("failed", V("value") > 50), "user_id", "ts", "failed", ["event_id"], 3, 3600, 2).select("user_id", "event_id", "state", "allowed"),
    _MACHINE,
)
_OBSERVED = (
    "select o_orderkey as ord, case when o_orderkey % 13 <> 0 then 'src' || cast(o_custkey % 3 as varchar(9)) end as source, cast(o_custkey as varchar(20)) as source_id, "
    "case when o_orderkey % 17 = 0 then 'ftp' else 'https' end || '://a.example/' || cast(case when o_orderkey % 11 = 0 then 2 + 2 * (o_custkey % 25) else o_custkey end as varchar(20)) as url, "
    "case when o_orderkey % 7 = 0 then 0e0 else cast(o_totalprice as double) end as price, case when o_orderkey % 19 = 0 then 'USD' else 'EUR' end as currency, 'total' as price_kind, o_orderkey % 23 = 0 as conflict, "
    "case when o_orderpriority like '1%' then 'invalid' when o_orderpriority like '2%' then 'quarantined' else 'valid' end as quality, case when o_orderkey % 29 = 0 then '' else o_orderpriority end as brand, "
    "cast(o_orderdate as timestamp) as observed_at, cast(o_orderkey % 5 as int) as km from orders where o_orderstatus <> 'F'"
)
_KNOWN = "select 'src' || cast(c_custkey % 3 as varchar(9)) as source, cast(c_custkey as varchar(20)) as source_id, 'https://a.example/' || cast(c_custkey as varchar(20)) as url, cast(c_acctbal as double) as price, timestamp '1996-01-01' as last_seen, c_name as brand, 7 as km from customer where c_custkey % 2 = 0"


def _gated(spark, d):
    observed = spark.sql(_OBSERVED.replace("from orders", "from {t}"), t=table(spark, d, "orders"))
    return upserts.gated_upsert(spark.sql(_KNOWN.replace("from customer", "from {t}"), t=table(spark, d, "customer")), observed, ["brand", "km"])


_GATED = f"""with o as ({_OBSERVED}), b as ({_KNOWN}), x as (select o.*, o.source || '-' || o.source_id as identity, b.source is not null as known, b.price as old_price, exists (select 1 from b u where u.url = o.url) as url_known,
  o.price > 0 and currency = 'EUR' and not conflict as priced from o left join b on b.source = o.source and b.source_id = o.source_id),
y as (select *, priced and quality <> 'invalid' and brand <> '' as good from x),
z as (select *, case when source is null then 'unknown_source' when not starts_with(url, 'https') then 'invalid' when not known and url_known then 'duplicate' when known and good then 'updated' when known then 'invalid' else 'new' end as step from y),
f as (select *, min(ord) filter (step = 'new' and good) over (partition by identity) as first from z),
w as (select *, case when step <> 'new' then step when ord = first then 'inserted' when ord > first then 'duplicate' else 'invalid' end as outcome from f)"""
_DONE = "w.outcome in ('updated', 'inserted')"
_SEEN = "w.outcome not in ('unknown_source', 'duplicate') and starts_with(url, 'https')"
register(
    "op_k04_gated_outcomes",
    lambda spark, d: upserts.outcome_counts(_gated(spark, d)[1], ["brand", "currency"]),
    f"""{_GATED} select count(*) as discovered, count(*) filter ({_DONE}) as persisted, count(*) filter (w.outcome = 'updated') as updated, count(*) filter (not {_DONE}) as rejected, count(*) filter (w.outcome in ('updated', 'duplicate')) as duplicates,
count(*) filter ({_SEEN} and quality = 'quarantined') as quarantined, count(*) filter ({_SEEN} and priced) as valid_price, count(*) filter ({_SEEN} and brand <> '') as complete_fields, count(*) filter (w.outcome = 'unknown_source') as unknown_sources from w""",
)
register(
    "op_k04_gated_table",
    lambda spark, d: rounded(_gated(spark, d)[0]),
    sql_rounded(
        _GATED + """, u as (select identity, max_by(price, ord) as p, max(observed_at) as seen, max_by(nullif(trim(brand), ''), ord) as nb, max_by(nullif(km, 0), ord) as nk from w where outcome = 'updated' group by identity)
select b.source, b.source_id, b.url, coalesce(p, b.price) as price, greatest(last_seen, seen) as last_seen, coalesce(nb, brand) as brand, coalesce(nk, km) as km from b left join u on u.identity = b.source || '-' || b.source_id
union all select source, source_id, url, price, observed_at, brand, km from w where outcome = 'inserted'""",
        "price",
    ),
)
register(
    "op_k04_price_history",
    lambda spark, d: rounded(_gated(spark, d)[1].where("price_change").select("source", "source_id", "price", "observed_at")),
    sql_rounded(_GATED + ", h as (select *, coalesce(lag(price) over (partition by identity, outcome order by ord), old_price) as before from w) select source, source_id, price, observed_at from h where outcome = 'inserted' or outcome = 'updated' and price is distinct from before", "price"),
)
