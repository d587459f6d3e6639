"""Queries of bundles and smaller operators: staged deduplication, per-record status, descriptions, structured pages, reads and trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import buckets
from marlstone.operators import bundles, fields, joins, valuation
from marlstone.plans import rounded, sql_rounded
from marlstone.plans.domain_queries import MED, _med, on_table
from marlstone.plans.market_queries import ROW_ID, on_listings
from marlstone.registry import register
from marlstone.sources.tables import LISTINGS_SQL, listings, table

ID = ", ".join(ROW_ID)
V = F.col

# --- structured pages
_PAGE = lambda: F.concat(F.lit('<html><script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, '), F.to_json(F.struct(F.lit("Vehicle").alias("@type"), F.col("version").alias("name"), F.struct(F.col("price").alias("price"), F.lit("EUR").alias("priceCurrency")).alias("offers"), F.col("year").alias("productionDate"))), F.lit("]}</script><p>"), "version", F.lit("</p></html>"))
on_listings("op_x29_json_ld", lambda df: df.withColumn("html", F.when(V("line") == 7, "<p>none</p>").otherwise(_PAGE())).select(*ROW_ID, bundles.json_ld(V("html")).alias("j")).select(*ROW_ID, "j.*"),
            f" select {ID}, case when line <> 7 then version end as name, case when line <> 7 then price end as offer_price, case when line <> 7 then 'EUR' end as currency, case when line <> 7 then year end as production_year from listings", "offer_price")
register("op_s08_page_records", lambda spark, d: rounded(bundles.page_cards(table(spark, d, "part").groupBy((V("p_partkey") % 50).alias("page")).agg(F.concat_ws("", F.array_sort(F.collect_list(F.concat(F.lit('<div class="card"><h2>'), "p_name", F.lit(' #'), V("p_partkey").cast("string"), F.lit('</h2><p class="price">'), V("p_size").cast("string"), F.lit(".500 €</p></div>"))))).alias("html")), "page", "html")),
         sql_rounded("select p_partkey % 50 as page, p_name || ' #' || p_partkey as title, p_size * 1000 + 500e0 as price from part", "price"))

# --- bundles
_STAGES = [["make", "model", "year", "price", "mileage"], ["make", "model", "location", "price"], ["make", "seller", "version", "year"]]
on_listings("op_n04_staged_dedupe", lambda df: bundles.staged_dedupe(df, _STAGES, ["order_id", "line", "price", "seller", "version", "mileage", "location"]),
    ", s1 as (select *, row_number() over (partition by make, model, year, price, mileage order by order_id, line, price, seller, version, mileage, location) as k1 from listings), s2 as (select *, row_number() over (partition by make, model, location, price order by order_id, line, price, seller, version, mileage, location) as k2 from s1 where k1 = 1), "
    "s3 as (select *, row_number() over (partition by make, seller, version, year order by order_id, line, price, seller, version, mileage, location) as k3 from s2 where k2 = 1) "
    "select 0::int as stage, count(*) as n from listings union all select 1, count(*) from s1 where k1 = 1 union all select 2, count(*) from s2 where k2 = 1 union all select 3, count(*) from s3 where k3 = 1")
on_table("op_n05_description_bundle", "documents", lambda df: df.select("doc_id", bundles.description("text").alias("b")).select("doc_id", F.md5("b.text_cleaned").alias("cleaned"), "b.has_contact", "b.n_words"),
         r"""with d as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<mail>', 'g'), 'https?://[^ \n\t]+', '<url>', 'g'), '(\+351[ ]?)?[29][0-9]{2}[ .-]?[0-9]{3}[ .-]?[0-9]{3}', '<phone>', 'g') as s, text from documents)
select doc_id, md5(lower(trim(regexp_replace(regexp_replace(s, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))) as cleaned, s <> text as has_contact, len(regexp_extract_all(s, '[^ \n\t\r]+'))::bigint as n_words from d""")
on_listings("op_n07_record_status", lambda df: bundles.record_status(df.withColumn("price", F.when(V("line") == 1, 20.0).when(V("line") == 2, None).otherwise(V("price"))), 1997).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n")),
    """, x as (select * replace (case line when 1 then 20e0 when 2 then null else price end as price) from listings), r as (select *, case when coalesce(price, 0) < 50 and year > 1990 then 'price_too_low' when price > 500000 then 'fantasy_price' when year > 1998 then 'invalid_year'
 when 1997 - year >= 2 and mileage > (1997 - year) * 50000 then 'implausible_km' end as reason from x) select case when reason is not null then 'rejected' else 'success' end as status, reason, count(*) as n from r group by all""")
on_listings("op_n11_score_against_median", lambda df: bundles.score_in_range(df, ["make", "model"], "year", "price", "mileage").select(*ROW_ID, "range_mean", "score"),
    f""", g as (select make, model, year, sum(price) as s, count(price) as c from listings group by all), m as (select make, model, year, sum(s) over w / sum(c) over w as range_mean from g window w as (partition by make, model order by year range between 2 preceding and 2 following))
select l.order_id, line, l.make, l.model, price, mileage, location, range_mean, greatest(0e0, least(10e0, 5 + (range_mean - price) * 100 / range_mean * 0.15e0 + case when mileage < 30000 then 1 when mileage < 80000 then 0.3e0 when mileage > 200000 then -2 when mileage > 130000 then -1 else 0 end)) as score
 from listings l join m on l.make = m.make and l.model = m.model and l.year = m.year""", "range_mean score")
on_listings("op_n21_reliability_summary",
    lambda df: _med(df).select(valuation.tier(V("comps")).alias("tier"), valuation.credible_profit(V("price"), V("med"), V("comps")).alias("p"), F.abs((V("med") - V("price")) / V("price")).alias("gap")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(V("gap") > 0.5).alias("gated"), F.count_if((V("p") > 0)).alias("publishable"), F.avg("p").alias("mean_profit")),
    MED + """, t as (select *, case when comps >= 20 then 'dense' when comps >= 8 then 'solid' when comps >= 3 then 'sparse' else 'thin' end as tier, case when comps >= 20 then 1e0 when comps >= 8 then 0.35e0 when comps >= 3 then 0.2e0 else 0.07e0 end as lam from m),
p as (select *, case when abs(med - price) / price > 0.5 then 0e0 else least(price * exp(lam * ln(med / price)) - price, price * 0.2e0) end as p from t)
select tier, count(*) as n, count(*) filter (abs((med - price) / price) > 0.5) as gated, count(*) filter (p > 0) as publishable, avg(p) as mean_profit from p group by tier""", "mean_profit")
on_listings("op_n41_relevance_parts", lambda df: _med(df).select(*ROW_ID, bundles.relevance_parts(valuation.deal_score(V("price"), V("med"), V("mileage")), V("line") * 9, V("price"), V("med")).alias("r")).select(*ROW_ID, "r.*"),
    MED + f""" select {ID}, 0.4e0 * least(greatest(0e0, least(10e0, 5 + (med - price) * 100 / med * 0.15e0 + case when mileage < 30000 then 1 when mileage < 80000 then 0.3e0 when mileage > 200000 then -2 when mileage > 130000 then -1 else 0 end)) / 10, 1e0) as deal,
 0.2e0 * case when line * 9 <= 7 then 1e0 when line * 9 <= 30 then 0.7e0 when line * 9 <= 60 then 0.4e0 else 0.1e0 end as recency,
 0.2e0 * case when (med - price) / med > 0.2 then 1e0 when (med - price) / med > 0.1 then 0.8e0 when (med - price) / med > 0 then 0.6e0 when (med - price) / med > -0.1 then 0.5e0 else 0.3e0 end as position from m""", "deal recency position")

# --- reads and trends
on_listings("op_n44_makes_and_models", lambda df: df.groupBy("make").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models")), " select make, count(*) as n, array_to_string(list_sort(list(distinct model)), ',') as models from listings group by make")
on_listings("op_n44_recent", lambda df: df.where(V("last_seen") >= F.expr("timestamp '1998-08-01' - interval 240 hours")).groupBy(V("last_seen").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("cheapest")),
            " select last_seen::date as day, count(*) as n, min(price) as cheapest from listings where last_seen >= timestamp '1998-08-01' - interval 240 hours group by 1", "cheapest")
on_table("op_n45_trending", "events", lambda df: bundles.trending(df, "user_id", "ts", "2024-01-31", 7, 50).select("user_id", "recent", "before", "growth"),
         "with g as (select user_id, count(*) filter (ts >= date '2024-01-24') as recent, count(*) filter (ts >= date '2024-01-17' and ts < date '2024-01-24') as before from events group by user_id) select user_id, recent, before, recent / greatest(before, 1) as growth from g where recent > 0 order by round(recent / greatest(before, 1), 6) desc, user_id limit 50", "growth")
on_table("op_n46_user_insights", "events", lambda df: bundles.user_insights(df, "user_id", "ts", "event_type", "value"),
         "with c as (select user_id, event_type, count(*) as k from events group by all), t as (select user_id, min_by(event_type, (-k, event_type)) as favourite from c group by user_id) select e.user_id, count(*) as n, count(distinct ts::date) as days, avg(value) as mean_value, any_value(favourite) as favourite from events e join t using (user_id) group by e.user_id", "mean_value")
on_listings("op_n31_year_and_km", lambda df: df.withColumn("x", F.concat(V("year").cast("string"), F.lit(" – "), F.floor("mileage").cast("bigint").cast("string"), F.when(V("line") > 3, " km").otherwise(" KM "))).select(*ROW_ID, bundles.year_and_km(V("x")).alias("r")).select(*ROW_ID, "r.*"),
            f" select {ID}, year as found_year, floor(mileage)::bigint as found_km from listings")

# --- bins, ranks, changes
on_listings("op_b10_deciles", lambda df: buckets.qcut(df.withColumn("k", F.floor(V("mileage") / 40000) * 40000), "k", 10, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")),
            ", x as (select floor(mileage / 40000) * 40000 as k from listings), q as (select quantile_cont(k, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) as e from x), b as (select k, list_position(list_transform(e, lambda z: k <= z), true)::int - 1 as bin from x, q) select bin, count(*) as n, min(k) as lo, max(k) as hi from b group by bin", "lo hi")
_CEILINGS = ((5000, "low"), (20000, "middle"), (50000, "high"))
on_listings("op_b16_ceilings", lambda df: df.groupBy(bundles.ceiling(V("price"), _CEILINGS, "top").alias("bracket")).agg(F.count(F.lit(1)).alias("n")), " select case when price <= 5000 then 'low' when price <= 20000 then 'middle' when price <= 50000 then 'high' else 'top' end as bracket, count(*) as n from listings group by 1")
on_table("op_w16_price_moves", "events", lambda df: df.withColumn("p", F.floor(V("value") / 10)).withColumn("was", F.lag("p").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("p <> was").groupBy("user_id").agg(F.count(F.lit(1)).alias("moves"), F.count_if(V("p") < V("was")).alias("drops")),
         "with x as (select user_id, floor(value / 10) as p, lag(floor(value / 10)) over (partition by user_id order by ts, event_id) as was from events) select user_id, count(*) as moves, count(*) filter (p < was) as drops from x where p <> was group by user_id")
on_listings("op_w17_rank_by_count", lambda df: fields.frequency_index(df, "location").withColumnRenamed("index", "rank"), ', g as (select location, count(*) as n from listings group by location) select location, n, row_number() over (order by n desc, location) as "rank" from g')
register("op_s01_filtered_scan", lambda spark, d: rounded(listings(spark, d).where("status = 'O' and price > 90000").select(*ROW_ID, "status")), sql_rounded(LISTINGS_SQL + f" select {ID}, status from listings where status = 'O' and price > 90000"))
register("op_s02_ordered_scan", lambda spark, d: rounded(table(spark, d, "customer").orderBy(F.when(V("c_acctbal") > 0, V("c_acctbal")).desc_nulls_last(), "c_custkey").limit(100).select("c_custkey", "c_acctbal")), sql_rounded("select c_custkey, c_acctbal from customer order by case when c_acctbal > 0 then c_acctbal end desc nulls last, c_custkey limit 100", "c_acctbal"))
register("op_s06_parquet_read", lambda spark, d: table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("latest")), "select o_orderpriority, count(*) as n, max(o_orderdate) as latest from orders group by o_orderpriority")
on_listings("op_n29_watchlist_union", lambda df: joins.top_per_group(bundles.criteria_union(df, {"cheap": "price < 3000", "fresh": "last_seen >= date '1998-11-01'", "small": "engine_size <= 1 and mileage < 50000"}), ["criterion"], [V("price"), V("order_id"), V("line"), V("seller"), V("version"), V("location"), V("mileage")], 30).select("criterion", *ROW_ID),
            f", u as (select 'cheap' as criterion, * from listings where price < 3000 union all select 'fresh', * from listings where last_seen >= date '1998-11-01' union all select 'small', * from listings where engine_size <= 1 and mileage < 50000), r as (select *, row_number() over (partition by criterion order by price, order_id, line, seller, version, location, mileage) as k from u) select criterion, {ID} from r where k <= 30")
on_listings("op_x04_texts_to_arrays", lambda df: df.withColumn("x", F.concat_ws(" ", F.lit("ano"), V("year").cast("string"), F.floor("price").cast("bigint").cast("string"), F.lit("€ e"), F.floor("mileage").cast("bigint").cast("string"), F.lit("km"))).select(*ROW_ID, bundles.numbers_by_kind(V("x")).alias("n")).select(*ROW_ID, *[F.array_join(f"n.{c}", ",").alias(c) for c in ("years", "prices", "km")]),
            f" select {ID}, concat_ws(',', year, case when floor(price) between 1900 and 2099 then floor(price)::bigint end) as years, floor(price)::bigint::varchar as prices, floor(mileage)::bigint::varchar as km from listings")

_FITTED = lambda df: valuation.with_fitted_lambda(_med(df).where("status <> 'P'"), V("comps"), "price", "med")
_PROFIT = lambda df: df.withColumn("p", valuation.credible_profit(V("price"), V("med"), V("comps"), fitted=V("lam"), retail=V("line") != 6))
on_listings(
    "op_n21_fitted_reliability",
    lambda df: _PROFIT(_FITTED(df)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("priced"), F.count_if(V("p") > 0).alias("publishable"), F.avg("p").alias("mean_profit"), F.max("lam").alias("lam")),
    MED + """, t as (select *, case when comps >= 20 then 'dense' when comps >= 8 then 'solid' when comps >= 3 then 'sparse' else 'thin' end as tier, case when comps >= 20 then 1e0 when comps >= 8 then 0.35e0 when comps >= 3 then 0.2e0 else 0.07e0 end as usual from m where status <> 'P'),
g as (select tier, stddev_pop(ln(med / price)) as sd from t group by tier having count(*) >= 30), l as (select tier, least(1e0, pow(min(sd) over () / sd, 2)) as lam from g),
p as (select t.*, lam, case when line <> 6 then case when abs((med - price) / price) > 0.5 then 0e0 else least(price * exp(coalesce(lam, usual) * ln(med / price)) - price, price * 0.2e0) end end as p from t left join l using (tier))
select tier, count(*) as n, count(p) as priced, count(*) filter (p > 0) as publishable, avg(p) as mean_profit, max(lam) as lam from p group by tier""",
    "mean_profit lam",
)
