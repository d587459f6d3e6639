"""Queries of cleaning, joins, valuation, text, search and event operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import buckets, stats
from marlstone.operators import clean, joins, market, valuation
from marlstone.plans import rounded, sql_rounded
from marlstone.plans.market_queries import ROW_ID, on_listings
from marlstone.registry import register
from marlstone.sources import sinks
from marlstone.sources.tables import LISTINGS_SQL as L
from marlstone.sources.tables import listings, table
from marlstone.streaming import alerts

ID = ", ".join(ROW_ID)
V = F.col


def on_table(name: str, source: str, f, sql: str, doubles: str = "") -> None:
    register(name, lambda spark, d: rounded(f(table(spark, d, source))), sql_rounded(sql, doubles))


# --- filters, projections, top-k
ELIGIBLE = "price between 300 and 500000 and status in ('O', 'F') and fuel_type <> 'N'"
on_listings("op_f01_eligible", lambda df: df.where(ELIGIBLE).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("value")), f"select source, count(*) as n, sum(price) as value from listings where {ELIGIBLE} group by source", "value")
on_listings("op_f02_fresh", lambda df: df.where(V("last_seen") >= F.expr("timestamp '1998-08-01' - interval 48 hours")).select(*ROW_ID, "last_seen"), f"select {ID}, last_seen from listings where last_seen >= timestamp '1998-08-01' - interval 48 hours")
on_listings("op_f03_search", lambda df: df.where(V("make").ilike("%brand#1%") & V("model").ilike("%econ%") & V("price").between(5000, 30000) & (V("mileage") <= 100000) & (V("year") >= 1996)).select(*ROW_ID, "year"),
    f"select {ID}, year from listings where make ilike '%brand#1%' and model ilike '%econ%' and price between 5000 and 30000 and mileage <= 100000 and year >= 1996")
on_listings("op_f05_text_search", lambda df: df.where(V("make").ilike("%23%") | V("model").ilike("%promo%") | V("version").ilike("%tin%")).groupBy("make", "model").agg(F.count(F.lit(1)).alias("n")), "select make, model, count(*) as n from listings where make ilike '%23%' or model ilike '%promo%' or version ilike '%tin%' group by make, model")
on_listings("op_p01_price_transforms", lambda df: buckets.with_scalars(df, F.avg("price").alias("_m"), F.stddev_samp("price").alias("_s"), F.min("price").alias("_lo"), F.max("price").alias("_hi")).select(*ROW_ID, F.log1p("price").alias("price_log"), F.sqrt("price").alias("price_sqrt"), F.ln("price").alias("price_boxcox"), ((V("price") - V("_m")) / V("_s")).alias("price_zscore"), ((V("price") - V("_lo")) / (V("_hi") - V("_lo"))).alias("price_minmax")),
    f", s as (select avg(price) as m, stddev_samp(price) as s, min(price) as lo, max(price) as hi from listings) select {ID}, ln(1 + price) as price_log, sqrt(price) as price_sqrt, ln(price) as price_boxcox, (price - m) / s as price_zscore, (price - lo) / (hi - lo) as price_minmax from listings, s", "price_log price_sqrt price_boxcox price_zscore price_minmax")
on_listings("op_p02_price_indices", lambda df: df.select(*ROW_ID, (V("price") / (V("mileage") + 1)).alias("per_km"), (V("price") / (2002 - V("year"))).alias("per_age"), F.try_divide("price", "engine_size").alias("per_litre"), (V("price") / V("year")).alias("per_year")),
    f"select {ID}, price / (mileage + 1) as per_km, price / (2002 - year) as per_age, price / nullif(engine_size, 0) as per_litre, price / year as per_year from listings", "per_km per_age per_litre per_year")
on_listings("op_p03_inflation", lambda df: df.select(*ROW_ID, (V("price") * F.pow(F.lit(1.03), 2020 - V("year"))).alias("adjusted"), ((F.pow(F.lit(1.03), 2020 - V("year")) - 1) * 100).alias("impact_pct")), f"select {ID}, price * pow(1.03e0, 2020 - year) as adjusted, (pow(1.03e0, 2020 - year) - 1) * 100 as impact_pct from listings", "adjusted impact_pct")
on_listings("op_p04_features", lambda df: df.select(*ROW_ID, (V("mileage") > 150000).alias("is_high_mileage"), (V("mileage") < 50000).alias("is_low_mileage"), (2001 - V("year") <= 2).alias("is_new"), (V("engine_size") < 1.5).alias("is_small_engine"), (V("engine_size") > 2.5).alias("is_large_engine"), F.pow(F.lit(2001) - V("year"), F.lit(2)).cast("int").alias("age_squared")),
    f"select {ID}, mileage > 150000 as is_high_mileage, mileage < 50000 as is_low_mileage, 2001 - year <= 2 as is_new, engine_size < 1.5e0 as is_small_engine, engine_size > 2.5e0 as is_large_engine, pow(2001 - year, 2)::int as age_squared from listings")
on_listings("op_p05_interactions", lambda df: df.select(*ROW_ID, (V("mileage") * V("engine_size")).alias("km_x_engine"), (V("price") / (V("mileage") + 1e-8)).alias("price_div_km"), (V("price") - V("mileage")).alias("price_minus_km")), f"select {ID}, mileage * engine_size as km_x_engine, price / (mileage + 1e-8) as price_div_km, price - mileage as price_minus_km from listings", "km_x_engine price_div_km price_minus_km")
on_listings("op_p06_polynomial", lambda df: df.select(*ROW_ID, (V("engine_size") ** 2).alias("engine_squared"), (V("engine_size") ** 3).alias("engine_cubed"), (V("engine_size") * V("year")).alias("engine_year_product")), f"select {ID}, pow(engine_size, 2) as engine_squared, pow(engine_size, 3) as engine_cubed, engine_size * year as engine_year_product from listings", "engine_squared engine_cubed engine_year_product")
on_listings("op_p07_derived", lambda df: df.select(*ROW_ID, (2001 - V("year")).alias("age"), (V("mileage") / (2002 - V("year"))).alias("km_per_year"), buckets.cut(V("mileage"), buckets.MILEAGE_NAMES).alias("km_class")), f"select {ID}, 2001 - year as age, mileage / (2002 - year) as km_per_year, {buckets.sql_cut('mileage', buckets.MILEAGE_NAMES)} as km_class from listings", "km_per_year")
on_listings("op_t01_page", lambda df: df.orderBy(F.desc("price"), *ROW_ID, "seller").offset(40).limit(20).select(*ROW_ID), f"select {ID} from listings order by price desc, {ID}, seller limit 20 offset 40")
on_listings("op_t02_top_deals", lambda df: df.where(ELIGIBLE).orderBy("price", *ROW_ID, "seller").limit(50).select(*ROW_ID), f"select {ID} from listings where {ELIGIBLE} order by price, {ID}, seller limit 50")
on_listings("op_t08_top_per_group", lambda df: joins.top_per_group(df, ["make", "location"], [F.desc("price"), *map(F.asc, ["order_id", "line", "model", "mileage", "seller", "version"])], 3).select(*ROW_ID, "rank"),
    f"select {ID}, rank from (select *, row_number() over (partition by make, location order by price desc, order_id, line, model, mileage, seller, version)::int as rank from listings) where rank <= 3")

# --- joins, sinks, deduplication
on_listings("op_j04_year_range_mean", lambda df: joins.year_range_mean(df, ["make", "model"], "year", "price"), ", g as (select make, model, year, sum(price) as s, count(price) as c from listings group by all) select make, model, year, sum(s) over w / sum(c) over w as range_mean, (sum(c) over w)::bigint as range_n from g window w as (partition by make, model order by year range between 2 preceding and 2 following)", "range_mean")
WATCH_SQL = "select c_custkey as id, case when c_custkey % 3 > 0 then 'Brand#' || (c_custkey % 25 + 1) end as make, case when c_custkey % 2 = 0 then 1994 + c_custkey % 6 end as min_year, case when c_custkey % 5 > 0 then 2000e0 + c_custkey % 7 * 1000 end as max_price from customer where c_mktsegment = 'BUILDING'"
register("op_j05_watchlist_matches", lambda spark, d: joins.watchlist_top(listings(spark, d).where("mileage > 190000"), _watch(table(spark, d, "customer")).where("make is not null"), "id", {"make": "make"}, {"min_year": "year"}, ("max_price", "price"), [V("order_id"), V("line"), V("seller"), V("version"), V("location")], 25).select("w_id", "order_id", "line", "price"),
    L + f", w as ({WATCH_SQL}), r as (select w.id as w_id, order_id, line, price, row_number() over (partition by w.id order by price, order_id, line, seller, version, location) as k from listings l join w on l.make = w.make and (w.min_year is null or l.year >= w.min_year) and (w.max_price is null or l.price <= w.max_price) where mileage > 190000) select w_id, order_id, line, price from r where k <= 25")
register("op_j05_watchlist", lambda spark, d: joins.watchlist_counts(listings(spark, d), _watch(table(spark, d, "customer")), "id", {"make": "make"}, {"min_year": "year"}, ("max_price", "price")),
    L + f", w as ({WATCH_SQL}) select w.id as w_id, count(*) as n, min(price) as best from listings l join w on (w.make is null or l.make = w.make) and (w.min_year is null or l.year >= w.min_year) and (w.max_price is null or l.price <= w.max_price) group by w.id")


def _watch(customer):
    k = V("c_custkey")
    return customer.where("c_mktsegment = 'BUILDING'").select(k.alias("id"), F.when(k % 3 > 0, F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"))).alias("make"), F.when(k % 2 == 0, 1994 + k % 6).alias("min_year"), F.when(k % 5 > 0, 2000.0 + k % 7 * 1000).alias("max_price"))


on_listings("op_j06_reference_deviation", lambda df: joins.reference_deviation(df, ["make", "model"], "price", limit=0.9).select(*ROW_ID, "reference", "deviation"), f", g as (select make, model, avg(price) as reference from listings group by make, model having count(price) >= 5) select l.order_id, line, l.make, l.model, price, mileage, location, reference, abs(price - reference) / reference as deviation from listings l join g on l.make = g.make and l.model = g.model where abs(price - reference) / reference > 0.9", "reference deviation")
on_listings("op_j07_near_pairs", lambda df: joins.near_pairs(df.withColumn("rid", F.concat_ws("-", "order_id", "line", "seller", V("price").cast("decimal(18,2)"))), ["make", "model", "location", "year"], "rid", "price", "date_scraped", 0.1, 7).groupBy("make", "model").agg(F.count(F.lit(1)).alias("pairs")),
    ", x as (select *, concat_ws('-', order_id, line, seller, price::decimal(18,2)) as rid from listings) select a.make, a.model, count(*) as pairs from x a join x b on a.make = b.make and a.model = b.model and a.location = b.location and a.year = b.year and a.rid < b.rid and abs(a.price - b.price) < 0.1e0 * greatest(a.price, b.price) and abs(epoch(a.date_scraped) - epoch(b.date_scraped)) <= 604800 group by a.make, a.model")
on_listings("op_j09_factor_levels", lambda df: joins.factor_levels(df.where("status = 'O'"), df.where("status = 'F'").withColumn("price", V("price") * 0.8), [["make", "model"], ["make"], []], "price", 400),
    ", a as (select * from listings where status = 'O'), s as (select * replace (price * 0.8e0 as price) from listings where status = 'F'), f0 as (select make, model, b.m / c.m as f from (select make, model, median(price) as m, count(*) as n from s group by all) b join (select make, model, median(price) as m, count(*) as n from a group by all) c using (make, model) where b.n >= 400 and c.n >= 400), "
    "f1 as (select make, b.m / c.m as f from (select make, median(price) as m, count(*) as n from s group by all) b join (select make, median(price) as m, count(*) as n from a group by all) c using (make) where b.n >= 400 and c.n >= 400), f2 as (select (select median(price) from s) / (select median(price) from a) as f where (select count(*) from s) >= 400 and (select count(*) from a) >= 400) "
    "select make, model, greatest(0.55e0, least(0.95e0, coalesce(f0.f, f1.f, (select f from f2)))) as factor from (select distinct make, model from a) left join f0 using (make, model) left join f1 using (make)", "factor")
register("op_j10_anti_join", lambda spark, d: table(spark, d, "customer").join(table(spark, d, "orders"), V("c_custkey") == V("o_custkey"), "left_anti").select("c_custkey", "c_name"), "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
register("op_j11_semi_join", lambda spark, d: table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000"), V("c_custkey") == V("o_custkey"), "left_semi").select("c_custkey", "c_name"), "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
register("op_k03_upsert", lambda spark, d: sinks.upsert(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), table(spark, d, "part").where("p_size > 40").select((V("p_partkey") + 50).alias("p_partkey"), F.upper("p_name").alias("p_name"), "p_size"), ["p_partkey"], [F.desc("p_size")]),
    "with d as (select p_partkey + 50 as p_partkey, upper(p_name) as p_name, p_size from part where p_size > 40) select p.p_partkey, p.p_name, p.p_size, 'kept' as action from part p where p_partkey not in (select p_partkey from d) union all select d.p_partkey, d.p_name, d.p_size, case when p.p_partkey is null then 'inserted' else 'updated' end from d left join part p using (p_partkey)")
on_table("op_k05_price_changes", "events", lambda df: sinks.price_changes(df.withColumn("price", F.floor(V("value") / 20).cast("long")), "user_id", "ts", "price", "event_id").select("event_id", "user_id", "price", "previous_price"),
    "with e as (select *, floor(value / 20)::bigint as price from events), l as (select *, lag(price) over (partition by user_id order by ts, event_id) as previous_price from e) select event_id, user_id, price, previous_price from l where price is distinct from previous_price")
on_table("op_k07_retention", "events", lambda df: df.where(V("ts") >= F.expr("timestamp '2024-01-31' - interval 7 days")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "select event_type, count(*) as n from events where ts >= timestamp '2024-01-31' - interval 7 days group by event_type")
KEYS = ["make", "model", "year", "location", "fuel_type"]
on_listings("op_d03_keep_first", lambda df: clean.keep_first(df, KEYS, [F.asc(c) for c in ("price", "order_id", "line", "mileage", "seller", "version")]).select(*ROW_ID, "year", "fuel_type"), f"select {ID}, year, fuel_type from (select *, row_number() over (partition by make, model, year, location, fuel_type order by price, order_id, line, mileage, seller, version) as n from listings) where n = 1")
on_listings("op_d04_exact_duplicates", lambda df: clean.flag_exact_duplicates(df, ["make", "model", "year", "mileage", "location"]).groupBy("make").agg(F.count_if("is_duplicate").alias("n_duplicates"), F.count(F.lit(1)).alias("n")), ", x as (select *, count(*) over (partition by make, model, year, mileage, location) > 1 as dup from listings) select make, count(*) filter (dup) as n_duplicates, count(*) as n from x group by make")
on_listings("op_d05_content_hash", lambda df: df.select("order_id", "line", "seller", clean.content_hash("make", "model", "version", "year").alias("hash")), ", x as (select * from listings) select order_id, line, seller, md5(make || '|' || model || '|' || version || '|' || year) as hash from x")
on_listings("op_d06_price_duplicates", lambda df: clean.price_duplicates(df, KEYS, "price").groupBy("make").agg(F.count_if("is_price_duplicate").alias("n")), ", x as (select make, count(*) over w >= 2 and abs(price - avg(price) over w) / avg(price) over w <= 0.05e0 as dup from listings window w as (partition by make, model, year, location, fuel_type)) select make, count(*) filter (dup) as n from x group by make")
on_table("op_d02_distinct_pairs", "part", lambda df: df.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")), "select p_brand, p_type, count(*) as n from part group by all")
on_table("op_d05_document_copies", "documents", lambda df: df.groupBy(F.md5("text").alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1"), "select md5(text) as hash, count(*) as copies, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")

# --- cleaning
on_listings("op_c12_iqr", lambda df: clean.iqr_flags(df, "price", 0.2).groupBy("make").agg(F.count_if("iqr_outlier").alias("n")), ", q as (select quantile_cont(price, 0.25) as a, quantile_cont(price, 0.75) as b from listings) select make, count(*) filter (price < a - 0.2e0 * (b - a) or price > b + 0.2e0 * (b - a)) as n from listings, q group by make")
on_listings("op_c13_z_flags", lambda df: clean.z_flags(df, "price", 1.5).groupBy("make").agg(F.count_if("z_outlier").alias("n")), ", s as (select avg(price) as m, stddev_samp(price) as s from listings) select make, count(*) filter (abs((price - m) / s) > 1.5e0) as n from listings, s group by make")
on_listings("op_c13_mad_flags", lambda df: clean.mad_flags(df, "price", 1.0).groupBy("make").agg(F.count_if("mad_outlier").alias("n")), ", m as (select median(price) as m from listings), d as (select make, abs(price - m) as d from listings, m), k as (select median(d) as mad from d) select make, count(*) filter (0.6745e0 * d / (mad + 1e-8) > 1) as n from d, k group by make")
on_listings("op_c14_consistency", lambda df: clean.consistency(df, 1999).select("order_id", "line", "seller", "version", "year", "mileage", "price"), "select order_id, line, seller, version, case when 1999 - year < 0 then 1999 else year end as year, case when 1999 - year > 0 and mileage > 30000 * (1999 - year) then 30000e0 * (1999 - year) else mileage end as mileage, price from listings")
on_listings("op_c15_label_encode", lambda df: clean.label_encode(df, "make").select("make", "make_code").distinct(), "select make, (row_number() over (order by make) - 1)::int as make_code from (select distinct make from listings)")
on_listings("op_c16_scale", lambda df: clean.scale(df, "price").select(*ROW_ID, "standard", "minmax", "robust"), f", s as (select avg(price) as m, stddev_samp(price) as s, min(price) as lo, max(price) as hi, quantile_cont(price, 0.25) as a, median(price) as b, quantile_cont(price, 0.75) as c from listings) select {ID}, (price - m) / (s + 1e-8) as standard, (price - lo) / (hi - lo) as minmax, (price - b) / (c - a) as robust from listings, s", "standard minmax robust")
on_listings("op_c17_target_encode", lambda df: clean.target_encode(df, "version", "price"), "select version, (sum(price) + sum(sum(price)) over () / sum(count(price)) over () * 20) / (count(price) + 20) as encoded, count(price) as n from listings group by version", "encoded")
on_listings("op_c11_impute", lambda df: clean.impute(df.withColumn("mileage", F.when(V("line") > 2, V("mileage"))), ["mileage"]).groupBy("make").agg(F.sum("mileage").alias("total")), ", m as (select median(mileage) as m from listings where line > 2) select make, sum(case when line > 2 then mileage else m end) as total from listings, m group by make", "total")
on_table("op_x02_text_clean", "documents", lambda df: df.select("doc_id", F.md5(clean.text_clean(V("text"))).alias("hash")), r"select doc_id, md5(lower(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))) as hash from documents")
on_table("op_x03_strip_contacts", "documents", lambda df: df.select("doc_id", F.md5(clean.strip_contacts(V("text"))).alias("hash")), r"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<mail>', 'g'), 'https?://[^ \n\t]+', '<url>', 'g'), '(\+351[ ]?)?[29][0-9]{2}[ .-]?[0-9]{3}[ .-]?[0-9]{3}', '<phone>', 'g')) as hash from documents")
on_table("op_x04_numbers", "documents", lambda df: df.select("doc_id", F.size(clean.numbers_in(V("text"))).cast("long").alias("n"), F.array_max(clean.numbers_in(V("text"))).alias("largest")), "select doc_id, len(regexp_extract_all(text, '[0-9]+'))::bigint as n, list_max(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: try_cast(x as bigint))) as largest from documents")
on_table("op_p08_text_features", "documents", lambda df: df.select("doc_id", *clean.text_features(V("text"))), r"select doc_id, length(text)::bigint as length, len(regexp_extract_all(text, '[^ \n\t\r]+'))::bigint as words, len(regexp_extract_all(text, '[0-9]'))::bigint as digits, len(regexp_extract_all(text, '[A-Z]')) / nullif(length(text), 0) as upper_ratio from documents", "upper_ratio")
on_table("op_x16_hashes", "documents", lambda df: df.select("doc_id", F.md5("text").alias("md5"), F.sha1(V("text")).substr(1, 16).alias("sha1_16")), "select doc_id, md5(text) as md5, substr(sha1(text), 1, 16) as sha1_16 from documents")
on_table("op_x14_source_host", "pages", lambda df: df.select("page_id", F.regexp_extract("url", "^[a-z]+://(?:www\\.|m\\.|blog\\.)?([^/?#]+)", 1).alias("source")), "select page_id, regexp_extract(url, '^[a-z]+://(?:www\\.|m\\.|blog\\.)?([^/?#]+)', 1) as source from pages")

# --- valuation
on_listings("op_v01_market_median", lambda df: valuation.market_median(df, ["make", "model", "year"], "price"),
    ", a as (select make, model, year, list(price order by price) as p, count(*) as n from listings where price > 0 group by all), q as (select *, greatest(1, least(n - 1, (n + 1) // 4)) as j1, greatest(1, least(n - 1, (n + 1) * 3 // 4)) as j3 from a), "
    "e as (select *, (p[j1] * (4 - ((n + 1) - j1 * 4)) + p[j1 + 1] * ((n + 1) - j1 * 4)) / 4 as q1, (p[j3] * (4 - ((n + 1) * 3 - j3 * 4)) + p[j3 + 1] * ((n + 1) * 3 - j3 * 4)) / 4 as q3 from q), "
    "k as (select *, list_filter(p, lambda x: x >= q1 - (q3 - q1) * 1.5e0 and x <= q3 + (q3 - q1) * 1.5e0) as kept from e) select make, model, year, n::bigint as n, case when n >= 3 then coalesce(list_median(kept), list_median(p)) end as market_median from k", "market_median")
MED = ", m as (select *, avg(price) over (partition by make, model) as med, count(*) over (partition by make, model, year, location) as comps from listings)"


def _med(df):
    return valuation.with_market(df, ["make", "model"], ["year", "location"], "price", "med", "comps")


on_listings("op_v02_deal_score", lambda df: _med(df).select(*ROW_ID, valuation.deal_score(V("price"), V("med"), V("mileage")).alias("score")),
    MED + f" select {ID}, greatest(0e0, least(10e0, 5 + (med - price) * 100 / med * 0.15e0 + case when mileage < 30000 then 1 when mileage < 80000 then 0.3e0 when mileage > 200000 then -2 when mileage > 130000 then -1 else 0 end)) as score from m", "score")
on_listings("op_x23_price_delta", lambda df: _med(df).select(*ROW_ID, valuation.price_delta(V("price"), V("med")).alias("d")).select(*ROW_ID, "d.ok", "d.discount_eur", "d.discount_pct", "d.above_market_pct"),
    MED + f", o as (select *, price between 300 and 2e6 and med > 0 and med <= 2e6 and price / med between 0.2e0 and 3 as ok from m) select {ID}, ok, case when ok then med - price end as discount_eur, case when ok then (med - price) / med * 100 end as discount_pct, case when ok then greatest(0e0, (price - med) / med * 100) end as above_market_pct from o", "discount_eur discount_pct above_market_pct")
on_listings("op_x24_step_round", lambda df: df.select(*ROW_ID, valuation.step_round(V("price")).alias("rounded_price")), f"select {ID}, round_even(price / case when price < 20000 then 100 when price < 60000 then 500 else 1000 end, 0) * case when price < 20000 then 100 when price < 60000 then 500 else 1000 end as rounded_price from listings", "rounded_price")
LAM = "case when comps >= 20 then 1e0 when comps >= 8 then 0.35e0 when comps >= 3 then 0.2e0 else 0.07e0 end"
on_listings("op_x25_shrinkage", lambda df: _med(df).select(*ROW_ID, valuation.shrink(V("price"), V("med"), V("comps")).alias("shrunk"), valuation.tier(V("comps")).alias("tier")), MED + f" select {ID}, price * exp({LAM} * ln(med / price)) as shrunk, case when comps >= 20 then 'dense' when comps >= 8 then 'solid' when comps >= 3 then 'sparse' else 'thin' end as tier from m", "shrunk")
on_listings("op_v20_credible_profit", lambda df: _med(df).select(*ROW_ID, valuation.credible_profit(V("price"), V("med"), V("comps")).alias("profit")), MED + f" select {ID}, case when abs((med - price) / price) > 0.5e0 then 0e0 else least(price * exp({LAM} * ln(med / price)) - price, price * 0.2e0) end as profit from m", "profit")
on_listings("op_v21_lambda_fit", lambda df: valuation.lambda_fit(_med(df).withColumn("tier", valuation.tier(V("comps"))), "tier", "price", "med"), MED + ", g as (select case when comps >= 20 then 'dense' when comps >= 8 then 'solid' when comps >= 3 then 'sparse' else 'thin' end as tier, count(*) as n, stddev_pop(ln(med / price)) as sd from m group by 1 having count(*) >= 30) select *, least(1e0, pow(min(sd) over () / sd, 2)) as lam from g", "sd lam")
on_listings("op_v22_opportunity", lambda df: _med(df).groupBy(valuation.opportunity(V("price"), V("med") * 0.8, V("med") * 1.2, V("med"), F.lit(0.6), V("comps")).alias("label")).agg(F.count(F.lit(1)).alias("n")),
    MED + ", b as (select *, (med * 0.8e0 - price) / (med * 0.8e0) as below, (price - med * 1.2e0) / (med * 1.2e0) as above from m) select case when price <= 0 or comps <= 0 then 'insufficient' when below > 0.3e0 then 'review' when below > 0.12e0 and comps >= 6 then 'excellent' when below > 0 then 'good' when above > 0.1e0 then 'well_above' when above > 0 then 'above' else 'within' end as label, count(*) as n from b group by 1")
on_listings("op_v11_hierarchy", lambda df: valuation.hierarchy(df, [["make", "model", "year", "location"], ["make", "model", "year"], ["make", "model"]], "price", 5).groupBy("estimate.level").agg(F.count(F.lit(1)).alias("n"), F.avg("estimate.value").alias("mean_value")),
    ", x as (select price, count(price) over a as n0, median(price) over a as v0, count(price) over b as n1, median(price) over b as v1, count(price) over c as n2, median(price) over c as v2 from listings window a as (partition by make, model, year, location), b as (partition by make, model, year), c as (partition by make, model)) "
    "select case when n0 >= 5 then 0 when n1 >= 5 then 1 when n2 >= 5 then 2 end as level, count(*) as n, avg(case when n0 >= 5 then v0 when n1 >= 5 then v1 when n2 >= 5 then v2 end) as mean_value from x group by 1", "mean_value")
on_listings("op_v09_km_elasticity", lambda df: valuation.km_elasticity(df, ["make", "model"]), "select make, model, count(*) as n, regr_slope(ln(price), ln(mileage)) as slope, case when count(*) >= 5 then greatest(-0.45e0, least(-0.05e0, regr_slope(ln(price), ln(mileage)))) end as elasticity from listings where price > 0 and mileage > 0 group by make, model", "slope elasticity")
on_listings("op_v08_weighted_median", lambda df: valuation.weighted_median(df, ["make"], "price", 51 - V("mileage") / 4000), ", g as (select make, price, sum(51 - mileage / 4000) as w from listings group by make, price), c as (select *, sum(w) over (partition by make order by price) as c, sum(w) over (partition by make) as t from g) select make, min(price) as weighted_median from c where c >= t * 0.5e0 group by make")
on_listings(
    "op_v30_conformal",
    lambda df: valuation.conformal_factor(_med(df).withColumns({"lo": V("med") * 0.7, "hi": V("med") * 1.3}), ["make", "year"], "price", "lo", "hi", "med"),
    MED + """, x as (select make, year, greatest(ln(price / (med * 1.3e0)), ln(med * 0.7e0 / price)) as miss, price between med * 0.7e0 and med * 1.3e0 as hit from m),
r as (select *, row_number() over (partition by make, year order by miss) - 1 as i, count(*) over (partition by make, year) as n, row_number() over (order by miss) - 1 as gi, count(*) over () as gn from x),
p as (select *, least(0.8e0 * (1 + 1e0 / n), 1e0) * (n - 1) as pl, least(0.8e0 * (1 + 1e0 / gn), 1e0) * (gn - 1) as gpl from r),
g as (select max(case when gi = floor(gpl) then miss end) as lo, max(case when gi = ceil(gpl) then miss end) as hi, max(gpl - floor(gpl)) as part from p),
b as (select make, year, any_value(n) as n, max(case when i = floor(pl) then miss end) as lo, max(case when i = ceil(pl) then miss end) as hi, max(pl - floor(pl)) as part, avg(hit::int) * 100 as coverage_pct from p group by make, year)
select make, year, n, case when n >= 30 then exp(greatest(b.lo + (b.hi - b.lo) * b.part, 0)) else exp(greatest(g.lo + (g.hi - g.lo) * g.part, 0)) end as factor, coverage_pct from b, g""",
    "factor coverage_pct",
)
on_listings("op_m06_regression_metrics", lambda df: _med(df).agg(F.avg(F.pow(V("price") - V("med"), F.lit(2))).alias("mse"), F.avg(F.abs(V("price") - V("med"))).alias("mae"), (1 - F.sum(F.pow(V("price") - V("med"), F.lit(2))) / (F.var_pop("price") * F.count("price"))).alias("r2"), (F.avg(F.abs(V("price") - V("med")) / V("price")) * 100).alias("mape"), F.corr("price", "med").alias("corr")),
    MED + " select avg(pow(price - med, 2)) as mse, avg(abs(price - med)) as mae, 1 - sum(pow(price - med, 2)) / (var_pop(price) * count(price)) as r2, avg(abs(price - med) / price) * 100 as mape, corr(price, med) as corr from m", "mse mae r2 mape corr")
register("op_m07_confusion", lambda spark, d: table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("quality", (V("n_chars") > 400).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n")), "select quality, (n_chars > 400)::int as predicted, count(*) as n from labels join documents using (doc_id) group by all")

# --- quality
on_listings("op_q01_rule_counts", lambda df: df.agg(F.count_if(V("price") > 90000).alias("price_high"), F.count_if(V("mileage") > 190000).alias("km_high"), F.count_if(~V("fuel_type").isin("A", "R")).alias("fuel_other"), F.count_if(F.length("version") > 30).alias("long_version")),
    "select count(*) filter (price > 90000) as price_high, count(*) filter (mileage > 190000) as km_high, count(*) filter (fuel_type not in ('A', 'R')) as fuel_other, count(*) filter (length(version) > 30) as long_version from listings")
on_listings("op_q03_duplicate_counts", lambda df: df.agg((F.count(F.lit(1)) - F.countDistinct("make", "model", "year", "mileage")).alias("repeats")), "select count(*) - count(distinct (make, model, year, mileage)) as repeats from listings")
on_listings("op_q07_quality_status", lambda df: df.withColumn("reasons", F.filter(F.array(F.when(V("price") < 2000, "low_price"), F.when(V("mileage") > 80000 * (2002 - V("year")), "km_age"), F.when(V("engine_size") > 4.8, "engine")), lambda r: r.isNotNull())).groupBy(F.array_join("reasons", ",").alias("reasons"), F.when(F.array_contains("reasons", "low_price"), "invalid").when(F.size("reasons") > 0, "valid_with_warning").otherwise("valid").alias("status")).agg(F.count(F.lit(1)).alias("n")),
    ", r as (select concat_ws(',', case when price < 2000 then 'low_price' end, case when mileage > 80000 * (2002 - year) then 'km_age' end, case when engine_size > 4.8e0 then 'engine' end) as reasons from listings) select reasons, case when reasons like 'low_price%' then 'invalid' when reasons <> '' then 'valid_with_warning' else 'valid' end as status, count(*) as n from r group by all")
on_listings("op_a37_price_integrity", lambda df: df.groupBy(F.when(V("price") < 1000, "token").when(V("price") > 100000, "huge").otherwise("ok").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("value")), "select case when price < 1000 then 'token' when price > 100000 then 'huge' else 'ok' end as category, count(*) as n, sum(price) as value from listings group by 1", "value")

# --- events, alerts, search log
on_table("op_r05_hourly_volume", "events", lambda df: alerts.window_counts(df, "ts", "event_type"), "select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as \"end\", event_type, count(*) as n, sum(value) as total from events group by all", "total")
on_table("op_r04_alert_windows", "events", lambda df: alerts.window_counts(df, "ts", "event_type", "10 minutes").groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.max("n").alias("busiest")), "with g as (select time_bucket(interval 10 minutes, ts) as w, event_type, count(*) as n from events group by all) select event_type, count(*) as windows, max(n) as busiest from g group by event_type")
on_table("op_r02_throttle", "events", lambda df: alerts.throttle(df.select("event_id", "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", ["event_id"], 86400).select("event_id", "user_id", "event_type"),
    "with recursive o as (select event_id, user_id, event_type, epoch(date_trunc('second', ts))::bigint as s, row_number() over (partition by user_id, event_type order by ts, event_id) as i from events), "
    "g as (select event_id, user_id, event_type, i, s, s as last, true as pass from o where i = 1 union all select o.event_id, o.user_id, o.event_type, o.i, o.s, case when o.s - g.last >= 86400 then o.s else g.last end, o.s - g.last >= 86400 from g join o on o.user_id = g.user_id and o.event_type = g.event_type and o.i = g.i + 1) select event_id, user_id, event_type from g where pass")
on_table("op_r03_ttl_dedupe", "events", lambda df: alerts.ttl_first(df, ["user_id", "event_type"], "ts", ["event_id"], 86400).groupBy("event_type").agg(F.count_if("is_new").alias("n_new"), F.count(F.lit(1)).alias("n")), "with x as (select event_type, epoch(date_trunc('second', ts))::bigint - lag(epoch(date_trunc('second', ts))::bigint) over (partition by user_id, event_type order by ts, event_id) as gap from events) select event_type, count(*) filter (gap is null or gap > 86400) as n_new, count(*) as n from x group by event_type")
on_table("op_r06_failure_runs", "events", lambda df: alerts.failure_runs(df.withColumn("failed", V("value") > 60), "user_id", "ts", "failed", ["event_id"], 3), "with x as (select *, sum(case when value > 60 then 0 else 1 end) over (partition by user_id order by ts, event_id) as island from events) select user_id, count(*) as failures, min(ts) as first_ts, max(ts) as last_ts from x where value > 60 group by user_id, island having count(*) >= 3")
on_table("op_x21_freshness", "events", lambda df: alerts.freshness(df, "ts", "2024-01-25 00:00:00", 48, 240).groupBy("freshness").agg(F.count(F.lit(1)).alias("n")), "with a as (select (epoch(timestamp '2024-01-25') - floor(epoch(ts))) / 3600 as age from events) select case when age is null then 'NOT_MEASURED' when age < 0 then 'FUTURE' when age <= 48 then 'FRESH' when age <= 240 then 'STALE' else 'HISTORICAL' end as freshness, count(*) as n from a group by 1")
on_table("op_r07_sessions", "events", lambda df: alerts.sessions(df, "user_id", "ts").select("user_id", "start", "n", "total"), "with x as (select *, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as cut from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(cut) over (partition by user_id order by ts, event_id) as k from x) select user_id, min(ts) as start, count(*) as n, sum(value) as total from s group by user_id, k", "total")
on_table("op_a40_popular_queries", "conversations", lambda df: df.where("role = 'user'").groupBy(F.lower(F.substring_index("text", " ", 2)).alias("query")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("avg_length")).orderBy(F.desc("n"), "query").limit(20), "select lower(array_to_string(string_split(text, ' ')[1:2], ' ')) as query, count(*) as n, avg(length(text)) as avg_length from conversations where role = 'user' group by 1 order by n desc, query limit 20", "avg_length")
on_table("op_n28_success_rate", "events", lambda df: df.groupBy("event_type").agg((F.avg((V("value") > 10).cast("double")) * 100).alias("success_pct"), F.max("ts").alias("latest")), "select event_type, avg(case when value > 10 then 1e0 else 0e0 end) * 100 as success_pct, max(ts) as latest from events group by event_type", "success_pct")
on_table("op_n43_queue_stats", "orders", lambda df: df.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("oldest")), "select o_orderstatus, o_orderpriority, count(*) as n, min(o_orderdate) as oldest from orders group by all")
on_listings("op_n20_purge", lambda df: df.agg(F.count_if((V("price") > 100000) & (V("mileage") > 150000)).alias("n"), F.sum(F.when((V("price") > 100000) & (V("mileage") > 150000), V("price"))).alias("removed")), "select count(*) filter (price > 100000 and mileage > 150000) as n, sum(price) filter (price > 100000 and mileage > 150000) as removed from listings", "removed")
on_listings("op_n33_threshold_sweep", lambda df: df.select((V("price") > 50000).alias("y"), (V("engine_size") / 5).alias("p")).crossJoin(F.broadcast(df.sparkSession.range(18).select((10 + V("id") * 5).alias("cut")))).groupBy("cut").agg(F.count_if(V("y") & (V("p") * 100 >= V("cut"))).alias("tp"), F.count_if(~V("y") & (V("p") * 100 >= V("cut"))).alias("fp"), F.count_if(V("y") & (V("p") * 100 < V("cut"))).alias("fn")).withColumn("f1", F.try_divide(2.0 * V("tp"), 2 * V("tp") + V("fp") + V("fn"))),
    ", t as (select 10 + i * 5 as cut from range(18) r(i)), g as (select cut, count(*) filter (price > 50000 and engine_size / 5 * 100 >= cut) as tp, count(*) filter (price <= 50000 and engine_size / 5 * 100 >= cut) as fp, count(*) filter (price > 50000 and engine_size / 5 * 100 < cut) as fn from listings, t group by cut) select *, 2e0 * tp / (2 * tp + fp + fn) as f1 from g", "f1")
