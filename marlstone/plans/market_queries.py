"""Queries of the grouped, bucketed and windowed operators over the listings view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import buckets, stats
from marlstone.operators import market, series
from marlstone.plans import rounded, sql_rounded
from marlstone.registry import register
from marlstone.sources.tables import LISTINGS_SQL as L
from marlstone.sources.tables import listings, table

ROW = "order_id, line, make, model, version, price, mileage, location, seller, date_scraped, last_seen"
ROW_ID = ["order_id", "line", "make", "model", "price", "mileage", "location"]


def on_listings(name: str, f, sql: str, doubles: str = "", orders: bool = True) -> None:
    """``f`` maps the listings view (without ``orders``: less the columns that orders have) to the result; ``sql`` follows the WITH head."""
    register(name, lambda spark, d: rounded(f(listings(spark, d, orders))), sql_rounded(L + sql, doubles))


STATS = "avg({0}) as mean, stddev_samp({0}) as std, min({0}) as min, quantile_cont({0}, 0.25) as q25, median({0}) as median, quantile_cont({0}, 0.75) as q75, max({0}) as max"
P = STATS.format("price")

on_listings("op_a07_competition", lambda df: market.competition(df, ["make", "model"], "price"),
    "select make, model, avg(price) as mean_price, median(price) as median_price, count(*) as n, 1e2 * count(*) / sum(count(*)) over () as market_share, "
    "1e2 * avg(price) / (sum(sum(price)) over () / sum(count(*)) over ()) as price_competitiveness, row_number() over (order by count(*) desc, make, model)::int as share_rank from listings group by make, model",
    "mean_price median_price market_share price_competitiveness")
on_listings("op_a01_group_aggregate", lambda df: market.group_aggregate(df, ["make", "model", "year", "fuel_type", "transmission"], {"price": ["mean", "median", "min", "max", "count"], "mileage": ["mean", "median"], "engine_size": ["mean", "median"]}),
    "select make, model, year, fuel_type, transmission, avg(price) as price_mean, median(price) as price_median, min(price) as price_min, max(price) as price_max, count(price) as price_count, avg(mileage) as mileage_mean, "
    "median(mileage) as mileage_median, avg(engine_size) as engine_size_mean, median(engine_size) as engine_size_median from listings group by all",
    "price_mean price_median mileage_mean mileage_median engine_size_mean engine_size_median")
on_listings("op_a02_basic_stats", lambda df: market.basic_stats(df, "price"),
    "select count(*) as rows, avg(price) as mean, median(price) as median, stddev_samp(price) as std, min(price) as min, max(price) as max, quantile_cont(price, 0.25) as q25, quantile_cont(price, 0.75) as q75, "
    "quantile_cont(price, 0.75) - quantile_cont(price, 0.25) as iqr, skewness(price) as skew, kurtosis(price) as kurtosis from listings", "mean median std q25 q75 iqr skew kurtosis")
on_listings("op_a03_describe_by", lambda df: market.describe_by(df, ["make"], "price"), f"select make, count(price) as n, {P} from listings group by make", "mean std q25 median q75")
on_listings("op_a04_percentiles", lambda df: market.percentiles(df, "price"), "select " + ", ".join(f"quantile_cont(price, {p / 100}) as p{p}" for p in (10, 25, 50, 75, 90, 95, 99)) + " from listings", "p10 p25 p50 p75 p90 p95 p99")
on_listings("op_a05_price_ranges", lambda df: market.price_ranges(df, "price"), "select min(price) as budget_from, quantile_cont(price, 0.33) as mid_from, quantile_cont(price, 0.66) as premium_from, max(price) as top from listings", "mid_from premium_from")
on_listings("op_a06_location_stats", lambda df: market.location_stats(df, "location", "price"),
    "select location, avg(price) as mean_price, median(price) as median_price, count(price) as n, row_number() over (order by avg(price) desc, location)::int as price_rank from listings group by location", "mean_price median_price")
on_listings("op_a08_concentration", lambda df: market.concentration(df, "make"),
    ", g as (select make, 1e2 * count(*) / sum(count(*)) over () as share, row_number() over (order by count(*) desc, make) as r from listings group by make) "
    "select sum(share * share) as hhi, sum(case when r <= 4 then share end) as cr4, max(share) as top_share, case when sum(share * share) < 1000 then 'Low' when sum(share * share) < 1800 then 'Medium' else 'High' end as concentration from g", "hhi cr4 top_share")
on_listings("op_a09_segment_share", lambda df: market.segment_share(df, "make", "price"),
    ", e as (select quantile_cont(price, 0.33) as a, quantile_cont(price, 0.66) as b from listings), s as (select make, case when price <= a then 'Budget' when price <= b then 'Mid' else 'Premium' end as segment from listings, e) "
    "select m.make, g.segment, count(s.make) as n, 1e2 * count(s.make) / sum(count(s.make)) over (partition by m.make) as share from (select distinct make from listings) m cross join (values ('Budget'), ('Mid'), ('Premium')) g(segment) "
    "left join s on s.make = m.make and s.segment = g.segment group by m.make, g.segment", "share")
on_listings("op_a10_geography", lambda df: market.geography(df, "location", "price"),
    "select location, avg(price) as mean_price, count(price) as n, (avg(price) / (sum(sum(price)) over () / sum(count(price)) over ()) - 1) * 100 as price_premium, row_number() over (order by count(price) desc, location)::int as count_rank from listings group by location", "mean_price price_premium")
on_listings("op_a11_seasonality", lambda df: market.seasonality(df, "date_scraped", "price"),
    ", g as (select 'month' as period_type, month(date_scraped)::int as period, avg(price) as mean_price, count(price) as n from listings group by 2 union all select 'quarter', quarter(date_scraped)::int, avg(price), count(price) from listings group by 2 "
    "union all select 'weekday', (isodow(date_scraped) - 1)::int, avg(price), count(price) from listings group by 2) select *, row_number() over (partition by period_type order by mean_price desc, period) = 1 as is_peak from g", "mean_price")
on_listings("op_a12_sufficiency", lambda df: market.sufficiency(df, "location", "make"),
    f"select location, make, count(*) as n, 1e2 * count(*) / sum(count(*)) over (partition by location) as share, {buckets.sql_cut('count(*)', buckets.SUFFICIENCY)} as level from listings group by location, make", "share")
on_listings("op_a13_opportunities", lambda df: market.opportunities(df, "location", "make", "price", few_loc=2000, few_pair=80, premium=0.001),
    ", g as (select location, count(*) as n, avg(price) as m, sum(sum(price)) over () / sum(count(price)) over () as o from listings group by location) select 'scarce_location' as kind, location, null::varchar as make, n, null::double as gap from g where n < 2000 "
    "union all select 'scarce_make', location, make, count(*), null from listings group by location, make having count(*) < 80 union all select 'high_price', location, null, n, m - o from g where m - o > 0.001 * o", "gap")
on_listings("op_a14_price_per_mileage", market.price_per_mileage,
    f"select {buckets.sql_cut('mileage', buckets.MILEAGE)} as bracket, avg(price) as mean_price, median(price) as median_price, count(price) as n, avg(price / mileage) as mean_ratio, median(price / mileage) as median_ratio from listings where mileage > 0 group by 1", "mean_price median_price mean_ratio median_ratio")
on_listings("op_a15_elasticity", lambda df: market.elasticity(df, "price"),
    ", e as (select " + ", ".join(f"quantile_cont(price, {i / 10}) as e{i}" for i in range(1, 11)) + " from listings), b as (select case " + " ".join(f"when price <= e{i + 1} then {i}" for i in range(10)) + " end::int as bin, price from listings, e), "
    "g as (select bin, count(*) as n, min(price) as lo, max(price) as hi, (min(price) + max(price)) / 2 as mid from b group by bin), c as (select *, mid / lag(mid) over (order by bin) - 1 as price_change, n / lag(n) over (order by bin) - 1 as count_change from g) "
    "select *, coalesce(count_change / nullif(price_change, 0), 0) as elasticity from c", "mid price_change count_change elasticity")
on_listings("op_a16_summary", lambda df: market.summary(df, "date_scraped", "make", "model", "location"), "select count(*) as rows, min(date_scraped) as first_seen, max(date_scraped) as last_seen, count(distinct make) as n_make, count(distinct model) as n_model, count(distinct location) as n_location from listings")
on_listings("op_t05_value_counts", lambda df: market.value_counts(df, "make", 10), "select make, count(*) as n from listings group by make order by n desc, make limit 10")
on_listings("op_a20_saturation", lambda df: market.saturation(df, "make", "price"), "select make, count(*) as n, avg(price) as avg_price from listings group by make order by n desc, make limit 20", "avg_price")
on_listings("op_a25_margin_leaderboard", lambda df: df.groupBy("make", "model").agg(F.count(F.lit(1)).alias("n"), F.avg(1 - F.col("mileage") / 250000).alias("avg_margin"), stats.quantile("price", 0.5).alias("median_price")).where("n >= 100").orderBy(F.desc("avg_margin"), "make", "model").limit(30),
    "select make, model, count(*) as n, avg(1 - mileage / 250000) as avg_margin, median(price) as median_price from listings group by make, model having count(*) >= 100 order by avg_margin desc, make, model limit 30", "avg_margin median_price")
on_listings("op_a28_depreciation_rates", lambda df: market.consecutive_depreciation(df, ["make", "model"], "year", "price"),
    ", g as (select make, model, year, avg(price) as m from listings group by all), r as (select *, (lag(m) over w - m) * 100 / (lag(m) over w * (lag(year) over w - year)) as rate from g window w as (partition by make, model order by year desc)) "
    "select make, model, avg(rate) as avg_rate, count(*) as n_years, case when avg(rate) > 15 then 'fast' when avg(rate) > 5 then 'normal' when avg(rate) is not null then 'slow' end as advice from r group by make, model", "avg_rate")
on_listings("op_a29_location_variation", lambda df: market.location_variation(df, "location", "price"), "select location, avg(price) as mean_price, (avg(price) / avg(avg(price)) over () - 1) * 100 as variation_pct from listings group by location", "mean_price variation_pct")
on_listings("op_a33_backtest_errors", lambda df: market.error_report(df.withColumn("guess", F.avg("price").over(series.Window.partitionBy("make", "model"))), "price", "guess", "make"),
    ", x as (select make, price, avg(price) over (partition by make, model) - price as e from listings) select make, count(*) as n, avg(abs(e)) as mae, median(abs(e)) as median_ae, sqrt(avg(e * e)) as rmse, median(abs(e) / price) * 100 as median_ape_pct, sqrt(avg(e * e / price / price)) * 100 as rmspe_pct from x group by make",
    "mae median_ae rmse median_ape_pct rmspe_pct")
on_listings("op_m08_error_by_band", lambda df: market.error_report(market.with_group_mean(df, ["make"], "price", "guess").withColumn("band", buckets.cut_left(F.col("price"), buckets.ERROR_BANDS)), "price", "guess", "band"),
    f", x as (select {buckets.sql_cut_left('price', buckets.ERROR_BANDS)} as band, price, avg(price) over (partition by make) - price as e from listings) select band, count(*) as n, avg(abs(e)) as mae, median(abs(e)) as median_ae, sqrt(avg(e * e)) as rmse, median(abs(e) / price) * 100 as median_ape_pct, sqrt(avg(e * e / price / price)) * 100 as rmspe_pct from x group by band",
    "mae median_ae rmse median_ape_pct rmspe_pct", orders=False)
on_listings("op_a34_field_coverage", lambda df: market.missing_profile(df, "make", "model", "version", "location", "status"),
    "select c as \"column\", count(*) as rows, 100.0::double - 1e2 * count(nullif(v, '')) / count(*) as missing_pct, 1e2 * count(distinct v) / count(*) as unique_pct from (unpivot (select make::varchar as make, model::varchar as model, version::varchar as version, location::varchar as location, status::varchar as status from listings) on make, model, version, location, status into name c value v) group by c",
    "missing_pct unique_pct")
on_listings("op_a36_feature_correlation", lambda df: market.correlations(df, "price", "mileage", "engine_size", "year"),
    ", g as (select corr(mileage, price) as mileage, corr(engine_size, price) as engine_size, corr(year, price) as year from listings) select feature, r, abs(r) as strength from (unpivot g on mileage, engine_size, year into name feature value r)", "r strength")
on_listings("op_a41_facets", lambda df: market.facets(df, "make", "model", "year", "location", "fuel_type"),
    " " + " union all ".join(f"select '{c}' as facet, {c}::varchar as value, count(*) as n from listings group by {c}" for c in ("make", "model", "year", "location", "fuel_type")))
on_listings("op_a42_source_freshness", lambda df: df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("last_seen").alias("newest"), F.count_if(F.col("status") == "O").alias("n_open")),
    "select source, count(*) as n, max(last_seen) as newest, count(*) filter (status = 'O') as n_open from listings group by source")
on_listings("op_a19_market_stats", lambda df: df.groupBy("make", "model").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.avg("year").alias("avg_year"), F.avg("mileage").alias("avg_km")),
    "select make, model, count(*) as n, avg(price) as avg_price, min(price) as min_price, max(price) as max_price, avg(year) as avg_year, avg(mileage) as avg_km from listings group by make, model", "avg_price avg_year avg_km")
on_listings("op_a35_quality_metrics", lambda df: market.missing_profile(df.select("seller", "condition", "fuel_type"), "seller", "condition", "fuel_type"),
    "select c as \"column\", count(*) as rows, 100.0::double - 1e2 * count(nullif(v, '')) / count(*) as missing_pct, 1e2 * count(distinct v) / count(*) as unique_pct from (unpivot (select seller::varchar as seller, condition::varchar as condition, fuel_type::varchar as fuel_type from listings) on seller, condition, fuel_type into name c value v) group by c", "missing_pct unique_pct")

BINS = {"op_b01_mileage": ("mileage", buckets.MILEAGE, False), "op_b02_mileage_lowest": ("mileage", buckets.MILEAGE, True), "op_b04_engine": ("engine_size", buckets.ENGINE, True), "op_b05_engine_names": ("engine_size", buckets.ENGINE_NAMES, False),
    "op_b06_mileage_names": ("mileage", buckets.MILEAGE_NAMES, False), "op_b07_price": ("price", buckets.PRICE, True)}
for _name, (_c, _bins, _low) in BINS.items():
    on_listings(_name, lambda df, c=_c, bins=_bins, low=_low: df.groupBy(buckets.cut(F.col(c), bins, low).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price")),
        f"select {buckets.sql_cut(_c, _bins, _low)} as bin, count(*) as n, avg(price) as mean_price from listings group by 1", "mean_price")
for _name, _bins in (("op_b03_age", buckets.AGE), ("op_b06_age_names", buckets.AGE_NAMES)):
    on_listings(_name, lambda df, bins=_bins: df.groupBy(buckets.cut(F.lit(2001) - F.col("year"), bins, True).alias("bin")).agg(F.count(F.lit(1)).alias("n")), f"select {buckets.sql_cut('2001 - year', _bins, True)} as bin, count(*) as n from listings group by 1")
for _name, _bins in (("op_b13_price_ranges", buckets.PRICE_RANGES), ("op_b14_error_bands", buckets.ERROR_BANDS)):
    on_listings(_name, lambda df, bins=_bins: df.groupBy(buckets.cut_left(F.col("price"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n")), f"select {buckets.sql_cut_left('price', _bins)} as bin, count(*) as n from listings group by 1")
on_listings("op_b08_equal_width", lambda df: buckets.equal_width(df, "price", 5, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi")),
    ", e as (select min(price) as a, max(price) as b from listings) select greatest(0, least(4, ceil((price - a) * 5 / (b - a)) - 1))::int as bin, count(*) as n, min(price) as lo, max(price) as hi from listings, e group by 1")
on_listings("op_b09_equal_frequency", lambda df: buckets.qcut(df, "price", 4, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price"), F.min("price").alias("lo"), F.max("price").alias("hi")),
    ", e as (select quantile_cont(price, 0.25) as a, quantile_cont(price, 0.5) as b, quantile_cont(price, 0.75) as c from listings) select case when price <= a then 0 when price <= b then 1 when price <= c then 2 else 3 end as bin, count(*) as n, avg(price) as mean_price, min(price) as lo, max(price) as hi from listings, e group by 1", "mean_price")

on_listings("op_w01_trends", lambda df: series.trends(df, "date_scraped", "price", "mileage"),
    " " + " union all ".join(f"select date_trunc('{u}', date_scraped)::timestamp as period, avg(price) as mean_price, median(price) as median_price, count(price) as n, avg(mileage) as mean_mileage, median(mileage) as median_mileage, '{u}' as period_type from listings group by 1" for u in ("month", "week")), "mean_price median_price mean_mileage median_mileage")
for _u in ("month", "week", "day"):
    on_listings(f"op_w02_trend_{_u}", lambda df, u=_u: series.trend(df, "date_scraped", "price", u),
        f", g as (select date_trunc('{_u}', date_scraped)::timestamp as period, avg(price) as mean_price, count(price) as n from listings group by 1), c as (select *, (mean_price - lag(mean_price) over (order by period)) / lag(mean_price) over (order by period) * 100 as change_pct from g) "
        "select *, case when change_pct > 0 then 'increasing' when change_pct < 0 then 'decreasing' else 'stable' end as trend from c", "mean_price change_pct")
on_listings("op_w03_momentum", lambda df: series.momentum(df, "date_scraped", "price"),
    ", g as (select date_trunc('week', date_scraped)::timestamp as period, avg(price) as mean_price, count(*) as n from listings group by 1), m as (select *, (mean_price / lag(mean_price) over w - 1) * 100 as price_momentum, (n / lag(n) over w - 1) * 100 as volume_momentum from g window w as (order by period)), "
    "s as (select *, (price_momentum + volume_momentum) / 2 as score from m) select *, case when score <= -2 then 'Bearish' when score <= 2 then 'Neutral' when score > 2 then 'Bullish' end as market from s", "mean_price price_momentum volume_momentum score")
on_listings("op_w04_depreciation", lambda df: series.depreciation(df, "year", "price"),
    ", g as (select year, avg(price) as mean_price, count(price) as n from listings group by year) select *, mean_price / lag(mean_price) over (order by year) - 1 as change, mean_price / first_value(mean_price) over (order by year) - 1 as cumulative from g", "mean_price change cumulative")
on_listings("op_w05_price_index", lambda df: series.price_index(df, "date_scraped", "price", 1996),
    ", g as (select date_trunc('month', date_scraped)::timestamp as month, avg(price) as mean_price from listings group by 1) select *, coalesce(mean_price * 100 / avg(case when year(month) = 1996 then mean_price end) over (), 100) as index from g", "mean_price index")
ORDER = "date_scraped, last_seen, order_id, line, price, mileage, seller, version, model"
on_listings("op_w06_row_momentum", lambda df: series.rolling(df, ["make", "location"], ORDER.split(", "), "price").select(*ROW_ID, "change", "mean_7", "mean_30", "move"),
    f", c as (select *, price / lag(price) over w - 1 as change, case when count(price) over w7 = 7 then avg(price) over w7 end as mean_7, case when count(price) over w30 = 30 then avg(price) over w30 end as mean_30 from listings "
    f"window w as (partition by make, location order by {ORDER}), w7 as (partition by make, location order by {ORDER} rows 6 preceding), w30 as (partition by make, location order by {ORDER} rows 29 preceding)) "
    "select order_id, line, make, model, price, mileage, location, change, mean_7, mean_30, case when change > 0 then 'up' when change < 0 then 'down' else 'stable' end as move from c", "change mean_7 mean_30")
on_listings("op_w07_moving_averages", lambda df: series.rolling(df, ["make", "location"], ORDER.split(", "), "price", full=False).select(*ROW_ID, "mean_7", "mean_30"),
    f"select order_id, line, make, model, price, mileage, location, avg(price) over (partition by make, location order by {ORDER} rows 6 preceding) as mean_7, avg(price) over (partition by make, location order by {ORDER} rows 29 preceding) as mean_30 from listings", "mean_7 mean_30")
on_listings("op_w08_percentile_rank", lambda df: df.select(*ROW_ID, stats.pct_rank("price", ["make", "model"]).alias("pct_rank")),
    "select order_id, line, make, model, price, mileage, location, (rank() over (partition by make, model order by price) + (count(*) over (partition by make, model, price) - 1) / 2e0) / count(*) over (partition by make, model) as pct_rank from listings", "pct_rank")
on_listings("op_w09_group_outliers", lambda df: series.group_outliers(df, ["make", "model"], "price", 1.5).select(*ROW_ID, "z", "is_outlier"),
    "select order_id, line, make, model, price, mileage, location, (price - avg(price) over w) / stddev_samp(price) over w as z, coalesce(abs((price - avg(price) over w) / stddev_samp(price) over w) > 1.5, false) as is_outlier from listings window w as (partition by make, model)", "z")
on_listings("op_w10_volatility", lambda df: series.volatility(df, ["make", "model"], "price").select("make", "model", "volatility").distinct(), "select make, model, stddev_samp(price) / avg(price) as volatility from listings group by make, model", "volatility")
on_listings("op_w11_frequency", lambda df: series.frequency_encode(df, "version").select(*ROW_ID, "version", "freq", "rarity", "is_top"),
    ", g as (select version, count(*) as freq, 1 - count(*) / max(count(*)) over () as rarity, row_number() over (order by count(*) desc, version) <= 10 as is_top from listings group by version) select order_id, line, make, model, price, mileage, location, version, freq, rarity, is_top from listings join g using (version)", "rarity")
on_listings("op_w12_comparable_count", lambda df: series.comparable_count(df, ["make", "model"], "year").select(*ROW_ID, "year", "comparables"),
    "select order_id, line, make, model, price, mileage, location, year, count(*) over (partition by make, model order by year range between 2 preceding and 2 following) - 1 as comparables from listings")
on_listings("op_w13_percentile_grade", lambda df: series.percentile_grade(df.groupBy("seller").agg(F.avg("price").alias("price"), F.avg("mileage").alias("km")), F.col("km") / F.col("price"), "seller"),
    ", g as (select seller, avg(price) as price, avg(mileage) as km from listings group by seller), p as (select *, km / price as ratio, row_number() over (order by km / price, seller) / count(*) over () * 100 as pct from g) "
    "select *, case when pct >= 99 then 'A+' when pct >= 95 then 'A' when pct >= 85 then 'B' when pct >= 60 then 'C' else 'D' end as grade from p", "price km ratio pct")
on_listings("op_w14_weekly_trend", lambda df: df.groupBy(series.week_label("date_scraped").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price")), "select strftime(date_scraped, '%Y-%W') as week, count(*) as n, avg(price) as mean_price from listings group by 1", "mean_price")
on_listings("op_w15_days_on_market", lambda df: series.days_on_market(df, ["make"], "last_seen", "2001-12-31 00:00:00"), "select make, avg((epoch(timestamp '2001-12-31') - epoch(last_seen)) / 86400e0) as avg_days from listings group by make", "avg_days")
