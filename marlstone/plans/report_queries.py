"""Queries of reports, shares, histograms, funnels and diagnoses."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import buckets
from marlstone.operators import reports
from marlstone.plans.domain_queries import MED, _med, on_table
from marlstone.plans.market_queries import ROW_ID, on_listings

ID = ", ".join(ROW_ID)
V = F.col
BAND = buckets.sql_cut_left("price", buckets.PRICE_RANGES)

on_listings("op_a17_statistics", lambda df: reports.table_statistics(df, "price", "last_seen", "1998-08-01"),
            " select count(*) as n, avg(price) as mean_price, min(price) as min_price, max(price) as max_price, count(*) filter (last_seen >= date '1998-07-25') as recent from listings", "mean_price min_price max_price")
on_listings("op_a18_dashboard_counts", lambda df: reports.dashboard_counts(df, "make", V("mileage") > 100000), " select count(*) as n, count(distinct make) as brands, count(*) filter (mileage > 100000) as wanted from listings")
on_listings("op_a21_demand", lambda df: reports.demand(df.withColumn("deal", V("mileage") / 25000).withColumn("days", F.datediff(F.lit("1999-01-01").cast("date"), V("last_seen").cast("date")) / 20), ["make", "model"], "price", "deal", "days", "last_seen", "1998-08-01"),
    """, g as (select make, model, count(*) as n, avg(date_diff('day', last_seen::date, date '1999-01-01') / 20) as d, avg(mileage / 25000) as s,
 avg(price) filter (date_diff('day', last_seen::date, date '1998-08-01') between 0 and 30) as pn, avg(price) filter (date_diff('day', last_seen::date, date '1998-08-01') between 31 and 60) as po from listings group by make, model),
s as (select *, 0.4e0 * greatest(0e0, 10 - d / 10) + 0.3e0 * case when 10 - s * 1.5e0 > 0 then 10 - s * 1.5e0 else 5e0 end + 0.3e0 * least(10e0, greatest(1e0, 10 - n / 20)) as score from g)
select make, model, n, score, case when (pn - po) / po * 100 > 1 then 'rising' when (pn - po) / po * 100 < -1 then 'falling' else 'stable' end as trend,
 case when score >= 8 then 'very_high' when score >= 6 then 'high' when score >= 4 then 'medium' when score >= 2 then 'low' else 'very_low' end as level from s""", "score")
on_listings("op_a22_daily_trend", lambda df: reports.daily_trend(df, "last_seen", "price"),
            ", d as (select last_seen::date as day, avg(price) as mean from listings group by 1), g as (select count(*) as days, min_by(mean, day) as first_mean, max_by(mean, day) as last_mean from d) select *, (last_mean - first_mean) * 100 / first_mean as change_pct from g", "first_mean last_mean change_pct")
on_listings("op_a22_score_distribution", lambda df: reports.score_distribution(df, F.when(V("line") != 4, V("mileage") / 20000 - 1)),
            """, s as (select case when line <> 4 then mileage / 20000 - 1 end as s from listings) select count(*) as n, avg(s) as mean, median(s) as median, stddev_samp(s) as std, count(*) filter (s >= 8) as excellent,
 count(*) filter (s >= 6 and s < 8) as good, count(*) filter (s >= 4 and s < 6) as fair, count(*) filter (s < 4) as poor from s where s <> 0""", "mean median std")
on_listings("op_a23_portfolio", lambda df: reports.portfolio(_med(df).where("make = 'Brand#11'"), V("price") * 1.1, V("med"), V("med") - V("price") * 1.1),
            MED + ", g as (select count(*) as n, sum(price * 1.1e0) as invested, sum(med) as value, sum(med - price * 1.1e0) as net, count(*) filter (med - price * 1.1e0 > 0) as winners, count(*) filter (med - price * 1.1e0 <= 0) as losers from m where make = 'Brand#11') select *, net * 100 / invested as roi_pct from g", "invested value net roi_pct")
on_listings("op_a24_segment_summary", lambda df: reports.segment_summary(_med(df), "source", V("med") - V("price"), (V("med") - V("price")) / V("price") * 100, V("line") * 10),
            MED + " select source, count(*) as n, avg(med - price) as mean_profit, avg((med - price) / price * 100) as mean_roi, avg(line * 10) as mean_days from m group by source", "mean_profit mean_roi mean_days")
on_listings("op_a26_auction_summary", lambda df: df.where("status = 'F'").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price"), F.max("price").alias("max_price"), F.max("last_seen").alias("latest")),
            " select source, count(*) as n, avg(price) as mean_price, max(price) as max_price, max(last_seen) as latest from listings where status = 'F' group by source", "mean_price max_price")
on_listings("op_a27_market_share", lambda df: reports.shares(df, "model"), ', g as (select model, count(*) as n from listings group by model) select model, n, n * 1e2 / (select sum(n) from g) as share, (row_number() over (order by n desc, model))::int as "rank" from g order by n desc, model limit 10', "share")
on_listings("op_a30_histogram", lambda df: reports.histogram_stats(df, buckets.cut_left(V("price"), buckets.PRICE_RANGES)),
            f", h as (select {BAND} as bin, count(*) as n from listings group by 1) select sum(n)::bigint as total, count(*) as bins, min_by(bin, (-n, bin)) as most, min_by(bin, (n, bin)) as least, avg(n) as per_bin from h", "per_bin")
on_listings("op_a32_floor_rank", lambda df: reports.floor_rank(df, ["source"], "price"),
            ", r as (select source, price, row_number() over (partition by source order by price) - 1 as i, count(*) over (partition by source) as n from listings) select source, max(n) as n, max(price) filter (i = floor(0.1 * (n - 1))) as p10, max(price) filter (i = floor(0.5 * (n - 1))) as p50, max(price) filter (i = floor(0.9 * (n - 1))) as p90 from r group by source", "p10 p50 p90")
_reasons = lambda: F.array_compact(F.array(F.when(V("price") > 40000, "dear"), F.when(V("mileage") > 150000, "worn"), F.when(V("year") < 1996, "old")))
on_listings("op_x30_reason_histogram", lambda df: reports.exploded_histogram(df.withColumn("j", F.to_json(_reasons())).withColumn("a", F.from_json("j", "array<string>")), V("a")),
            " select 'dear' as reason, count(*) filter (price > 40000) as n from listings union all select 'worn', count(*) filter (mileage > 150000) from listings union all select 'old', count(*) filter (year < 1996) from listings")
_METHODS = {"vehicle": ["make", "model", "year", "location"], "price": ["make", "price"], "seller": ["seller", "version"]}
on_listings("op_a38_duplicate_patterns", lambda df: reports.duplicate_patterns(df, _METHODS),
            " " + " union all ".join(f"select '{k}' as method, coalesce(sum(k) filter (k > 1), 0)::bigint as rows, count(*) filter (k > 1) as groups, max(k) as largest, coalesce(sum(k) filter (k > 1), 0) * 1e2 / sum(k) as pct from (select count(*) as k from listings group by {', '.join(c)})" for k, c in _METHODS.items()), "pct")
on_listings("op_a39_prediction_stats", lambda df: reports.prediction_stats(_med(df).withColumn("conf", F.least(F.lit(1.0), V("comps") / 4)), "med", "conf"),
            MED + ", c as (select med, least(1e0, comps / 4) as c from m) select count(med) as n, avg(med) as mean, stddev_samp(med) as std, min(med) as min, max(med) as max, avg(c) as mean_confidence, count(*) filter (c >= 0.8) as high, count(*) filter (c >= 0.5 and c < 0.8) as medium, count(*) filter (c < 0.5) as low from c", "mean std min max mean_confidence")
on_table("op_a43_collapsed_alerts", "events", lambda df: reports.collapsed(df, ["event_type"], "ts", "2024-01-15 12:00:00", 60 * 24), "select event_type, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from events where ts > timestamp '2024-01-14 12:00:00' and ts <= timestamp '2024-01-15 12:00:00' group by event_type")
STAGES = ["view", "click", "signup", "purchase"]
on_table("op_a44_funnel", "events", lambda df: reports.funnel(df, "event_type", STAGES, "user_id"),
         "with s as (select unnest(range(0, 4))::int as step), n as (select step, ['view', 'click', 'signup', 'purchase'][step + 1] as stage, (select count(distinct user_id) from events where event_type = ['view', 'click', 'signup', 'purchase'][step + 1]) as n from s) "
         "select step, stage, n, n * 1e2 / nullif(lag(n) over (order by step), 0) as of_previous, n * 1e2 / nullif(first(n) over (order by step), 0) as of_first from n", "of_previous of_first")
on_listings("op_a45_commission", lambda df: df.select(*ROW_ID, reports.commission(V("price") / 10, F.when(V("line") == 1, "private").when(V("line") == 2, "professional").when(V("line") == 3, "premium").when(V("line") == 4, "enterprise").otherwise("x"), V("engine_size") * 60).alias("commission")),
            f" select {ID}, greatest(price / 10 * case line when 1 then 0.025e0 when 2 then 0.02e0 when 3 then 0.015e0 when 4 then 0.01e0 else 0.02e0 end, case line when 1 then 5e0 when 2 then 10e0 when 3 then 15e0 when 4 then 25e0 else 5e0 end) * (1 - case line when 2 then 0.1e0 when 3 then 0.15e0 when 4 then 0.2e0 else 0e0 end * case when engine_size * 60 >= 201 then 2e0 when engine_size * 60 >= 51 then 1.5e0 when engine_size * 60 >= 11 then 1e0 else 0e0 end) as commission from listings", "commission")
_BOUNDS = {"price": (0, 1e6), "mileage": (0, 150000), "year": (1900, 2001), "engine_size": (0.5, 10)}
on_listings("op_n03_range_validation", lambda df: reports.range_validation(df.withColumn("mileage", F.when(V("line") != 3, V("mileage"))), _BOUNDS),
            " " + " union all ".join(f"select '{c}' as name, min({v})::double as min, max({v})::double as max, count(*) filter ({v} is null) as missing, min({v}) >= {lo} and max({v}) <= {hi} as ok from listings" for c, (lo, hi) in _BOUNDS.items() for v in [f"(case when line <> 3 then {c} end)" if c == "mileage" else c]), "min max")
on_listings("op_n26_coverage", lambda df: reports.coverage_diagnosis(_med(df).withColumn("v", F.when(V("comps") > 2, V("med"))).withColumn("r", F.when(V("line") % 2 == 0, 1)).withColumn("p", F.when(V("fuel_type") == "A", 1)), "v", "r", "p"),
            MED + " select count(*) as n, count(*) filter (comps <= 2) as without, count(*) filter (comps <= 2 and line % 2 = 0) as by_reference, count(*) filter (comps <= 2 and fuel_type = 'A') as by_model, count(*) filter (comps <= 2 and line % 2 = 0 and fuel_type = 'A') as by_both, count(*) filter (comps <= 2 and line % 2 <> 0 and fuel_type <> 'A') as by_none from m")
on_listings("op_n02_before_after", lambda df: reports.before_after(df.withColumn("engine_size", F.when(V("line") > 2, V("engine_size"))), df.where("price > 5000"), ["price", "engine_size"]),
            " select 'price' as name, count(price) as filled_before, count(*) as rows_before, count(price) filter (price > 5000) as filled_after, count(*) filter (price > 5000) as rows_after from listings union all select 'engine_size', count(*) filter (line > 2), count(*), count(engine_size) filter (price > 5000), count(*) filter (price > 5000) from listings")
on_listings("op_n01_price_summary", lambda df: reports.price_summary(df, "price"),
            ", g as (select count(price) as n, avg(price) as mean, stddev_samp(price) as std, min(price) as min, max(price) as max, " + ", ".join(f"quantile_cont(price, {q}) as p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " from listings) select *, p90 / p10 as spread from g", "mean std min max p10 p25 p50 p75 p90 spread")

# --- named bin tables of their own
for _name, _c, _bins, _expr in (
    ("op_b11_sufficiency", lambda: V("mileage") / 4000, buckets.SUFFICIENCY, "mileage / 4000"), ("op_b12_momentum", lambda: V("mileage") / 20000 - 5, buckets.MOMENTUM, "(mileage / 20000 - 5)"),
):
    on_listings(_name, lambda df, c=_c, b=_bins: df.groupBy(buckets.cut(c(), b).alias("bin")).agg(F.count(F.lit(1)).alias("n")), f" select {buckets.sql_cut(_expr, _bins)} as bin, count(*) as n from listings group by 1")
on_listings("op_b15_value_category", lambda df: df.groupBy(buckets.cut(V("mileage") / 2000, buckets.VALUE, True).alias("bin")).agg(F.count(F.lit(1)).alias("n")), f" select {buckets.sql_cut('(mileage / 2000)', buckets.VALUE, True)} as bin, count(*) as n from listings group by 1")
