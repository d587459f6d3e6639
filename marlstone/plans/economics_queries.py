"""Queries of deal economics, calibration, threshold sweeps and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import economics
from marlstone.operators.economics import GRADES, NET_REPAIRS, PLAUSIBLE, RATINGS, RECONDITIONING
from marlstone.plans import rounded, sql_rounded
from marlstone.plans.domain_queries import MED, _med, on_table
from marlstone.plans.market_queries import ROW_ID, on_listings
from marlstone.registry import register
from marlstone.sources.tables import table

ID = ", ".join(ROW_ID)
V = F.col
CONDITION = "(engine_size * 2)::double"


def _from(c: str, steps: tuple, otherwise: str) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}e0"
    return "case " + " ".join(f"when {c} >= {least} then {q(v)}" for least, v in steps) + f" else {otherwise} end"


_MOTO = "transmission = 'O'"
_WORK = f"least(price * 0.45e0, {_from(CONDITION, RECONDITIONING, '5500e0')} * case when {_MOTO} then 0.45e0 else 1e0 end)"
on_listings("op_x27_acquisition_costs", lambda df: df.select(*ROW_ID, economics.acquisition_costs(V("price"), V("engine_size") * 2, V("transmission") == "O", F.when(V("fuel_type") == "N", V("mileage") / 100)).alias("costs")),
    f" select {ID}, 55.3e0 + case when {_MOTO} then 22e0 else 32e0 end + case when fuel_type = 'N' then mileage / 100e0 + 550 else 0e0 end + {_WORK} as costs from listings", "costs")
on_listings("op_x27_selling_costs", lambda df: df.select(*ROW_ID, economics.selling_costs(V("price"), V("line") * 15 - 30, V("transmission") == "O").alias("c")).select(*ROW_ID, "c.*"),
    f", s as (select *, price * 0.025e0 * case when {_MOTO} then 0.6e0 else 1e0 end as warranty, price * 0.06e0 * greatest(line * 15 - 30, 0) / 365 as holding from listings) select {ID}, warranty, holding, warranty + holding as total from s", "warranty holding total")
on_listings("op_n14_buy_verdict", lambda df: _med(df).select(*ROW_ID, economics.buy_verdict(V("price"), V("med") * 0.92 - 1000).alias("verdict")),
    MED + f" select {ID}, case when price <= med * 0.92e0 - 1000 then 'BUY_ZONE' when price <= (med * 0.92e0 - 1000) * 1.1e0 then 'NEGOTIATE' else 'PASS' end as verdict from m")
on_listings("op_n12_statistical_score", lambda df: _med(df).select(*ROW_ID, economics.statistical_score(V("price"), V("med")).alias("s")).select(*ROW_ID, "s.*"),
    MED + f", s as (select *, (med - price) / med * 100 as pct, least(10e0, greatest(0e0, 5 + (med - price) / med * 100 / 5)) as score from m) select {ID}, score, {_from('score', GRADES, chr(39) + 'poor' + chr(39))} as grade, greatest(0e0, med - price) as profit, greatest(0e0, pct) as profit_pct from s", "score profit profit_pct")
on_listings("op_n13_rating", lambda df: df.select(economics.rating(F.when(V("line") != 7, V("mileage") / 20000)).alias("rating")).groupBy("rating").agg(F.count(F.lit(1)).alias("n")),
    f" select case when line = 7 then 'N/A' else {_from('mileage / 20000', RATINGS, chr(39) + 'Fraco' + chr(39))} end as rating, count(*) as n from listings group by rating")
on_listings("op_v28_plausibility", lambda df: _med(df).select(*ROW_ID, economics.plausibility(V("price"), V("med"), V("line") / 6.0).alias("verdict")),
    MED + f" select {ID}, case when line / 6e0 < 0.35e0 then 'indeterminado' " + " ".join(f"when price / med < {top} then '{name}'" for top, name in PLAUSIBLE) + " when price / med <= 1.15e0 then 'preco_de_mercado' when price / med <= 1.4e0 then 'caro' else 'muito_caro' end as verdict from m")
on_listings("op_n27_net_profit", lambda df: _med(df).select(*ROW_ID, economics.net_profit(V("price"), V("med"), V("mileage"), V("source") == "ASIA").alias("p")).select(*ROW_ID, "p.*", economics.profit_badge(V("p.net"), V("p.net_pct")).alias("badge")),
    MED + ", g as (select *, greatest(0e0, med - price) as gross, greatest(0e0, med - price) - price * 0.155e0 - case " + " ".join(f"when mileage < {top} then {cost}e0" for top, cost in NET_REPAIRS) + " else 1500e0 end - 500 - case when source = 'ASIA' then price * 0.18e0 else 0e0 end as net from m) "
    f"select {ID}, gross, net, net / price * 100 as net_pct, case when net > 3000 and net / price * 100 > 8 then 'EXCELENTE' when net > 1000 and net / price * 100 > 5 then 'BOM' when net > 0 then 'MARGINAL' else 'PREJUÍZO' end as badge from g", "gross net net_pct")
on_listings("op_m09_price_range", lambda df: _med(df).select(*ROW_ID, economics.price_range(V("med"), V("line") / 7.0).alias("r")).select(*ROW_ID, "r.*"),
    MED + f" select {ID}, med * (1 - 0.1e0 * (2 - line / 7e0)) as low, med * (1 + 0.1e0 * (2 - line / 7e0)) as high, 0.1e0 * (2 - line / 7e0) * 100 as tolerance_pct from m", "low high tolerance_pct")
on_listings("op_n18_calibration_ratio", lambda df: economics.calibration_ratio(_med(df), "price", "med"),
    MED + " select count(*) as n, median(price / med) as median_ratio, avg(price / med) as mean_ratio, stddev_pop(price / med) as std_ratio from m where price / med between 0.3 and 3.0", "median_ratio mean_ratio std_ratio")
on_listings("op_n22_snapshot", lambda df: economics.snapshot(df.withColumn("value", F.when(V("line") < 6, F.floor(V("price") / 500) * 500)).withColumn("score", V("mileage") / 20000), "value", "score"),
    ", v as (select case when line < 6 then floor(price / 500)::bigint * 500 end as value, mileage / 20000 as score from listings) select count(*) as total, count(value) as with_value, count(*) - count(value) as without_value, count(*) filter (value = 500) as exact_500, count(*) filter (value = 10000) as exact_10000, "
    "avg(score) filter (value is not null) as score_mean, count(*) filter (value is not null and score < 3) as score_lt3, count(*) filter (value is not null and score >= 3 and score < 7) as score_3_7, count(*) filter (value is not null and score >= 7) as score_gte7 from v", "score_mean")
PROFILE = lambda c: f"select '{c}' as name, 'numerical' as type, count({c}) as n, count(*) - count({c}) as missing, avg({c})::double as mean, stddev_samp({c}) as std, min({c})::double as min, max({c})::double as max, null::bigint as \"unique\", null::varchar as top from p"
TOPS = lambda c: f"select '{c}', 'categorical', count({c}), count(*) - count({c}), null, null, null, null, count(distinct {c}), (select {c} from p where {c} is not null group by {c} order by count(*) desc, {c} limit 1) from p"
on_listings("op_n32_column_profile", lambda df: economics.column_profile(df.withColumn("engine", F.when(V("line") < 5, V("engine_size"))).withColumn("place", F.when(V("line") > 2, V("location"))), ["price", "mileage", "engine"], ["make", "place"]),
    ", p as (select price, mileage, make, case when line < 5 then engine_size end as engine, case when line > 2 then location end as place from listings), a as (" + " union all ".join([*map(PROFILE, ("price", "mileage", "engine")), *map(TOPS, ("make", "place"))]) + ") select *, missing * 1e2 / (n + missing) as missing_pct from a", "mean std min max missing_pct")

_SCORED = "select e.value / 200e0 as score, e.event_type = 'purchase' as y from events e"
SWEEP = (
    f"with x as ({_SCORED}), t as (select k / 20e0 as threshold from range(2, 20) r(k)), g as (select threshold, count(*) filter (score >= threshold and y) as tp, count(*) filter (score >= threshold and not y) as fp, count(*) filter (y) as p, count(*) filter (not y) as n from x cross join t where y is not null group by threshold) "
    "select threshold, case when tp + fp > 0 then tp / (tp + fp) else 0e0 end as precision, case when p > 0 then tp / p else 0e0 end as recall, case when tp + fp + p > 0 then 2 * tp / (tp + fp + p) else 0e0 end as f1, (tp + n - fp) / (p + n) as accuracy from g"
)
_events = lambda df: df.select((V("value") / 200).alias("score"), (V("event_type") == "purchase").alias("y"))
on_table("op_n33_threshold_metrics", "events", lambda df: economics.threshold_sweep(_events(df), "score", "y"), SWEEP, "threshold precision recall f1 accuracy")
register("op_n33_best_threshold", lambda spark, d: rounded(economics.best_threshold(economics.threshold_sweep(_events(table(spark, d, "events")), "score", "y"))), sql_rounded(f"select threshold, f1 as value from ({SWEEP}) order by f1 desc, threshold limit 1", "threshold value"))
