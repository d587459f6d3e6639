"""Queries of the statistical pricer, blends, bounded scores, retention, resale profit and model features."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import estimates
from marlstone.plans.domain_queries import MED, _med
from marlstone.plans.market_queries import ROW_ID, on_listings

ID = ", ".join(ROW_ID)
V = F.col

on_listings("op_v17_statistical_price",
    lambda df: estimates.statistical_price(df.where("line <= 5").withColumn("make", F.when(V("line") == 5, F.concat("make", F.lit("-"), "order_id")).otherwise(V("make"))), "make", "year", "mileage", "price", 2001).select(*ROW_ID, "method", "estimate"),
    f""", l as (select * replace (case when line = 5 then make || '-' || order_id else make end as make) from listings where line <= 5), p as (select * from l where price > 500 and price < 500000),
r1 as (select make, year, price, row_number() over (partition by make, year order by price) - 1 as i, count(*) over (partition by make, year) as n from p), m1 as (select make, year, price as m from r1 where n >= 3 and i = n // 2),
r2 as (select make, price, row_number() over (partition by make order by price) - 1 as i, count(*) over (partition by make) as n from p), m2 as (select make, price as m from r2 where n >= 3 and i = n // 2),
r3 as (select price, row_number() over (order by price) - 1 as i, count(*) over () as n from p), m3 as (select price as m from r3 where i = n // 2),
x as (select l.*, m1.m as a, m2.m as b, (select m from m3) as c, 2001 - l.year as age, l.mileage / (15000 * greatest(1, 2001 - l.year)) as ratio from l left join m1 on l.make = m1.make and l.year = m1.year left join m2 on l.make = m2.make)
select {ID}, case when a is not null then 'brand_year' when b is not null then 'brand' else 'global' end as method,
 coalesce(a, b, c) * case when a is null and age > 0 then 1 - least(0.8e0, age * 0.08e0) else 1e0 end * case when ratio > 1.5 then greatest(0.7e0, 1 - (ratio - 1.5e0) * 0.1e0) when ratio < 0.5 then least(1.15e0, 1 + (0.5e0 - ratio) * 0.1e0) else 1e0 end as estimate from x""", "estimate")
on_listings("op_v16_bounded_score", lambda df: _med(df).select(*ROW_ID, estimates.bounded_score(F.when(V("line") != 3, (V("med") - V("price")) / V("med") * 100), V("comps") / 6, V("fuel_type") == "N").alias("score")),
    MED + f""", x as (select *, comps / 6 as c, case when line <> 3 then 5 + greatest(-5e0, least(5e0, (med - price) / med * 100 / 6)) end as raw from m),
b as (select *, case when c >= 0.65 then 0e0 when c >= 0.45 then 2e0 when c >= 0.25 then 3.5e0 else 4.5e0 end as lo, case when c >= 0.65 then 10e0 when c >= 0.45 then 8e0 when c >= 0.25 then 6.5e0 else 5.5e0 end as hi from x)
select {ID}, case when raw is not null then greatest(lo, least(case when fuel_type = 'N' then least(hi, 6e0) else hi end, raw)) end as score from b""", "score")
on_listings("op_v29_blend",
    lambda df: _med(df).select(*ROW_ID, estimates.blended(V("med"), V("med") * 0.9, F.when(V("line") != 2, V("med") * 1.1), V("comps") / 5, V("price"), F.when(V("line") % 2 == 0, V("med") * (0.8 + V("line") * 0.1)), V("engine_size") / 4).alias("b")).select(*ROW_ID, "b.*"),
    MED + f""", x as (select *, comps / 5 as conf, greatest(0.4e0, least(0.95e0, comps / 5)) as base, case when line % 2 = 0 then med * (0.8e0 + line * 0.1e0) end as ref from m),
y as (select *, conf < 0.6 and price / med between 0.4 and 2.5 as wm, coalesce(ref / med between 0.4 and 2.5, false) and engine_size / 4 >= 0.5 as wr from x),
z as (select *, (med * base + case when wm then price * 0.3e0 else 0e0 end + case when wr then ref * 0.2e0 else 0e0 end) / (base + case when wm then 0.3e0 else 0e0 end + case when wr then 0.2e0 else 0e0 end) as center,
 least(0.95e0, greatest(base + case when wm and abs(price - med) / med <= 0.15 then 0.05e0 else 0e0 end + case when wr and abs(ref - med) / med <= 0.2 then 0.05e0 else 0e0 end, conf)) as cc,
 least(med * 0.9e0, case when wm then price * 0.9e0 else med * 0.9e0 end) as lo, case when line <> 2 then greatest(med * 1.1e0, case when wm then price * 1.1e0 else 0e0 end) when wm then price * 1.1e0 end as hi from y),
s as (select *, least(0.35e0, greatest(0.06e0, 0.45e0 * (1 - least(1e0, greatest(0e0, cc))))) as share from z)
select {ID}, center as value, case when lo <= center then least(lo, center * (1 - share)) else center * (1 - share) end as low, case when hi >= center then greatest(hi, center * (1 + share)) else center * (1 + share) end as high,
 cc as confidence, wm::int + wr::int as opinions from s""", "value low high confidence")
on_listings("op_n10_combined_price", lambda df: _med(df).select(*ROW_ID, estimates.combined_price(F.when(V("line") != 3, V("med")), F.when(V("line") != 5, V("price")), V("line") * 1.5, V("engine_size") * 2.5).alias("p")),
    MED + f""", b as (select *, case when line = 3 then price when line = 5 then med else med * 0.8e0 + price * 0.2e0 end as base from m)
select {ID}, base * (1 + case when line * 1.5 > 7 then -0.1e0 when line * 1.5 < 3 then 0.05e0 else 0e0 end + case when engine_size * 2.5e0 < 5 then -0.1e0 when engine_size * 2.5e0 > 8 then 0.05e0 else 0e0 end) as p from b""", "p")
on_listings("op_v13_yearly_loss", lambda df: estimates.yearly_loss(df, ["make", "model"], "year", "price"),
    """, g as (select make, model, year, median(price) as p from listings group by all), s as (select make, model, max(year) - min(year) as span, min_by(p, year) as o, max_by(p, year) as n from g group by all)
select make, model, span, (o - n) / nullif(span, 0) as per_year from s where (o - n) / nullif(span, 0) > 0""", "per_year")
on_listings("op_n19_implied_retention", lambda df: estimates.implied_retention(_med(df), "model", "price", V("med") * 0.9, F.lit(1.1), 5),
    MED + ", r as (select model, price / (med * 0.9e0) as r from m where price / (med * 0.9e0) between 0.3 and 2.0), g as (select model, count(*) as n, median(r) as implied, 1.1e0 as old from r group by model having count(*) >= 5) select *, least(1.5e0, greatest(0.5e0, 0.5e0 * old + 0.5e0 * implied)) as retention from g", "implied retention old")
on_listings("op_n24_resale_profit",
    lambda df: _med(df).select(*ROW_ID, estimates.resale_profit(V("price"), F.when(V("source") == "ASIA", V("price") * estimates.auction_multiple(2003 - V("year"), V("mileage"))).otherwise(V("med")), V("source") == "ASIA", F.when(V("line") != 2, V("engine_size") * 2)).alias("p")).select(*ROW_ID, "p.*"),
    MED + f""", x as (select *, case when source = 'ASIA' then price * case when mileage > 250000 then 3.5e0 when mileage > 150000 then 2.5e0 when 2003 - year > 5 then 2e0 else 1.6e0 end else med end as r, case when line <> 2 then engine_size * 2 else 6e0 end as cs from m),
y as (select *, price * case when source = 'ASIA' then 0.005e0 else 0.055e0 end as taxes, case when cs >= 8 then 0e0 when cs >= 6 then 500e0 when cs >= 4 then 1500e0 when cs >= 2 then 3000e0 else 5000e0 end as repairs, r * 0.07e0 as commission from x)
select {ID}, taxes, repairs, commission, r - price - taxes - repairs - commission - 250 as net, (r - price - taxes - repairs - commission - 250) / price * 100 as net_pct from y""", "taxes repairs commission net net_pct")
_FUEL = {"A": "Diesel", "N": "Hybrid"}
on_listings("op_p09_fuel_proxy", lambda df: df.select(*ROW_ID, estimates.fuel_proxy(F.coalesce(*[F.when(V("fuel_type") == k, v) for k, v in _FUEL.items()], F.lit("Gasoline")), V("engine_size")).alias("points")),
    f" select {ID}, case when fuel_type = 'A' then 3e0 when fuel_type = 'N' then 4e0 when engine_size < 1.5 then 4e0 when engine_size < 2 then 3e0 else 2e0 end as points from listings", "points")
on_listings("op_p10_features", lambda df: estimates.feature_vector(df.withColumn("mileage", V("mileage") * 1.5), "year", "mileage", "fuel_type", "source", 2000, {"A": 0.88, "N": 1.12}, {"ASIA": 1.05}).select("order_id", "line", "seller", "version", *[f"f_{c}" for c in ("age", "km_per_year", "log_km", "km_excess", "km_extreme", "fuel", "place")]),
    """ select order_id, line, seller, version, greatest(0, 2000 - year)::double as f_age, mileage * 1.5e0 / greatest(1, 2000 - year) as f_km_per_year, ln(1 + mileage * 1.5e0) as f_log_km, greatest(0e0, mileage * 1.5e0 - 150000) as f_km_excess,
 (mileage * 1.5e0 > 250000)::int::double as f_km_extreme, case fuel_type when 'A' then 0.88e0 when 'N' then 1.12e0 else 1e0 end as f_fuel, case source when 'ASIA' then 1.05e0 else 1e0 end as f_place from listings""", "f_age f_km_per_year f_log_km f_km_excess f_km_extreme f_fuel f_place")
