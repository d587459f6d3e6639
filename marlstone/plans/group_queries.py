"""Queries of group filters, market estimates, brand names, probes and whole evaluations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from marlstone.operators import comparables, decisions, estimates, markets, matching, rules
from marlstone.plans import rounded
from marlstone.plans.domain_queries import MED, _med
from marlstone.plans.market_queries import ROW_ID, on_listings
from marlstone.registry import register
from marlstone.sources.tables import table

ID = ", ".join(ROW_ID)
V = F.col
KEYS = ["make", "model", "year"]

on_listings("op_v06_robust_rows", lambda df: markets.robust_rows(df.withColumn("price", F.when(V("order_id") % 50 == 0, V("price") * 9).otherwise(V("price"))), KEYS, "price", 2.5).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("top")),
    """, x as (select * replace (case when order_id % 50 = 0 then price * 9 else price end as price) from listings), a as (select *, count(*) over w as n, abs(price - median(price) over w) as d from x window w as (partition by make, model, year)),
b as (select *, median(d) over (partition by make, model, year) as mad from a), f as (select *, n >= 4 and mad > 0 and 0.6745e0 * d / mad > 2.5 as far from b), l as (select *, count(*) filter (far) over (partition by make, model, year) as lost from f)
select make, model, year, count(*) as n, max(price) as top from l where not far or lost > greatest(1, n // 4) group by all""", "top")
on_listings("op_v07_winsorized", lambda df: markets.winsorized(df, KEYS, "price").select(*ROW_ID, "winsorized"),
    f""", r as (select *, row_number() over (partition by make, model, year order by price) - 1 as i, count(*) over (partition by make, model, year) as n from listings),
e as (select make, model, year, max(price) filter (i = greatest(1, floor(n * 0.05))) as lo, max(price) filter (i = n - 1 - greatest(1, floor(n * 0.05))) as up from r where n >= 5 group by all)
select l.order_id, line, l.make, l.model, price, mileage, location, case when lo is null then price else least(greatest(price, lo), up) end as winsorized from listings l left join e on l.make = e.make and l.model = e.model and l.year = e.year""", "winsorized")
_row = lambda a, y, k, r, f, g: F.struct(y.alias("year"), k.alias("km"), r.alias("rank"), f.alias("fuel"), g.alias("gearbox")).alias(a)
on_listings("op_v04_similarity",
    lambda df: df.select(*ROW_ID, _row("t", V("year"), V("mileage"), F.floor("engine_size"), V("fuel_type"), V("transmission")), _row("c", F.lit(1997), F.when(V("line") != 2, 90000.0), F.lit(2), F.lit("A"), F.lit("O"))).select(*ROW_ID, comparables.similarity().alias("similarity")),
    f""" select {ID}, greatest(0.25e0, 1 - abs(year - 1997) * 0.14e0) * case when line = 2 then 0.85e0 else greatest(0.35e0, 1 - abs(mileage - 90000) / 200000) end * case when floor(engine_size) <> 2 then greatest(0.3e0, 0.85e0 - 0.15e0 * abs(floor(engine_size) - 2)) else 1e0 end
 * case when fuel_type <> 'A' then 0.7e0 else 1e0 end * case when transmission <> 'O' then 0.85e0 else 1e0 end as similarity from listings""", "similarity")
_FUELS = {"A": "diesel", "N": "eletrico", "R": "gasolina"}
on_listings("op_v05_fuel_factor", lambda df: df.select(*ROW_ID, comparables.fuel_factor(F.coalesce(*[F.when(V("fuel_type") == k, v) for k, v in _FUELS.items()]), F.when(V("line") > 3, "hibrido").otherwise("diesel")).alias("factor")),
    f" select {ID}, greatest(0.8e0, least(1.25e0, case fuel_type when 'A' then 0.88e0 when 'N' then 1.3e0 else 1e0 end / case when line > 3 then 1.12e0 else 0.88e0 end)) as factor from listings", "factor")
on_listings("op_v32_market_estimate", lambda df: markets.market_estimate(df, ["make", "model"], "year", "price", "mileage").select(*ROW_ID, "estimate", "confidence", "discount", "sample"),
    f""", g as (select make, model, year, sum(price) as sp, sum(mileage) as sk, count(*) as c from listings group by all), m as (select make, model, year, sum(sp) over w / sum(c) over w as p, sum(sk) over w / sum(c) over w as k, (sum(c) over w)::bigint as n from g window w as (partition by make, model order by year range between 2 preceding and 2 following)),
e as (select l.*, n, p * case when mileage < k * 0.5 then 1.1e0 when mileage > k * 1.5 then 0.9e0 else 1e0 end as estimate from listings l join m on l.make = m.make and l.model = m.model and l.year = m.year)
select {ID}, estimate, least(n / 10, 1e0) as confidence, (estimate - price) / estimate as discount, n as sample from e""", "estimate confidence discount")
on_listings("op_v32_mileage_grade", lambda df: df.select(markets.mileage_grade(V("mileage"), 1998 - V("year")).alias("g")).groupBy("g.grade", "g.score").agg(F.count(F.lit(1)).alias("n")),
    """, r as (select 1998 - year as age, mileage / nullif((1998 - year) * 15000, 0) as r from listings) select case when age <= 0 then 'unknown' when r <= 0.5 then 'excellent' when r <= 0.7 then 'good' when r <= 0.9 then 'fair' when r <= 1.1 then 'average' else 'poor' end as grade,
 case when age <= 0 then 0 when r <= 0.5 then 100 when r <= 0.7 then 80 when r <= 0.9 then 60 when r <= 1.1 then 40 else 20 end as score, count(*) as n from r group by all""")
BRANDS = {"brand#1": "Brand#1", "brand#2": "Second", "brand 3": "Third"}
on_listings("op_n08_brand_name", lambda df: df.select(markets.brand_name(F.when(V("make") == "Brand#3", " BRAND-3 ").when(V("make") == "Brand#4", " ").otherwise(V("make")), BRANDS).alias("b")).groupBy("b.brand", "b.confidence").agg(F.count(F.lit(1)).alias("n")),
    """ select case make when 'Brand#2' then 'Second' when 'Brand#3' then 'Third' when 'Brand#4' then null else make end as brand, case make when 'Brand#1' then 1e0 when 'Brand#2' then 0.95e0 when 'Brand#3' then 0.95e0 when 'Brand#4' then 0e0 else 0.5e0 end as confidence, count(*) as n from listings group by all""", "confidence")
register("op_j13_probe", lambda spark, d: markets.probe(table(spark, d, "orders").where("o_orderstatus = 'F'").select(V("o_custkey").alias("c_custkey")), table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"]).groupBy("c_mktsegment", "exists").agg(F.count(F.lit(1)).alias("n")),
         "select c_mktsegment, exists (select 1 from orders where o_orderstatus = 'F' and o_custkey = c_custkey) as \"exists\", count(*) as n from customer group by all")


def _ratios(spark, d):
    """Matcher ratio of each part name against one name; one call of Python a distinct name."""
    ratio = F.pandas_udf(lambda s: pd.Series([matching.matcher_ratio(x, "red widget") for x in s]), "double")
    return rounded(table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).withColumn("ratio", ratio("p_name")))


register("op_x17_matcher_ratio", _ratios)
on_listings("op_n17_evaluation",
    lambda df: _med(df).withColumn("label", rules.opportunity_label(V("price"), V("med"), V("med") * 0.85, V("med") * 1.15, V("comps") / 8, V("comps")))
    .withColumn("score", estimates.bounded_score((V("med") - V("price")) / V("med") * 100, V("comps") / 8, V("label") == "requer_validacao")).withColumn("tier", decisions.confidence_tier(V("comps") / 8)).groupBy("label", "tier").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")),
    MED + """, x as (select *, comps / 8 as conf, (med - price) / med * 100 as off, med * 0.85e0 as lo, med * 1.15e0 as hi from m),
l as (select *, case when not (price between 300 and 2000000 and price / med between 0.2 and 3.0) then 'dados_insuficientes' when price < lo then case when (lo - price) / lo * 100 > 30 then 'requer_validacao' when off >= 12 and conf >= 0.45 and comps >= 6 then 'excelente_oportunidade' when conf < 0.25 or comps < 3 then 'requer_validacao' else 'boa_oportunidade' end
 when price > hi then case when (price - hi) / hi * 100 > 10 then 'muito_acima_do_mercado' else 'ligeiramente_acima' end when comps < 3 or conf < 0.2 then 'requer_validacao' else 'dentro_do_mercado' end as label from x),
s as (select *, case when conf >= 0.65 then 0e0 when conf >= 0.45 then 2e0 when conf >= 0.25 then 3.5e0 else 4.5e0 end as a, case when conf >= 0.65 then 10e0 when conf >= 0.45 then 8e0 when conf >= 0.25 then 6.5e0 else 5.5e0 end as b from l),
t as (select *, greatest(a, least(case when label = 'requer_validacao' then least(b, 6e0) else b end, 5 + greatest(-5e0, least(5e0, off / 6)))) as score from s)
select label, case when conf >= 0.65 then 'alta' when conf >= 0.45 then 'media' when conf >= 0.2 then 'baixa' else 'sem_dados' end as tier, count(*) as n, avg(score) as mean_score from t group by all""", "mean_score")
