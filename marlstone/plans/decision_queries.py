"""Queries of gates, highest prices, realism audits, decision blocks and routed predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import decisions, economics
from marlstone.operators.decisions import ASK_TO_DEAL
from marlstone.plans.domain_queries import MED, _med
from marlstone.plans.economics_queries import CONDITION, _from
from marlstone.plans.market_queries import ROW_ID, on_listings

ID = ", ".join(ROW_ID)
V = F.col
NONE = lambda: F.lit(None).cast("double")
MOTO, DAYS = lambda: V("transmission") == "O", lambda: V("line") * 15
WORK = f"{_from(CONDITION, economics.RECONDITIONING, '5500e0')} * case when transmission = 'O' then 0.45e0 else 1e0 end"
FIXED = "55.3e0 + case when transmission = 'O' then 22e0 else 32e0 end"
SELLING = "({0} * 0.025e0 * case when transmission = 'O' then 0.6e0 else 1e0 end + {0} * 0.06e0 * line * 15 / 365)"

# --- gates
_gates = lambda df: decisions.gates(
    F.when(V("line") != 3, F.least(F.lit(1.0), V("comps") / 5)), V("med") - V("price") - 500, V("line") * 12.0, F.when(V("line") != 4, V("line") / 10), (V("med") - V("price")) / V("med") * 100, V("price"), V("med") * 0.98
)
GATES_SQL = """, a as (select *, case when line <> 3 then least(1e0, comps / 5) end as conf, med - price - 500 as profit, line * 12e0 as risk,
 case when line <> 4 then line / 10e0 end as repair, (med - price) / med * 100 as off, med * 0.98e0 as most from m),
g as (select *, case when conf is null or conf < 0.6 then 3 end as g1, case when profit <= 0 then 0 when profit < 1000 then 3 end as g2, case when risk > 70 then 0 end as g3,
 case when repair > 0.5 then 1 end as g4, case when off > 55 then 0 end as g5, case when price <= most then 4 when (price - most) / most * 100 <= 10 then 2 else 0 end as g6 from a)
"""
on_listings(
    "op_v23_gates",
    lambda df: _med(df).select(*ROW_ID, _gates(df).alias("g")).select(*ROW_ID, "g.verdict", F.array_join("g.failed", ",").alias("failed")),
    MED + GATES_SQL + f"""select {ID}, ['PASS', 'REVIEW', 'NEGOTIATE', 'WATCH', 'BUY'][least(g1, g2, g3, g4, g5, g6) + 1] as verdict,
 concat_ws(',', case when g1 < 4 then 'confidence' end, case when g2 < 4 then 'profit' end, case when g3 < 4 then 'risk' end, case when g4 < 4 then 'repair' end,
 case when g5 < 4 then 'discount' end, case when g6 < 4 then 'price' end) as failed from g""",
)

# --- highest price
MOST_SQL = f""", x as (select *, round(med * 0.95e0 * 0.97e0, 2) as out_value, {WORK} as work, {FIXED} as fixed from m),
l as (select *, out_value - {SELLING.format('out_value')} as rest from x),
b as (select *, least(rest - 1000, rest / 1.12e0) as most from l),
p as (select *, case when most - fixed - work >= work / 0.45e0 then most - fixed - work else (most - fixed) / 1.45e0 end as top from b),
h as (select *, case when med > 0 and top >= 0.01e0 then top end as max_buy from p)
"""
on_listings(
    "op_v24_max_buy_price",
    lambda df: _med(df).select(*ROW_ID, decisions.max_buy_price(V("med"), V("engine_size") * 2, MOTO(), NONE(), DAYS()).alias("max_buy")),
    MED + MOST_SQL + f"select {ID}, max_buy from h", "max_buy",
)
on_listings(
    "op_n16_decision",
    lambda df: _med(df).select(*ROW_ID, decisions.decision(V("price"), V("med"), F.least(F.lit(1.0), V("comps") / 5), V("line") * 12.0, V("engine_size") * 2, MOTO(), DAYS()).alias("d")).select(*ROW_ID, "d.*"),
    MED + MOST_SQL + f""", d as (select *, med - price - fixed - least(work, price * 0.45e0) - {SELLING.format('med')} as profit from h),
e as (select *, case when least(1e0, comps / 5) < 0.6 then 3 end as g1, case when profit <= 0 then 0 when profit < 1000 then 3 end as g2, case when line * 12e0 > 70 then 0 end as g3,
 case when (med - price) / med * 100 > 55 then 0 end as g5, case when price <= max_buy then 4 when (price - max_buy) / max_buy * 100 <= 10 then 2 when max_buy is not null then 0 end as g6 from d)
select {ID}, max_buy, case when price <= max_buy then 'BUY_ZONE' when price <= max_buy * 1.1e0 then 'NEGOTIATE' else 'PASS' end as buy, profit,
 ['PASS', 'REVIEW', 'NEGOTIATE', 'WATCH', 'BUY'][coalesce(least(g1, g2, g3, g5, g6), 0) + 1] as gates from e""",
    "max_buy profit",
)

# --- realism
_SLOW = lambda days: f"case when {days} <= 30 then 0e0 when {days} <= 60 then 0.02e0 when {days} <= 90 then 0.04e0 else 0.07e0 end"
on_listings(
    "op_v25_sale_price",
    lambda df: _med(df).select(*ROW_ID, decisions.sale_price(V("med"), F.when(V("fuel_type") == "A", "profissional").when(V("fuel_type") == "N", "particular"), DAYS(),
                                                            F.when(V("line") == 1, "total").when(V("line") == 2, "cosmetico")).alias("sale")),
    MED + f""" select {ID}, round(med * greatest(0.25e0, 1 - case fuel_type when 'A' then {ASK_TO_DEAL['profissional']}e0 when 'N' then {ASK_TO_DEAL['particular']}e0 else 0.06e0 end
 - {_SLOW('line * 15')} - case line when 1 then 0.3e0 when 2 then 0.05e0 else 0e0 end), 2) as sale from m""",
    "sale",
)
_AFTER = lambda s: f"({s} - cost - {SELLING.format(s)} - greatest(0e0, {s} - cost) * 0.23e0 / 1.23e0)"
on_listings(
    "op_v25_realism",
    lambda df: _med(df).withColumn("cost", V("price") + economics.acquisition_costs(V("price"), V("engine_size") * 2, MOTO(), NONE()))
    .select(*ROW_ID, decisions.realism(V("price"), V("med") * 1.5, V("med") * 1.2, V("med") * 1.7, V("comps") / 10, V("comps") + 3, V("cost"), DAYS(), MOTO()).alias("r")).select(*ROW_ID, "r.*"),
    MED + f""", c as (select *, price + {FIXED} + least({WORK}, price * 0.45e0) as cost, med * 1.5e0 as est, comps / 10 as conf, comps + 3 as k from m),
s as (select *, round(est * greatest(0.25e0, 1 - 0.07e0 - {_SLOW('line * 15')}), 2) as s1, round(med * 1.2e0 * greatest(0.25e0, 1 - 0.07e0 - {_SLOW('line * 15')}), 2) as s2 from c),
n as (select *, {_AFTER('s1')} as net, {_AFTER('s2')} as worst_case from s), r as (select *, net / cost * 100 as roi from n)
select {ID}, case when (k < 5)::int + ((med * 1.7e0 - med * 1.2e0) / est > 0.45)::int + (conf < 0.35)::int >= 2 then 'indeterminado' when roi > 60 or (est - price) / est > 0.55 then 'suspeito'
 when net < 0 then 'sem_margem' when net < 750 or worst_case < 0 then 'marginal' else 'negocio' end as verdict, net, worst_case, roi from r""",
    "net worst_case roi",
)
on_listings(
    "op_n15_tiers",
    lambda df: _med(df).select(decisions.confidence_tier(V("comps") / 10).alias("tier"),
                               decisions.publishable(V("price"), V("med"), V("comps") / 4, V("comps"), F.when(V("fuel_type") == "A", "quarantine").otherwise("valid")).alias("publishable"))
    .groupBy("tier", "publishable").agg(F.count(F.lit(1)).alias("n")),
    MED + """ select case when comps / 10 >= 0.65 then 'alta' when comps / 10 >= 0.45 then 'media' when comps / 10 >= 0.2 then 'baixa' else 'sem_dados' end as tier,
 comps >= 3 and comps / 4 >= 0.45 and fuel_type <> 'A' as publishable, count(*) as n from m group by all""",
)
on_listings(
    "op_m11_routed",
    lambda df: _med(df).select(*ROW_ID, decisions.routed(V("med"), F.when(V("line") != 2, V("med") * 0.9), V("med") * 1.1, 30000, 40000).alias("predicted")),
    MED + f" select {ID}, case when med < 30000 and line <> 2 then med * 0.9e0 when med > 40000 then med * 1.1e0 else med end as predicted from m", "predicted",
)
