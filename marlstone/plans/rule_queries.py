"""Queries of rule counts, guards, rejects, quality scores, price evidence and opportunity labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import rules
from marlstone.plans.domain_queries import MED, _med
from marlstone.plans.market_queries import ROW_ID, on_listings

ID = ", ".join(ROW_ID)
V = F.col


def on_rules(name: str, prepare, given, sql_from: str, each: dict[str, str]) -> None:
    sql = " union all ".join(f"select '{k}' as rule, count(*) filter ({v}) as n from x" for k, v in each.items())
    on_listings(name, lambda df: rules.violation_counts(prepare(df), given()), f", x as (select * replace ({sql_from}) from listings) {sql}")


on_rules("op_q02_consistency", lambda df: df.withColumn("year", F.when(V("line") == 7, 1890).when(V("line") == 6, 1989).otherwise(V("year"))), lambda: rules.consistency_rules(1995),
         "case line when 7 then 1890 when 6 then 1989 else year end as year", {"future_years": "year > 1996", "impossible_years": "year < 1900", "high_mileage": "mileage > (1995 - year) * 30000", "old_expensive": "year < 1990 and price > 50000"})
on_rules("op_q04_business_rules", lambda df: df, lambda: rules.business_rules(2001), "year as year",
         {"high_price_per_km": "price / (mileage + 1) > 0.1", "high_price_per_year": "price / nullif(2002 - year, 0) > 50000", "high_price_per_litre": "price / nullif(engine_size, 0) > 100000", "luxury": "price > 50000", "budget": "price < 5000"})
_CASED = lambda c, m: f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in m.items()) + f" else {c} end as {c}"
_COND, _FUEL, _BOX = {"1-URGENT": "Poor", "5-LOW": "Excellent"}, {"A": "Electric"}, {"O": "Automatic"}
_swap = lambda df, c, m: df.withColumn(c, F.coalesce(*[F.when(V(c) == k, v) for k, v in m.items()], V(c)))
on_rules("op_q05_logic_rules", lambda df: _swap(_swap(_swap(df, "condition", _COND), "fuel_type", _FUEL), "transmission", _BOX).withColumn("year", V("year") - 5), rules.logic_rules,
         f"{_CASED('condition', _COND)}, {_CASED('fuel_type', _FUEL)}, {_CASED('transmission', _BOX)}, year - 5 as year",
         {"poor_condition_expensive": "condition = 'Poor' and price > 30000", "excellent_condition_cheap": "condition = 'Excellent' and price < 5000", "electric_large_engine": "fuel_type = 'Electric' and engine_size > 3", "old_automatic": "year < 1990 and transmission = 'Automatic'"})
on_listings("op_q05_spread_outliers", lambda df: rules.spread_outliers(df, "location", "price", 1.8),
            ", x as (select location, abs(price - avg(price) over w) > 1.8 * stddev_samp(price) over w as far from listings window w as (partition by location)) select location, count(*) as n from x where far group by location")
SCHEMA = {
    "make": {"required": True, "pattern": "^Brand#[1-4][1-5]$"}, "source": {"required": True, "enum": ["ASIA", "EUROPE", "AMERICA"]}, "price": {"min": 2000, "max": 50000},
    "version": {"min_length": 15, "max_length": 40}, "year": {"min": 1993, "max": 1997},
}
_CHECKS = {
    "make:required": "make is null", "make:pattern": "not regexp_matches(make, '^Brand#[1-4][1-5]$')", "source:required": "source is null", "source:enum": "source not in ('ASIA', 'EUROPE', 'AMERICA')", "price:min": "price < 2000",
    "price:max": "price > 50000", "version:min_length": "length(version) < 15", "version:max_length": "length(version) > 40", "year:min": "year < 1993", "year:max": "year > 1997",
}
on_listings("op_q06_schema", lambda df: rules.schema_violations(df, SCHEMA),
            " " + " union all ".join(f"select '{k.split(':')[0]}' as \"column\", '{k.split(':')[1]}' as \"check\", count(*) filter ({v}) as n from listings" for k, v in _CHECKS.items()))

# --- guard
_TEXTS = {1: "Vendo desde 199 €/mês", 2: "Salvado, para peças", 3: "Carro acidentado, motor gripado", 4: "Trotinete elétrica", 5: "Preço sob consulta + IVA"}
_title = lambda: F.coalesce(*[F.when(V("line") == k, t) for k, t in _TEXTS.items()], F.when(V("line") == 6, V("version")))
_TITLE = "case line " + " ".join(f"when {k} then '{t}'" for k, t in _TEXTS.items()) + " when 6 then version end"
_PRICE = "case when fuel_type = 'N' and transmission = 'F' then 999 when fuel_type = 'A' then price / 20 else price end"
_price = lambda: F.when((V("fuel_type") == "N") & (V("transmission") == "F"), 999).when(V("fuel_type") == "A", V("price") / 20).otherwise(V("price"))
_KM = "case when line = 7 then 100 when fuel_type = 'R' then mileage * 20 else mileage end"
_km = lambda: F.when(V("line") == 7, 100).when(V("fuel_type") == "R", V("mileage") * 20).otherwise(V("mileage"))
_text = lambda a: F.array_join(a, ",")
_SQL_FOUND = lambda t: "list_filter([" + ", ".join(f"case when {' or '.join(f'''contains(t, '{w}')''' for w in ws)} then '{k}' end" for k, ws in t.items()) + "], lambda z: z is not null)"
_OWN = lambda *cs: "list_filter([" + ", ".join(cs) + "], lambda z: z is not null)"
_TIDY = lambda *parts: "coalesce(array_to_string(list_sort(list_distinct(" + " || ".join(parts) + ")), ','), '')"
on_listings("op_q08_guard",
    lambda df: _med(df).select(*ROW_ID, rules.guard(_title(), F.lit(None).cast("string"), _price(), V("year"), _km(), F.when(V("line") != 6, V("make")), V("model"), V("location"), V("med"), 2004).alias("g"))
    .select(*ROW_ID, *[_text(f"g.{k}").alias(k) for k in ("blocking", "suspicious", "warnings")], "g.price_is_total"),
    MED + f""", x as (select *, {_TITLE} as title, ({_PRICE})::double as pr, ({_KM})::double as k from m),
y as (select *, translate(lower(coalesce(title, '')), '{rules.fields.ACCENTED}', '{rules.fields.PLAIN}') as t, pr / med as ratio, greatest(1, 2004 - year) as age,
 case when pr <= 0 then 'preco_ausente' when pr in {rules.PLACEHOLDERS} then 'preco_placeholder' when pr < 300 then 'preco_abaixo_do_minimo' end as off from x),
z as (select *, {_SQL_FOUND(rules.PARTIAL)} as partial from y)
select {ID}, {_TIDY('partial', _SQL_FOUND(rules.BLOCKING_DAMAGE), _SQL_FOUND(rules.NOT_CAR), _OWN('off', "case when ratio < 0.12 then 'preco_e_fracao_do_valor' end", "case when k > 1500000 then 'km_impossivel' end", "case when line = 6 then 'marca_ausente' end"))} as blocking,
 {_TIDY(_SQL_FOUND(rules.SUSPECT_DAMAGE), _OWN("case when ratio >= 0.12 and ratio < 0.35 then 'preco_muito_abaixo_da_referencia' when ratio > 4 then 'preco_muito_acima_da_referencia' end", "case when k > 90000 * age then 'km_incompativel_com_idade' when age >= 8 and k < 1000 then 'km_implausivelmente_baixo' end"))} as suspicious,
 {_TIDY(_OWN("case when title is null then 'titulo_ausente' end"))} as warnings, len(partial) = 0 and off is null and ratio >= 0.12 as price_is_total from z""")
_BRAND = "case line when 4 then 'moto' when 5 then '12.5' when 6 then ' ' else make end"
on_listings("op_q11_reject",
    lambda df: df.select(rules.reject_reason(F.when(V("line") == 1, V("price") / 1000).when(V("line") == 2, V("price") * 100).otherwise(V("price")), F.when(V("line") == 3, 1940).otherwise(V("year")), V("mileage") * 2,
                                             F.when(V("line") == 4, "moto").when(V("line") == 5, "12.5").when(V("line") == 6, " ").otherwise(V("make")), V("version"), 1997).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    f""", x as (select *, case line when 1 then price / 1000 when 2 then price * 100 else price end as p, case when line = 3 then 1940 else year end as y, mileage * 2 as k, {_BRAND} as b from listings)
select case when p < 50 and y > 1990 then 'price_too_low' when p > 500000 then 'fantasy_price' when y < 1950 or y > 1998 then 'invalid_year' when k > 800000 and y > 1980 then 'unrealistic_km'
 when 1997 - y >= 2 and k > (1997 - y) * 50000 then 'implausible_km' when trim(b) = '' or b = 'moto' then 'invalid_brand' when b = '12.5' then 'numeric_brand' end as reason, count(*) as n from x group by 1""")

# --- scores
on_listings("op_q09_completeness", lambda df: df.withColumn("km", F.when(V("line") != 3, V("mileage"))).select(*ROW_ID, rules.completeness_score(["make", "model", "price", "km", "location"], F.when(V("line") > 4, V("version")), F.when(V("line") == 3, "x")).alias("score")),
            f" select {ID}, least(1e0, case when line = 3 then 0.8e0 + 0.1e0 else 1e0 end + case when line > 4 then 0.1e0 else 0e0 end) as score from listings", "score")
on_listings("op_q10_listing_score",
    lambda df: df.select(*ROW_ID, rules.listing_score(F.when(V("line") != 1, F.substring("version", 1, 6 * 2)), F.when(V("line") > 2, F.concat("version", "seller")), F.when(V("line") % 2 == 0, "i"),
                                                      [V("make"), F.when(V("line") != 5, V("model")), V("price")], V("price"), V("year"), V("location"), 2001).alias("score")),
    f""", x as (select *, case when line > 2 then length(version || seller) else 0 end as d, 2001 - year as age, case when line <> 1 then length(substr(version, 1, 12)) else 0 end as t from listings)
select {ID}, least(10e0, case when t between 10 and 100 then 2 when t >= 5 then 1 else 0 end + case when d >= 50 then 2 when d >= 20 then 1 else 0 end + case when line % 2 = 0 then 1 else 0 end
 + case when line = 5 then 4e0 / 3 else 2e0 end + case when age <= 1 and price between 10000 and 50000 or age <= 5 and price between 5000 and 30000 or age <= 10 and price between 2000 and 20000 or age > 10 and price between 1000 and 10000 then 2e0 else 0.5e0 end
 + case when length(location) >= 5 then 1 else 0 end) as score from x""", "score")
on_listings("op_q15_combined_score",
    lambda df: df.select(*ROW_ID, rules.combined_score(F.when(V("line") != 2, V("mileage") / 20000), F.when(V("line") != 3, V("engine_size") * 2), V("fuel_type") != "N", F.when(V("line") != 4, V("line") / 8)).alias("score")),
    f""", x as (select *, case when line <> 2 then mileage / 20000 else 5e0 end as b from listings), y as (select *, case when line <> 3 then b * 0.7e0 + engine_size * 2 * 0.3e0 else b end as c from x)
select {ID}, greatest(0e0, least(10e0, c * case when fuel_type = 'N' then 0.5e0 else 1e0 end * case when line <> 4 then 0.5e0 + line / 8 * 0.5e0 else 1e0 end)) as score from y""", "score")

# --- price evidence and labels
_CASES = {1: ("", ",50 €"), 2: ("desde ", " €/mês"), 3: ("USD ", ""), 4: ("Peugeot A", ""), 5: ("", ""), 6: ("licitação inicial ", " EUR"), 7: ("-", " euros")}
_raw = lambda: F.concat(F.coalesce(*[F.when(V("line") == k, a) for k, (a, _) in _CASES.items()]), F.floor("price").cast("bigint").cast("string"), F.coalesce(*[F.when(V("line") == k, b) for k, (_, b) in _CASES.items()]))
on_listings("op_q16_price_evidence", lambda df: df.select(*ROW_ID, rules.price_evidence(_raw()).alias("e")).select(*ROW_ID, "e.*"),
    f""" select {ID}, case line when 1 then floor(price) + 0.5 when 4 then null when 7 then -floor(price) else floor(price) end as value, case line when 3 then 'USD' when 4 then null else 'EUR' end as currency,
 case line when 2 then 'monthly' when 4 then 'unknown' when 6 then 'auction_start' else 'total' end as kind,
 case line when 2 then 'preco_monthly_nao_retail' when 3 then 'moeda_nao_eur' when 4 then 'preco_sem_evidencia_monetaria' when 6 then 'preco_auction_start_nao_retail' when 7 then 'preco_zero_ou_negativo' end as rejection from listings""", "value")
on_listings("op_v22_labels",
    lambda df: _med(df).select(*ROW_ID, rules.opportunity_label(V("price"), F.when(V("line") != 5, V("med")), V("med") * 0.85, F.when(V("line") != 4, V("med") * 1.15), V("comps") / 8, V("comps"), V("line") == 6).alias("label")),
    MED + f""", x as (select *, case when line <> 4 then med * 1.15e0 else med * 1.1e0 end as hi, med * 0.85e0 as lo, comps / 8 as conf from m)
select {ID}, case when line = 6 then 'suspeito' when line = 5 or not (price between 300 and 2000000 and price / med between 0.2 and 3.0) then 'dados_insuficientes'
 when price < lo then case when (lo - price) / lo * 100 > 30 then 'requer_validacao' when (med - price) / med * 100 >= 12 and conf >= 0.45 and comps >= 6 then 'excelente_oportunidade' when conf < 0.25 or comps < 3 then 'requer_validacao' else 'boa_oportunidade' end
 when price > hi then case when (price - hi) / hi * 100 > 10 then 'muito_acima_do_mercado' else 'ligeiramente_acima' end when comps < 3 or conf < 0.2 then 'requer_validacao' else 'dentro_do_mercado' end as label from x""")
