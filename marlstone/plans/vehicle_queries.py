"""Queries of canonical vehicles: titles are built from the line number, so that SQL can state what each must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import vehicles
from marlstone.plans.market_queries import ROW_ID, on_listings

ID = ", ".join(ROW_ID)
V = F.col
TITLES = {
    1: ("Mercedes A 45 S AMG", "high_performance", 3, 0.9, "unknown"), 2: ("BMW 320d M Sport plug-in", "sport_trim", 1, 0.9, "phev"), 3: ("Porsche Macan 2.0 gasóleo", "performance", 2, 0.55, "diesel"),
    4: ("Audi S3 TFSI", "performance", 2, 0.9, "gasolina"), 5: ("Porsche 911 Turbo S", "supercar", 4, 0.9, "unknown"), 6: ("Clio 1.5 dCi", "base", 0, 0.6, "diesel"), 7: ("n/a", "base", 0, 0.35, "unknown"),
}
_title = lambda: F.coalesce(*[F.when(V("line") == k, t[0]) for k, t in TITLES.items()])


def _case(i: int, kind: str = "") -> str:
    return "case line " + " ".join(f"when {k} then " + (f"'{t[i]}'" if isinstance(t[i], str) else f"{t[i]}{kind}") for k, t in TITLES.items()) + " end"


on_listings("op_x12_performance_class", lambda df: df.select(*ROW_ID, vehicles.performance_class(_title(), F.when(V("line") > 5, V("version"))).alias("p")).select(*ROW_ID, "p.*"),
            f" select {ID}, {_case(1)} as performance, ({_case(2)})::int as rank, case when line = 7 then 0.6e0 else {_case(3, 'e0')} end as confidence from listings", "confidence")
on_listings("op_x12_fuel_class", lambda df: df.select(*ROW_ID, vehicles.fuel_class(F.when(V("fuel_type") == "N", "Híbrido (Gasolina)"), _title()).alias("fuel")),
            f" select {ID}, case when fuel_type = 'N' then 'hibrido' else {_case(4)} end as fuel from listings")
on_listings("op_x12_fuels_compare", lambda df: df.select(vehicles.fuels_compare(F.when(V("fuel_type") == "N", "hibrido").when(V("fuel_type") == "A", "diesel").otherwise("unknown"), vehicles.fuel_class(_title())).alias("ok"), "fuel_type", "line").groupBy("ok", "fuel_type", "line").agg(F.count(F.lit(1)).alias("n")),
            f", x as (select fuel_type, line, {_case(4)} as f from listings) select case fuel_type when 'N' then false when 'A' then f in ('diesel', 'gasolina') else f = 'unknown' end as ok, fuel_type, line, count(*) as n from x group by all")
on_listings("op_x13_model_name", lambda df: df.select(*ROW_ID, vehicles.model_name(V("make"), F.concat("make", F.lit("  "), "version", F.lit(" 1.5 5p 2015"))).alias("name")), f" select {ID}, lower(version) as name from listings")
