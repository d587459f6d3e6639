"""Vehicle taxes and costs from bracket tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = float("inf")
#: Ceiling, rate and deduction of each bracket.
DISPLACEMENT = ((1000, 1.09, 849.03), (1250, 1.18, 850.69), (TOP, 5.61, 6194.88))
CO2 = {
    ("petrol", "nedc"): ((99, 4.62, 427.00), (115, 8.09, 750.99), (145, 52.56, 5903.94), (175, 61.24, 7140.17), (195, 155.97, 23627.27), (TOP, 205.65, 33390.12)),
    ("petrol", "wltp"): ((110, 0.44, 43.02), (115, 1.10, 115.80), (120, 1.38, 147.79), (130, 5.27, 619.17), (145, 6.38, 762.73), (175, 41.54, 5819.56), (195, 51.38, 7247.39), (235, 193.01, 34190.52), (TOP, 233.81, 41910.96)),
    ("diesel", "nedc"): ((79, 5.78, 439.04), (95, 23.45, 1848.58), (120, 79.22, 7195.63), (140, 175.73, 18924.92), (160, 195.43, 21720.92), (TOP, 268.42, 33447.90)),
    ("diesel", "wltp"): ((110, 1.72, 11.50), (120, 18.96, 1906.19), (140, 65.04, 7360.85), (150, 127.40, 16080.57), (160, 160.81, 21176.06), (170, 221.69, 29227.38), (190, 274.08, 36987.98), (TOP, 282.35, 38271.32)),
}
#: Ceiling and flat tax of motorcycles; ceiling in years and share taken off used imports.
MOTORCYCLE = ((119, 0.00), (250, 73.78), (350, 91.63), (500, 122.57), (750, 184.45), (TOP, 245.14))
AGE_REDUCTION = ((0, 0.0), (1, 0.10), (2, 0.20), (3, 0.28), (4, 0.35), (5, 0.43), (6, 0.52), (7, 0.60), (8, 0.65), (9, 0.70), (10, 0.75), (TOP, 0.80))
#: Share of the tax that is due; surcharge of diesels without a clean filter figure.
PAYABLE = {"phev": 0.25, "hibrido": 0.60, "gnc": 0.40}
DIESEL_SURCHARGE = 500.0


def bracket(c: Column, table: tuple, k: int = 1) -> Column:
    """Column ``k`` of the first bracket whose ceiling is not below the value; the last bracket beyond all, null for null."""
    out = F.lit(float(table[-1][k]))
    for row in reversed(table[:-1]):
        out = F.when(c <= row[0], float(row[k])).otherwise(out)
    return F.when(c.isNotNull(), out)


def linear(c: Column, table: tuple) -> Column:
    """Bracket tax: value times rate less deduction, not below zero."""
    return F.greatest(F.lit(0.0), c * bracket(c, table) - bracket(c, table, 2))


def registration_tax(cc: Column, co2: Column, fuel: Column, age: Column, wltp: Column, motorcycle: Column | None = None) -> Column:
    """Tax at the first registration; electric vehicles are exempt, a null or zero CO2 figure adds nothing, a null age takes nothing off."""
    cc = F.coalesce(cc, F.lit(0))
    diesel = F.coalesce(fuel == "diesel", F.lit(False))
    by_co2 = F.coalesce(*[F.when(diesel == (f == "diesel"), F.when(F.coalesce(wltp, F.lit(False)) == (m == "wltp"), linear(co2, t))) for (f, m), t in CO2.items()])
    car = linear(cc, DISPLACEMENT) + F.when(co2 > 0, by_co2).otherwise(0.0) + F.when(diesel, DIESEL_SURCHARGE).otherwise(0.0)
    gross = car if motorcycle is None else F.when(motorcycle, bracket(cc, MOTORCYCLE)).otherwise(car)
    low = co2.isNull() | (co2 < 50)
    due = F.when((fuel == "phev") & low, PAYABLE["phev"]).when((fuel == "hibrido") & low, PAYABLE["hibrido"]).when(fuel == "gnc", PAYABLE["gnc"]).otherwise(1.0)
    return F.when(fuel == "eletrico", 0.0).otherwise(gross * (1 - F.coalesce(bracket(age, AGE_REDUCTION), F.lit(0.0))) * due)
