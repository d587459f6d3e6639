"""Buying decisions: hard gates, highest price to pay, realistic profit after all costs, publishability, decision blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.operators import economics, fields
from marlstone.operators.economics import RECONDITIONING_CAP

#: Verdicts from the worst to the best.
VERDICTS = ("PASS", "REVIEW", "NEGOTIATE", "WATCH", "BUY")
#: Limits of the gates.
MIN_CONFIDENCE, MIN_PROFIT, MAX_RISK, MAX_REPAIR, MAX_DISCOUNT, WINDOW_PCT = 0.60, 1000.0, 70.0, 0.50, 55.0, 10.0
#: Target profit, least return, safety margin, discount from asking to exit.
TARGET, MIN_ROI, SAFETY, EXIT_DISCOUNT = 1000.0, 0.12, 0.03, 0.05
#: Discount from asking to deal by seller, and by days to sell; VAT; damage.
ASK_TO_DEAL, ASK_TO_DEAL_UNKNOWN = {"profissional": 0.07, "particular": 0.05}, 0.06
LIQUIDITY, LIQUIDITY_SLOW = ((30, 0.0), (60, 0.02), (90, 0.04)), 0.07
VAT, DAMAGE_TOTAL, DAMAGE_COSMETIC, SALE_FLOOR = 0.23, 0.30, 0.05, 0.25
#: Limits of the realism audit.
IMPLAUSIBLE_ROI, IMPLAUSIBLE_DISCOUNT, VIABLE_PROFIT, LEAST_COMPS, WIDEST, LEAST_CONFIDENCE, HARD_USE = 60.0, 0.55, 750.0, 5, 0.45, 0.35, 45000


def gates(confidence: Column, profit: Column, risk: Column, repair: Column, discount_pct: Column, asking: Column, most: Column) -> Column:
    """Struct of the worst verdict and the names of the gates that did not pass.

    Confidence and profit fail when unknown; the other gates are skipped when unknown, and the price gate also for zeros.
    """
    over = (asking - most) / most * 100
    price = F.when((asking != 0) & (most != 0), F.when(asking <= most, 4).when(over <= WINDOW_PCT, 2).otherwise(0))
    each = {
        "confidence": F.when(confidence.isNull() | (confidence < MIN_CONFIDENCE), 3),
        "profit": F.when(profit.isNull() | (profit <= 0), 0).when(profit < MIN_PROFIT, 3),
        "risk": F.when(risk > MAX_RISK, 0),
        "repair": F.when(repair > MAX_REPAIR, 1),
        "discount": F.when(discount_pct > MAX_DISCOUNT, 0),
        "price": price,
    }
    worst = F.coalesce(F.array_min(F.array(*each.values())), F.lit(0))
    failed = F.array_compact(F.array(*[F.when(v < 4, k) for k, v in each.items()]))
    return F.struct(F.element_at(F.array(*map(F.lit, VERDICTS)), worst + 1).alias("verdict"), failed.alias("failed"))


def max_buy_price(value: Column, condition: Column, motorcycle: Column, import_tax: Column, days: Column, repairs: Column | None = None) -> Column:
    """Highest price that leaves the target profit and the least return; null without a value, or if not even a free car does.

    All costs are linear in the price but for the cap of the reconditioning cost, so the price is solved for on either side
    of the cap. ``repairs`` that are given are not capped.
    """
    exit_value = F.round(value * (1 - EXIT_DISCOUNT) * (1 - SAFETY), 2)
    left = exit_value - economics.selling_costs(exit_value, days, motorcycle)["total"]
    most = F.least(left - TARGET, left / (1 + MIN_ROI))  # of what may be spent in all
    nothing = F.lit(None).cast("double")
    fixed = economics.acquisition_costs(nothing, condition, motorcycle, import_tax, repairs=F.lit(0.0))
    work = economics.reconditioning(condition, nothing, motorcycle)
    capped = (most - fixed) / (1 + RECONDITIONING_CAP)
    own = F.when(most - fixed - work >= work / RECONDITIONING_CAP, most - fixed - work).otherwise(capped)
    price = own if repairs is None else F.when(repairs > 0, most - fixed - repairs).otherwise(own)
    return F.when((value > 0) & (price >= 0.01), price)


def sale_price(estimate: Column, seller: Column, days: Column, damage: Column | None = None) -> Column:
    """What an asking-price estimate brings in a deal; ``damage`` is total, any other damage, or null for none. 0 without an estimate."""
    off = F.coalesce(*[F.when(F.lower(seller) == k, v) for k, v in ASK_TO_DEAL.items()], F.lit(ASK_TO_DEAL_UNKNOWN))
    slow = F.coalesce(*[F.when(days <= top, v) for top, v in LIQUIDITY], F.lit(LIQUIDITY_SLOW))
    hurt = F.lit(0.0) if damage is None else F.when(damage.isNull(), 0.0).when(damage == "total", DAMAGE_TOTAL).otherwise(DAMAGE_COSMETIC)
    return F.when(estimate > 0, F.round(estimate * F.greatest(F.lit(SALE_FLOOR), 1 - off - slow - hurt), 2)).otherwise(0.0)


def realism(asking: Column, estimate: Column, low: Column, high: Column, confidence: Column, comps: Column, cost: Column, days: Column, motorcycle: Column) -> Column:
    """Struct verdict, net, worst_case and roi of a deal by a professional; ``cost`` is all that acquiring it costs, price included.

    indeterminado: no price or estimate, or two of few comparables, a wide interval and a low confidence; suspeito: too good;
    sem_margem: a loss; marginal: a small profit, or a loss at the low end of the interval; negocio: else.
    """
    sale = lambda v: sale_price(v, F.lit("profissional"), days)
    nets = lambda s: F.struct(_net(s["usual"], cost, days, motorcycle).alias("usual"), _net(s["low"], cost, days, motorcycle).alias("low"))
    kept = lambda n: F.struct(n["usual"].alias("net"), F.when(low > 0, n["low"]).otherwise(n["usual"]).alias("worst"), F.when(cost > 0, n["usual"] / cost * 100).otherwise(0.0).alias("roi"))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    weak = yes((comps != 0) & (comps < LEAST_COMPS)) + yes((low != 0) & (high != 0) & ((high - low) / estimate > WIDEST)) + yes((confidence != 0) & (confidence < LEAST_CONFIDENCE))
    known = (asking > 0) & (estimate > 0)

    def judged(x: Column) -> Column:
        verdict = (
            F.when(F.coalesce(~known, F.lit(True)) | (weak >= 2), "indeterminado").when((x["roi"] > IMPLAUSIBLE_ROI) | ((estimate - asking) / estimate > IMPLAUSIBLE_DISCOUNT), "suspeito")
            .when(x["net"] < 0, "sem_margem").when((x["net"] < VIABLE_PROFIT) | (x["worst"] < 0), "marginal").otherwise("negocio")
        )
        seen = lambda c, name: F.when(known, c).alias(name)
        return F.struct(verdict.alias("verdict"), seen(x["net"], "net"), seen(x["worst"], "worst_case"), seen(x["roi"], "roi"))

    # a sale is rounded, which is dear, so each step is computed once for a row
    sales = F.struct(sale(estimate).alias("usual"), sale(low).alias("low"))
    return fields.computed_once(fields.computed_once(fields.computed_once(sales, nets), kept), judged)


def _net(sale: Column, cost: Column, days: Column, motorcycle: Column) -> Column:
    """Margin less selling costs and the VAT in it."""
    margin = sale - cost
    return margin - economics.selling_costs(sale, days, motorcycle)["total"] - F.greatest(F.lit(0.0), margin) * VAT / (1 + VAT)


def decision(asking: Column, value: Column, confidence: Column, risk: Column, condition: Column, motorcycle: Column, days: Column) -> Column:
    """Struct of the highest price, the verdict on the asking price, the expected profit and the gates' verdict for a national vehicle."""
    most = max_buy_price(value, condition, motorcycle, F.lit(None).cast("double"), days)
    cost = asking + economics.acquisition_costs(asking, condition, motorcycle, F.lit(None).cast("double"))
    profit = value - cost - economics.selling_costs(value, days, motorcycle)["total"]
    none = F.lit(None).cast("double")
    gate = gates(confidence, profit, risk, none, F.when(value > 0, (value - asking) / value * 100), asking, most)
    return F.struct(most.alias("max_buy"), F.coalesce(economics.buy_verdict(asking, most), F.lit("PASS")).alias("buy"), profit.alias("profit"), gate["verdict"].alias("gates"))


#: Names of confidence tiers from a least confidence upwards.
CONFIDENCE_TIERS = ((0.65, "alta"), (0.45, "media"), (0.20, "baixa"))


def confidence_tier(confidence: Column) -> Column:
    """alta, media, baixa, or sem_dados below all of them and for null."""
    return F.coalesce(*[F.when(confidence >= least, name) for least, name in CONFIDENCE_TIERS], F.lit("sem_dados"))


def publishable(price: Column, value: Column, confidence: Column, n: Column, quality: Column) -> Column:
    """An offer may be shown: it has a price and a value, enough comparables and confidence, and its quality status is valid."""
    return F.coalesce((price > 0) & (value > 0) & (n >= 3) & (confidence >= 0.45) & quality.isin("valid", "valid_with_warning"), F.lit(False))


def routed(value: Column, low: Column, high: Column, below: float, above: float) -> Column:
    """Prediction of the model for its price range: the low model under ``below``, the high one over ``above``, else the full one."""
    return F.when((value < below) & low.isNotNull(), low).when((value > above) & high.isNotNull(), high).otherwise(value)
