"""Rules over listings: violation counts, guards with reasons, hard rejects, quality scores, price evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import clean, fields

#: Bounds of business rules.
PRICE_PER_KM, PRICE_PER_YEAR, PRICE_PER_LITRE, LUXURY, BUDGET = 0.1, 50_000, 100_000, 50_000, 5_000
#: Words that make a price no total.
NOT_TOTAL = (
    ("mensalidade", "preco_mensalidade"), ("/mes", "preco_mensalidade"), ("/mês", "preco_mensalidade"), ("por mes", "preco_mensalidade"), ("euros/mes", "preco_mensalidade"), ("prestacao", "preco_prestacao"),
    ("prestação", "preco_prestacao"), ("mensal", "preco_mensalidade"), ("entrada de", "preco_entrada"), ("entrada inicial", "preco_entrada"), ("valor de entrada", "preco_entrada"), ("sinal de", "preco_sinal"),
    ("desde ", "preco_desde"), ("a partir de", "preco_desde"), ("sob consulta", "preco_sob_consulta"), ("sob-consulta", "preco_sob_consulta"), ("preco a combinar", "preco_sob_consulta"), ("sem iva", "preco_sem_iva"),
    ("s/ iva", "preco_sem_iva"), ("s/iva", "preco_sem_iva"), ("+ iva", "preco_sem_iva"), ("mais iva", "preco_sem_iva"), ("iva dedutivel", "preco_sem_iva"), ("iva discriminado", "preco_sem_iva"),
    ("renting", "preco_renting"), ("leasing", "preco_leasing"), ("aluguer", "preco_aluguer"), ("ald ", "preco_renting"), ("credito obrigatorio", "credito_obrigatorio"),
    ("financiamento obrigatorio", "credito_obrigatorio"), ("retoma obrigatoria", "retoma_obrigatoria"),
)
#: Words that mark a damaged or irregular vehicle, and the labels of these that block.
DAMAGED = (
    ("salvado", "salvado"), ("para pecas", "para_pecas"), ("para peças", "para_pecas"), ("pecas de", "para_pecas"), ("peças de", "para_pecas"), ("desmantelamento", "para_pecas"), ("sucata", "para_pecas"),
    ("para abate", "para_pecas"), ("acidentado", "acidentado"), ("batido", "acidentado"), ("sinistrado", "acidentado"), ("capotado", "acidentado"), ("incendiado", "acidentado"), ("afundado", "acidentado"),
    ("motor fundido", "avaria_grave"), ("motor gripado", "avaria_grave"), ("nao pega", "avaria_grave"), ("não pega", "avaria_grave"), ("nao trabalha", "avaria_grave"), ("avariado", "avaria_grave"),
    ("para restauro", "para_restauro"), ("sem documentos", "sem_documentos"), ("sem livrete", "sem_documentos"), ("documentos em falta", "sem_documentos"), ("penhora", "penhora"), ("penhorado", "penhora"),
    ("apreendido", "penhora"), ("sem legalizacao", "sem_legalizacao"), ("por legalizar", "sem_legalizacao"), ("nao legalizado", "sem_legalizacao"), ("matricula estrangeira", "sem_legalizacao"),
)
BLOCKING_LABELS = ("salvado", "para_pecas", "sem_documentos", "penhora")
#: Words that mark no car, and titles that name no vehicle.
NO_CAR = (
    ("trotinete", "nao_e_automovel"), ("bicicleta", "nao_e_automovel"), ("mota de agua", "nao_e_automovel"), ("jet ski", "nao_e_automovel"), ("barco", "nao_e_automovel"), ("atrelado", "nao_e_automovel"),
    ("reboque", "nao_e_automovel"), ("maquina agricola", "nao_e_automovel"), ("trator", "nao_e_automovel"), ("empilhador", "nao_e_automovel"), ("quadriciclo", "quadriciclo_ou_microcarro"),
    ("microcarro", "quadriciclo_ou_microcarro"), ("sem carta", "quadriciclo_ou_microcarro"), ("ligeiro de mercadorias", "comercial_nao_ligeiro"), ("caixa aberta", "comercial_nao_ligeiro"),
)
GENERIC_TITLE = r"^(carro|viatura|automovel|vendo carro|carro usado|oportunidade|varios|diversos|nacional|bom estado)[\s\W]*$"
PLACEHOLDERS = (1, 10, 99, 100, 111, 123, 500, 999, 1000, 1111, 12345, 99999)
LEAST_PRICE, MOST_PRICE = 300, 2_000_000
#: Brands that may cost over half a million, words that name no brand, and words of parts.
FANTASY = ("Ferrari", "Lamborghini", "Porsche", "McLaren", "Aston Martin", "Bugatti", "Rolls-Royce", "Bentley")
NO_BRAND, PARTS = ("unknown", "venda", "vendo", "mota", "moto"), ("pneu", "vinil", "spray", "capa", "jante", "volante", "banco", "farol")
#: Words that tell the kind of a price, in the order in which kinds are tried.
KINDS = (
    ("auction_start", ("licitacao inicial", "lance inicial", "preco de saida", "preco de partida", "preco minimo", "valor de partida", "valor base", "valor de abertura", "v. abertura", "starting bid", "opening bid", "leilao", "auction")),
    ("auction_current", ("lance atual", "licitacao atual", "current bid")), ("auction_adjudicated", ("adjudicacao", "adjudicado", "preco final", "hammer price")),
    ("monthly", ("/mes", "por mes", "mensalidade", "prestacao", "mensal", "desde ", "a partir de")), ("entry", ("entrada", "sinal", "down payment", "initial payment")), ("installment", ("parcel", "installment")),
)
_AMOUNT = r"[-+]?(?:\d{1,3}(?:[\s.,]\d{3})+(?:[.,]\d{2})?|\d+(?:[.,]\d{1,2})?)"
_SIGN = r"(?:€|EUROS?|EUR|£|GBP|USD|SEK|DKK|CHF|NOK|\$)"


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with the rows that break it; a rule that is null for a row is not broken."""
    cells = [F.struct(F.lit(k).alias("rule"), F.count_if(F.coalesce(v, F.lit(False))).alias("n")) for k, v in rules.items()]
    return df.agg(F.array(*cells).alias("c")).selectExpr("inline(c)")


def consistency_rules(asof_year: int) -> dict[str, Column]:
    y, km, p = F.col("year"), F.col("mileage"), F.col("price")
    return {"future_years": y > asof_year + 1, "impossible_years": y < 1900, "high_mileage": km > (asof_year - y) * 30_000, "old_expensive": (y < 1990) & (p > 50_000)}


def business_rules(asof_year: int) -> dict[str, Column]:
    y, km, p = F.col("year"), F.col("mileage"), F.col("price")
    return {
        "high_price_per_km": p / (km + 1) > PRICE_PER_KM, "high_price_per_year": F.try_divide(p, F.lit(asof_year) - y + 1) > PRICE_PER_YEAR, "high_price_per_litre": F.try_divide(p, F.col("engine_size")) > PRICE_PER_LITRE,
        "luxury": p > LUXURY, "budget": p < BUDGET,
    }


def logic_rules() -> dict[str, Column]:
    p = F.col("price")
    return {
        "poor_condition_expensive": (F.col("condition") == "Poor") & (p > 30_000), "excellent_condition_cheap": (F.col("condition") == "Excellent") & (p < 5_000),
        "electric_large_engine": (F.col("fuel_type") == "Electric") & (F.col("engine_size") > 3), "old_automatic": (F.col("year") < 1990) & (F.col("transmission") == "Automatic"),
    }


def spread_outliers(df: DataFrame, key: str, c: str, sigmas: float = 2.0) -> DataFrame:
    """Rows of each group further than ``sigmas`` sample deviations from its mean, counted; groups without any are left out."""
    w = Window.partitionBy(key)
    x = df.withColumn("_m", F.avg(c).over(w)).withColumn("_s", F.stddev_samp(c).over(w))
    return x.where(F.abs(F.col(c) - F.col("_m")) > sigmas * F.col("_s")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def schema_violations(df: DataFrame, schema: dict[str, dict]) -> DataFrame:
    """(column, check, n) for a declared schema: required, pattern, enum, min, max, min_length, max_length; nulls break required only."""
    rules = {}
    for c, spec in schema.items():
        v = F.col(c)
        checks = {
            "required": lambda s: v.isNull(), "pattern": lambda s: ~v.cast("string").rlike(s), "enum": lambda s: ~v.isin(*s), "min": lambda s: v < s, "max": lambda s: v > s,
            "min_length": lambda s: F.length(v) < s, "max_length": lambda s: F.length(v) > s,
        }
        for check, setting in spec.items():
            rules[f"{c}:{check}"] = checks[check](setting)
    counts = violation_counts(df, rules)
    return counts.select(F.substring_index("rule", ":", 1).alias("column"), F.substring_index("rule", ":", -1).alias("check"), "n")


def labels_of(table: tuple[tuple[str, str], ...], keep=lambda label: True) -> dict[str, list[str]]:
    """Folded words by label, both in the order of the table."""
    out: dict[str, list[str]] = {}
    for word, label in table:
        plain = "".join(PLAIN_OF.get(c, c) for c in word)
        if keep(label) and plain not in out.setdefault(label, []):
            out[label].append(plain)
    return out


PLAIN_OF = dict(zip(fields.ACCENTED, fields.PLAIN))
PARTIAL, NOT_CAR = labels_of(NOT_TOTAL), labels_of(NO_CAR)
BLOCKING_DAMAGE, SUSPECT_DAMAGE = labels_of(DAMAGED, BLOCKING_LABELS.__contains__), labels_of(DAMAGED, lambda label: label not in BLOCKING_LABELS)


def _found(text: Column, table: dict[str, list[str]]) -> Column:
    """Labels of the words that stand in the text."""
    return F.array_compact(F.array(*[F.when(_contains_any(text, words), label) for label, words in table.items()]))


def _contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def guard(title: Column, description: Column, price: Column, year: Column, km: Column, brand: Column, model: Column, place: Column, reference: Column, asof_year: int) -> Column:
    """Struct of blocking, suspicious and warning reasons (sorted, each once) and whether the price is a total."""
    tables = {"partial": PARTIAL, "blocking": BLOCKING_DAMAGE, "no_car": NOT_CAR, "suspect": SUSPECT_DAMAGE}
    texts = F.struct(fields.fold_accents(F.concat_ws(" ", title, description)).alias("text"), F.trim(title).alias("title"))
    words = lambda t: F.struct(*[_found(t["text"], table).alias(k) for k, table in tables.items()], fields.fold_accents(t["title"]).rlike(GENERIC_TITLE).alias("generic"))
    return fields.computed_once(fields.computed_once(texts, words), lambda said: _reasons(said, title, price, year, km, brand, model, place, reference, asof_year))


def _reasons(said: Column, title: Column, price: Column, year: Column, km: Column, brand: Column, model: Column, place: Column, reference: Column, asof_year: int) -> Column:
    """What ``guard`` returns, from the labels of words found (partial, blocking, no_car, suspect, and whether the title is generic)."""
    partial = said["partial"]
    age = F.greatest(F.lit(1), F.lit(asof_year) - year)
    ratio = F.when((reference > 4000) & (price > 0), price / reference)
    off_price = F.when(price.isNull() | (price <= 0), "preco_ausente").when(price.isin(*PLACEHOLDERS), "preco_placeholder").when(price < LEAST_PRICE, "preco_abaixo_do_minimo").when(price > MOST_PRICE, "preco_acima_do_maximo")
    bad_year = (year < 1950) | (year > asof_year + 1)
    b = F.lower(F.trim(F.coalesce(brand, F.lit(""))))
    none = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    blocking = [
        off_price, F.when(ratio < 0.12, "preco_e_fracao_do_valor"), F.when(bad_year, "ano_impossivel"), F.when(~bad_year & (km < 0), "km_negativo"), F.when(km > 1_500_000, "km_impossivel"),
        F.when(b.isin("", "unknown", "outro", "other"), "marca_ausente").when(b.rlike("^[0-9]+$"), "marca_numerica"),
    ]
    suspicious = [
        F.when((ratio >= 0.12) & (ratio < 0.35), "preco_muito_abaixo_da_referencia").when(ratio > 4, "preco_muito_acima_da_referencia"),
        F.when(~bad_year & (km > 90_000 * age), "km_incompativel_com_idade").when(~bad_year & (age >= 8) & (km >= 0) & (km < 1000), "km_implausivelmente_baixo"),
        F.when(said["generic"], "titulo_generico"),
    ]
    warnings = [
        F.when((price > 400_000) & (price <= MOST_PRICE), "preco_muito_elevado"), F.when(year.isNull(), "ano_ausente"), F.when(km.isNull(), "km_ausente"), F.when(none(model), "modelo_ausente"),
        F.when(none(title), "titulo_ausente"), F.when(none(place), "localizacao_ausente"),
    ]
    tidy = lambda *arrays: F.array_sort(F.array_distinct(F.concat(*arrays)))
    own = lambda cs: F.array_compact(F.array(*cs))
    return F.struct(
        tidy(partial, said["blocking"], said["no_car"], own(blocking)).alias("blocking"), tidy(said["suspect"], own(suspicious)).alias("suspicious"), tidy(own(warnings)).alias("warnings"),
        ((F.size(partial) == 0) & off_price.isNull() & F.coalesce(ratio >= 0.12, F.lit(True))).alias("price_is_total"),
    )


def reject_reason(price: Column, year: Column, km: Column, brand: Column, title: Column, asof_year: int) -> Column:
    """First reason to refuse a record, or null."""
    p, b = F.coalesce(price, F.lit(0.0)), F.trim(F.coalesce(brand, F.lit("")))
    age = F.lit(asof_year) - year
    return (
        F.when((p < 50) & (year.isNull() | (year > 1990)), "price_too_low").when((p > 500_000) & ~b.isin(*FANTASY), "fantasy_price").when((year < 1950) | (year > asof_year + 1), "invalid_year")
        .when((km > 800_000) & (year.isNull() | (year > 1980)), "unrealistic_km").when((age >= 2) & (km > age * 50_000), "implausible_km").when((b == "") | F.lower(b).isin(*NO_BRAND), "invalid_brand")
        .when(F.regexp_replace(b, "[.,]", "").rlike("^[0-9]+$"), "numeric_brand").when((p < 500) & fields._any(F.lower(F.coalesce(title, F.lit(""))), PARTS), "not_vehicle")
    )


def completeness_score(required: list[str], description: Column, images: Column) -> Column:
    """Share of set fields, a tenth more for a description and for images, at most 1."""
    share = sum((F.col(c).isNotNull().cast("double") for c in required), F.lit(0.0)) / len(required)
    bonus = lambda c: F.when(F.length(c) > 0, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), share + bonus(description) + bonus(images))


def listing_score(title: Column, description: Column, image: Column, required: list[Column], price: Column, year: Column, place: Column, asof_year: int) -> Column:
    """0 to 10: title and description length, image, completeness, price for the age, place."""
    n, d, age = F.length(title), F.length(description), F.lit(asof_year) - year
    t = F.when(n.between(10, 100), 2.0).when(n >= 5, 1.0).otherwise(0.0)
    text = F.when(d >= 50, 2.0).when(d >= 20, 1.0).otherwise(0.0)
    full = sum((F.when(c.isNotNull(), 1.0).otherwise(0.0) for c in required), F.lit(0.0)) / len(required) * 2
    fair = ((age <= 1) & price.between(10_000, 50_000)) | ((age <= 5) & price.between(5_000, 30_000)) | ((age <= 10) & price.between(2_000, 20_000)) | ((age > 10) & price.between(1_000, 10_000))
    money = F.when(price.isNull() | year.isNull(), 0.0).when(fair, 2.0).otherwise(0.5)
    return F.least(F.lit(10.0), t + text + F.when(F.length(image) > 0, 1.0).otherwise(0.0) + full + money + F.when(F.length(place) >= 5, 1.0).otherwise(0.0))


def combined_score(deal: Column, condition: Column, approved: Column, confidence: Column) -> Column:
    """Deal score (5 if missing or zero), three tenths condition, halved when not approved, scaled by confidence, within 0..10."""
    base = F.when(deal != 0, deal).otherwise(5.0)
    base = F.when(condition != 0, base * 0.7 + condition * 0.3).otherwise(base)
    base = F.when(F.coalesce(~approved, F.lit(False)), base * 0.5).otherwise(base)
    base = F.when(confidence != 0, base * (0.5 + confidence * 0.5)).otherwise(base)
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), base))


def price_evidence(raw: Column, context: Column | None = None) -> Column:
    """Struct value, currency, kind, rejection of a price text: a number bound to a currency, or a plain number taken as euros."""
    text = F.trim(raw)
    after, before = rf"(?i)(?<!\w)({_AMOUNT})\s*({_SIGN})(?!\w)", rf"(?i)({_SIGN})\s*({_AMOUNT})(?!\w)"
    pick = lambda t, bound, front, plain: F.struct(
        t.alias("text"), F.when(bound != "", bound).when(front != "", front).when(plain != "", plain).alias("number"),
        F.upper(F.when(bound != "", F.regexp_extract(t, after, 2)).when(front != "", F.regexp_extract(t, before, 1)).otherwise("EUR")).alias("sign"),
    )
    tried = lambda t: F.struct(t.alias("t"), F.regexp_extract(t, after, 1).alias("bound"), F.regexp_extract(t, before, 2).alias("front"), F.regexp_extract(t, rf"^\s*({_AMOUNT})\s*$", 1).alias("plain"))
    found = fields.computed_once(fields.computed_once(text, tried), lambda x: pick(*[x[k] for k in ("t", "bound", "front", "plain")]))
    said = lambda x: fields.fold_accents(F.concat_ws(" ", x["text"], context) if context is not None else x["text"])
    kind = lambda s: F.coalesce(*[F.when(fields._any(s, words), name) for name, words in KINDS], F.lit("total"))
    read = lambda x: F.struct(x["text"].alias("text"), x["number"].alias("number"), x["sign"].alias("sign"), (clean.number(x["number"]) * F.when(x["number"].startswith("-"), -1).otherwise(1)).alias("value"), fields.computed_once(said(x), kind).alias("kind"))
    return fields.computed_once(fields.computed_once(found, read), _judged)


def _judged(found: Column) -> Column:
    """What ``price_evidence`` returns, from its text, number, sign, value and kind."""
    text, number, sign, value, kind = (found[k] for k in ("text", "number", "sign", "value", "kind"))
    currency = F.when(sign.isin("€", "EUR", "EURO", "EUROS"), "EUR").when(sign == "£", "GBP").when(sign == "$", "USD").otherwise(sign)
    reject = (
        F.when(text.isNull() | (text == ""), "preco_ausente").when(number.isNull(), "preco_sem_evidencia_monetaria").when(value.isNull(), "preco_numero_invalido").when(value <= 0, "preco_zero_ou_negativo")
        .when(currency != "EUR", "moeda_nao_eur").when(kind != "total", F.concat(F.lit("preco_"), kind, F.lit("_nao_retail")))
    )
    return F.struct(value.alias("value"), F.when(number.isNotNull(), currency).alias("currency"), F.when(value.isNull(), "unknown").otherwise(kind).alias("kind"), reject.alias("rejection"))


#: Labels of an offer against its interval, from the reference's own vocabulary.
LABELS = ("suspeito", "dados_insuficientes", "requer_validacao", "excelente_oportunidade", "boa_oportunidade", "muito_acima_do_mercado", "ligeiramente_acima", "dentro_do_mercado")


def opportunity_label(price: Column, value: Column, low: Column, high: Column, confidence: Column, n: Column, blocked: Column | None = None) -> Column:
    """Label of an offer: the interval decides, and what is too far below it or thinly supported asks for a check."""
    suspect, lacking, check, excellent, good, well_above, above, within = map(F.lit, LABELS)
    ratio = F.try_divide(price, value)
    ok = F.coalesce(price.between(300, 2e6) & (value > 0) & (value <= 2e6) & ratio.between(0.2, 3.0), F.lit(False)) & F.coalesce(n >= 1, F.lit(False))
    lo = F.when((low > 0) & (low <= value), low).otherwise(value * 0.9)
    hi = F.when((high > 0) & (high >= value), high).otherwise(value * 1.1)
    conf, off = F.coalesce(confidence, F.lit(0.0)), (value - price) / value * 100
    below = F.when((lo - price) / lo * 100 > 30, check).when((off >= 12) & (conf >= 0.45) & (n >= 6), excellent).when((conf < 0.25) | (n < 3), check).otherwise(good)
    over = F.when((price - hi) / hi * 100 > 10, well_above).otherwise(above)
    out = F.when(~ok, lacking).when(price < lo, below).when(price > hi, over).when((n < 3) | (conf < 0.2), check).otherwise(within)
    return out if blocked is None else F.when(F.coalesce(blocked, F.lit(False)), suspect).otherwise(out)
