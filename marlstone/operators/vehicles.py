"""Canonical vehicles from free text: performance class, fuel, and which fuels compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.operators import fields

#: Patterns of performance classes over folded text, tried from the fastest class down; ranks follow the order base,
#: sport_trim, performance, high_performance, supercar.
PERFORMANCE = (
    ("supercar", (
        r"\bturbo\s*s\b", r"\bgt2\b|\bgt3\b|\bgt4\b", r"\bgt\s*r\b|\bamg\s*gt\b", r"\bsvr\b|\bsvo\b", r"\brs\s*[36]\s*performance\b", r"\bblack\s*series\b", r"\bcompetizione\b|\bpista\b|\bspeciale\b",
    )),
    ("high_performance", (
        r"\ba\s*45\b|\bc\s*63\b|\be\s*63\b|\bg\s*63\b|\bs\s*63\b|\bs\s*65\b", r"\bgla\s*45\b|\bcla\s*45\b|\bglc\s*63\b|\bgle\s*63\b", r"\bm[2-8]\b(?!\s*sport)", r"\bx[3-6]\s*m\b(?!\s*sport)",
        r"\bm\s*competition\b", r"\brs\s*\d\b|\brs\d\b", r"\bgts\b", r"\bturbo\b(?!\s*diesel|\s*d\b)", r"\bquadrifoglio\b|\bqv\b", r"\btype\s*r\b|\bnismo\b", r"\bpolestar\s*engineered\b", r"\btrophy\b|\bmegane\s*rs\b",
    )),
    ("performance", (
        r"\ba\s*35\b|\bc\s*43\b|\be\s*53\b|\bcla\s*35\b|\bglc\s*43\b", r"\bm135\b|\bm140\b|\bm235\b|\bm240\b|\bm340\b|\bm440\b|\bm550\b", r"\bs[1-8]\b(?!\s*line)", r"\bgti\b|\bgtd\b|\bgte\b|\bgt\s*i\b",
        r"\bcupra\b", r"\bjohn\s*cooper\b|\bjcw\b", r"\bst\b(?!\s*line)", r"\bveloce\b", r"\bn\s*performance\b|\bhyundai\s*n\b", r"\bgse\b|\bopc\b", r"\bcarrera\s*s\b|\bcarrera\s*4s\b",
    )),
    ("sport_trim", (
        r"\bamg\s*line\b|\bamg\s*pack\b|\bpack\s*amg\b|\bjantes\s*amg\b", r"\bm\s*sport\b|\bmsport\b|\bm\s*line\b|\bpack\s*m\b|\bdesportivo\s*m\b", r"\bs\s*line\b|\bsline\b",
        r"\bst\s*line\b|\bn\s*line\b|\br\s*line\b|\bgt\s*line\b", r"\bblack\s*edition\b|\bsport\s*edition\b", r"\bamg\b",
    )),
)
RANKS = ("base", "sport_trim", "performance", "high_performance", "supercar")
FAST_BRANDS = ("porsche", "ferrari", "lamborghini", "maserati", "aston martin", "mclaren", "bentley", "rolls-royce", "lotus", "alpine")
#: Patterns of fuels over folded text, in the order in which they are tried, and badges that tell when no word does.
FUELS = (
    ("phev", r"plug[\s\-]?in|phev|\bp?hev\s*plug|recarregavel|e[\s\-]?hybrid|\be\s*tense\b|\bplugin\b"), ("mild_hybrid", r"\bmhev\b|mild[\s\-]?hybrid|micro[\s\-]?hibrido|\b48\s*v\b|\behybrid\s*48\b|\bmild\b"),
    ("hibrido", r"hibrid|hybrid|\bhev\b|e[\s\-]?tech(?!.*eletric)|\bself\s*charg"), ("eletrico", r"eletric|electric|\bbev\b|\bev\b|100%\s*eletric|\bepower\b"), ("gpl", r"\bgpl\b|\blpg\b|autogas"),
    ("gas natural", r"gas\s*natural|\bgnc\b|\bcng\b|\bgnv\b"), ("diesel", r"diesel|gasoleo|\btdi\b|\bhdi\b|\bcdi\b|\bdci\b|\bcrdi\b|\bbluetec\b|\btdci\b|\bjtd\b|\bd4d\b"),
    ("gasolina", r"gasolina|petrol|gasoline|\btsi\b|\btfsi\b|\bvti\b|\bmpi\b|\bgdi\b|\bvvt\b|\bthp\b"),
)
BADGES = (("diesel", r"\b\d{3}\s?d\b|\b\d{2,3}\s?cdi\b|\bd\s?4d\b"), ("gasolina", r"\b\d{3}\s?i\b"))
#: Fuels that may stand in for each other.
NEIGHBOURS = {
    "gasolina": ("mild_hybrid", "diesel"), "diesel": ("mild_hybrid", "gasolina"), "mild_hybrid": ("gasolina", "diesel", "hibrido"), "hibrido": ("mild_hybrid",), "gpl": ("gasolina",), "gas natural": ("gasolina",),
}
_NOTHING = ("", "nan", "none", "null", "unknown", "n/a", "-")


def normal_text(c: Column) -> Column:
    """Folded, white space collapsed; words that say nothing and null become the empty string."""
    t = F.regexp_replace(fields.fold_accents(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")
    return fields.computed_once(t, lambda t: F.when(t.isin(*_NOTHING), "").otherwise(t))


def performance_class(*texts: Column) -> Column:
    """Struct class, rank and confidence: .9 by a pattern, .55 by the brand alone, .6 for base, .35 without any text."""
    blob = F.array_join(F.filter(F.transform(F.array(*texts), normal_text), lambda t: t != ""), " ")
    return fields.computed_once(blob, _performance)


def _performance(blob: Column) -> Column:
    found = F.coalesce(*[F.when(blob.rlike("|".join(patterns)), name) for name, patterns in PERFORMANCE])
    fast = fields._any(blob, FAST_BRANDS)
    name = F.coalesce(found, F.when(fast, "performance"), F.lit("base"))
    conf = F.when(blob == "", 0.35).when(found.isNotNull(), 0.9).when(fast, 0.55).otherwise(0.6)
    return F.struct(name.alias("performance"), (F.array_position(F.array(*map(F.lit, RANKS)), name) - 1).cast("int").alias("rank"), conf.alias("confidence"))


def fuel_class(*texts: Column) -> Column:
    """Fuel of the first text that names one, else of the first that carries a badge, else unknown."""
    of = lambda t, table: F.coalesce(*[F.when(t.rlike(p), name) for name, p in table])
    first = lambda ts, table: F.get(F.array_compact(F.transform(ts, lambda t: of(t, table))), F.lit(0))
    return fields.computed_once(F.transform(F.array(*texts), normal_text), lambda ts: F.coalesce(first(ts, FUELS), first(ts, BADGES), F.lit("unknown")))


def fuels_compare(a: Column, b: Column) -> Column:
    """Equal fuels compare, unknown ones with nothing else, the others with their neighbours."""
    near = F.coalesce(*[F.when(a == k, b.isin(*ns)) for k, ns in NEIGHBOURS.items()], F.lit(False))
    return F.when(a == b, True).when((a == "unknown") | (b == "unknown"), False).otherwise(near)


def model_name(brand: Column, model: Column) -> Column:
    """Folded model without its brand in front, without engine sizes, doors and years; null if nothing is left."""
    b, m = normal_text(brand), normal_text(model)
    bare = F.when((b != "") & m.startswith(b), F.substring(m, F.length(b) + 1, 1 << 30)).otherwise(m)
    bare = F.regexp_replace(bare, r"\b[0-9]\.[0-9]\b|\b[0-9]p\b|\b(?:19|20)[0-9]{2}\b", " ")
    out = F.trim(F.regexp_replace(bare, r"[\s_]+", " "))
    return F.when(out != "", out)
