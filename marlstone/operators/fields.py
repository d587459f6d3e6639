"""Raw listing fields: numbers, years, names, lexicon maps, text flags and quality. Nulls stay null unless stated."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of fuels, gearboxes and places as they are mapped; what is not listed is UNKNOWN.
FUELS = {"gasolina": "Gasoline", "gasóleo": "Diesel", "diesel": "Diesel", "elétrico": "Electric", "electric": "Electric", "híbrido": "Hybrid", "hybrid": "Hybrid", "gpl": "LPG", "lpg": "LPG", "gnv": "CNG", "cng": "CNG"}
GEARBOXES = {"automático": "Automatic", "automatic": "Automatic", "manual": "Manual", "automática": "Automatic", "cvt": "CVT", "tiptronic": "Tiptronic", "dsg": "DSG"}
PLACES = {"Lisboa": "Lisbon", "Porto": "Oporto"}
UNKNOWN = "Unknown"
#: Accented letters and their plain ones.
ACCENTED, PLAIN = "áàãâäéèêëíìîïóòõôöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"
#: Keyword lists of text flags.
FLAGS = {
    "air_conditioning": ("ar condicionado", "ac", "climatização"), "power_steering": ("direção assistida", "direção hidráulica"), "abs": ("abs", "freios abs"),
    "airbags": ("airbag", "airbags", "sacos de ar"), "cruise_control": ("cruise control", "controlo de velocidade"), "parking_sensors": ("sensores de estacionamento", "parking sensors"),
    "navigation": ("gps", "navegação", "sistema de navegação"), "leather_seats": ("couro", "assentos de couro"), "alloy_wheels": ("jantes de liga", "alloy wheels"),
    "sunroof": ("teto solar", "sunroof"), "automatic": ("automático", "automática", "cambio automático"),
}
GOOD_WORDS = ("excelente", "perfeito", "ótimo", "bom", "conservado", "cuidado", "novíssimo", "impecável", "funciona bem", "sem problemas")
BAD_WORDS = ("mau", "ruim", "avariado", "com problemas", "precisa de reparação", "danificado", "com defeito", "não funciona", "com ferrugem")
SPAM = ("urgente", "urgent", "oferta especial", "special offer", "promoção", "promotion", "desconto", "discount", "limitado", "limited", "última chance", "last chance")
#: Words of a description as they are translated.
TERMS = {
    "gasolina": "gasoline", "gasóleo": "diesel", "elétrico": "electric", "híbrido": "hybrid", "gpl": "lpg", "gnv": "cng", "automático": "automatic",
    "excelente": "excellent", "perfeito": "excellent", "ótimo": "good", "bom": "good", "regular": "fair", "aceitável": "fair", "ruim": "poor", "mau": "poor",
}


def price_clean(c: Column, most: float = 1e6) -> Column:
    """Currency signs, blanks and every separator go, so cents become digits; the rest is a price above 0 and below ``most``."""
    v = F.regexp_replace(c, r"[€$.,\s]", "").try_cast("double")
    return F.when((v > 0) & (v < most), v)


def mileage_clean(c: Column, most: float = 1e6) -> Column:
    v = F.regexp_replace(c, "[^0-9]", "").try_cast("double")
    return F.when((v >= 0) & (v < most), v)


def engine_clean(c: Column) -> Column:
    """First number in litres; above 100 it is cubic centimetres; 0.5 to 10 litres."""
    v = F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    v = F.when(v > 100, v / 1000).otherwise(v)
    return F.when(v.between(0.5, 10), v)


def title_case(c: Column) -> Column:
    """White space collapsed; every run of letters begins with a capital, whatever stands before it."""
    runs = F.regexp_extract_all(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def mapped(c: Column, words: dict[str, str], other: str | None = UNKNOWN) -> Column:
    """Lexicon lookup of the trimmed lower-case word; ``other`` for what is not listed and for null."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.coalesce(table[F.lower(F.trim(c))], F.lit(other))


def place_clean(c: Column, names: dict[str, str] = PLACES) -> Column:
    t = title_case(c)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[t], t)


def numeric_clean(c: Column, positive: bool = True) -> Column:
    v = F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")
    return F.abs(v) if positive else v


def words_clean(c: Column, lower: bool = True) -> Column:
    """Trimmed, white space collapsed, everything but letters, digits, _, -, . and blanks turned into a blank."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", " "), r"(?U)[^\w\s\-.]", " ")
    return F.lower(t) if lower else title_case(t)


def valid_records(df: DataFrame, required: list[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose required columns are set and whose other values, where set, lie in their ranges."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    for c, (lo, hi) in ranges.items():
        ok = ok & (F.col(c).isNull() | F.col(c).between(lo, hi))
    return df.where(ok)


def frequency_index(df: DataFrame, c: str) -> DataFrame:
    """Values of a column numbered from 1 by falling count (ties: by value); null is no value.

    Counts are ranked within ranges of one count, so no task ranks all values: the values above a count are summed first.
    """
    g = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    sizes = g.groupBy("n").agg(F.count(F.lit(1)).alias("_k"))
    above = sizes.withColumn("_above", F.coalesce(F.sum("_k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("n", "_above")
    within = F.row_number().over(Window.partitionBy("n").orderBy(c))
    return g.join(above, "n").select(c, "n", (F.col("_above") + within).cast("long").alias("index"))


def split_of(key: Column, train: float = 0.7, validation: float = 0.15) -> Column:
    """train, validation or test by the leading bits of a digest of the key: the same row always falls in the same part."""
    bucket = F.substring(F.md5(key), 1, 2)
    cut = lambda share: f"{round(share * 256):02x}"
    return F.when(bucket < cut(train), "train").when(bucket < cut(train + validation), "validation").otherwise("test")


#: Signs whose decomposition has several ASCII letters and that texts hold; other such signs go.
SIGNS = "¼½¾…№™ﬀﬁﬂﬃﬄ㎏㎞"


def _plain(letter: str) -> str:
    return unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode().lower()


@functools.cache
def _letters() -> tuple[str, str]:
    """Letters beyond ASCII whose compatibility decomposition leaves one ASCII letter, and these letters."""
    found = {chr(k): _plain(chr(k)) for k in range(0x80, 0x110000)}
    one = {k: v for k, v in found.items() if len(v) == 1}
    return "".join(one), "".join(one.values())


def computed_once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is computed once for each row however often ``f`` names it."""
    return F.transform(F.array(c), f)[0]


def fold_accents(c: Column) -> Column:
    """Lower case without accents: compatibility decomposition, of which only ASCII stays (what has none goes, as ``ß``)."""
    low = F.lower(c)
    whole = F.translate(low, *_letters())
    for sign in SIGNS:
        whole = F.replace(whole, F.lit(sign), F.lit(_plain(sign)))
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.regexp_replace(whole, r"[^\x00-\x7F]", "")).otherwise(low)


def replace_terms(c: Column, terms: dict[str, str]) -> Column:
    """Whole words replaced one after another, in the order given."""
    for word, to in terms.items():
        c = F.regexp_replace(c, rf"(?U)\b{word}\b", to)
    return c


def without_spam(c: Column, phrases: tuple[str, ...] = SPAM) -> Column:
    """A text in capitals only is lowered, runs of three or more equal characters become two, phrases go."""
    t = F.when((c == F.upper(c)) & (c != F.lower(c)), F.lower(c)).otherwise(c)
    t = F.regexp_replace(t, r"(.)\1{2,}", "$1$1")
    for p in phrases:
        t = F.regexp_replace(t, rf"(?U)\b{p}\b", "")
    return t


def flags(c: Column, lists: dict[str, tuple[str, ...]] = FLAGS) -> list[Column]:
    low = F.lower(c)
    return [F.coalesce(_any(low, words), F.lit(False)).alias(name) for name, words in lists.items()]


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def text_quality(c: Column) -> Column:
    """Struct of the five checks and their share: 20 and 2000 characters, five words, ten different characters, a contact."""
    t = F.coalesce(c, F.lit(""))
    checks = {
        "long_enough": F.length(t) >= 20, "short_enough": F.length(t) <= 2000, "enough_words": F.regexp_count(t, F.lit(r"\S+")) >= 5,
        "varied": F.size(F.array_distinct(F.filter(F.split(F.lower(t), ""), lambda x: x != ""))) >= 10, "has_contact": t.rlike(r"[0-9]{9}|[^\s@]+@[^\s@]+\.[a-z]"),
    }
    score = sum((v.cast("double") for v in checks.values()), F.lit(0.0)) / len(checks)
    return F.struct(*[v.alias(k) for k, v in checks.items()], score.alias("score"))


def tone(c: Column, good: tuple[str, ...] = GOOD_WORDS, bad: tuple[str, ...] = BAD_WORDS) -> Column:
    """positive over .6 of good among good and bad words, negative under .4, else neutral (also without any)."""
    low = F.lower(F.coalesce(c, F.lit("")))
    count = lambda ws: sum((low.contains(w).cast("int") for w in ws), F.lit(0))
    share = F.try_divide(count(good), count(good) + count(bad))
    return F.when(share > 0.6, "positive").when(share < 0.4, "negative").otherwise("neutral")


def valid_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+(:[0-9]+)?([/?#]\S*)?$"), F.lit(False))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fold_accents(c), "[^a-z0-9 -]", ""), "[ -]+", "-"), F.lit("-"))


def truncated(c: Column, most: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(tail)), F.lit(tail))).otherwise(c)


def timestamp_of(c: Column) -> Column:
    """Seconds since 1970, ISO times with or without ``Z``, or dates, as a time; what names no zone is in the session's; what is none of them is null."""
    seconds = F.when(c.rlike("^[0-9]{9,10}$"), F.timestamp_seconds(c.try_cast("long")))
    return F.coalesce(seconds, c.try_cast("timestamp"))  # a zone that is written counts, Z included


def relative_date(c: Column, asof: str) -> Column:
    """hoje, ontem, or ``há n dias`` counted back from ``asof``; else the date that stands there (dd/mm/yyyy or ISO)."""
    low, day = F.lower(F.trim(c)), F.lit(asof).cast("date")
    ago = F.regexp_extract(low, r"h[aá] ([0-9]+) dias?", 1).try_cast("int")
    local = F.regexp_extract(low, r"([0-9]{2})/([0-9]{2})/([0-9]{4})", 0)
    iso = F.concat_ws("-", F.substring(local, 7, 4), F.substring(local, 4, 2), F.substring(local, 1, 2)).try_cast("date")
    return F.when(low.contains("hoje"), day).when(low.contains("ontem"), F.date_sub(day, 1)).when(ago.isNotNull(), F.date_sub(day, ago)).otherwise(F.coalesce(F.when(local != "", iso), low.try_cast("date")))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_ratio(a: Column, b: Column) -> Column:
    return finite(F.try_divide(a, b))


def per_year(km: Column, year: Column, asof_year: int) -> Column:
    """Mileage a year over an age of one at least; null for a year to come."""
    age = F.lit(asof_year) - year
    return F.when(age >= 0, km / F.greatest(age, F.lit(1)))
