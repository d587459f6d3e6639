"""Queries of the field cleaners over raw strings that the listings view gives, and over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import clean, fields, validators
from marlstone.operators.fields import BAD_WORDS, FLAGS, GOOD_WORDS
from marlstone.plans.domain_queries import on_table
from marlstone.plans.market_queries import ROW_ID, on_listings

ID = ", ".join(ROW_ID)
V = F.col
_text = lambda c: F.floor(c).cast("bigint").cast("string")


def on_raw(name: str, raw, f, raw_sql: str, sql: str, out: str = "v", doubles: str = "") -> None:
    """``raw`` builds a string column x from the listings, ``f`` maps it to ``out``; the SQL twins name the same."""
    on_listings(name, lambda df: df.withColumn("x", raw()).select(*ROW_ID, f(V("x")).alias(out)), f", r as (select *, {raw_sql} as x from listings) select {ID}, {sql} as {out} from r", doubles)


on_raw("op_c01_price_clean", lambda: F.concat(F.lit("€ "), _text(V("price") / 10), F.when(V("line") > 3, ",50").otherwise(" ")), fields.price_clean,
       "'€ ' || floor(price / 10)::bigint || case when line > 3 then ',50' else ' ' end",
       "case when try_cast(regexp_replace(x, '[€$.,\\s]', '', 'g') as double) between 1e-9 and 999999.999 then try_cast(regexp_replace(x, '[€$.,\\s]', '', 'g') as double) end", "price_clean", "price_clean")
on_raw("op_c02_mileage_clean", lambda: F.concat(_text(V("mileage")), F.when(V("line") == 5, "000").otherwise(""), F.lit(" km (aprox.)")), fields.mileage_clean,
       "floor(mileage)::bigint || case when line = 5 then '000' else '' end || ' km (aprox.)'",
       "case when regexp_replace(x, '[^0-9]', '', 'g')::double < 1000000 then regexp_replace(x, '[^0-9]', '', 'g')::double end", "km", "km")
on_raw("op_c03_year", lambda: F.concat(F.lit("Reg. "), F.when(V("line") == 7, 3999).otherwise(V("year")).cast("string"), F.lit("/0"), V("line").cast("string")), lambda x: clean.year_of(x, 2001),
       "'Reg. ' || case when line = 7 then 3999 else year end || '/0' || line", "case when regexp_extract(x, '(\\d{4})', 1)::int between 1900 and 2001 then regexp_extract(x, '(\\d{4})', 1)::int end", "year_found")
TITLE = "array_to_string(list_transform(regexp_extract_all(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '\\pL+|[^\\pL]+'), lambda z: upper(z[1]) || lower(z[2:])), '')"
on_raw("op_c04_title_case", lambda: F.concat(V("version"), F.lit("-ab1cd  e'f "), F.lower("location")), fields.title_case, "version || '-ab1cd  e''f ' || lower(location)", TITLE.format("x"), "title")
CASES = lambda c, m, other: f"case lower(trim({c})) " + " ".join(f"when '{k}' then '{v}'" for k, v in m.items()) + f" else {other} end"
_FUEL = {"A": " Diesel", "N": "Gasolina ", "R": "vapor"}
on_raw("op_c05_fuel_map", lambda: F.coalesce(*[F.when(V("fuel_type") == k, v) for k, v in _FUEL.items()]), lambda x: fields.mapped(x, fields.FUELS),
       "case fuel_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _FUEL.items()) + " end", CASES("x", fields.FUELS, "'Unknown'"), "fuel")
on_raw("op_j15_lexicon_lookup", lambda: F.when(V("transmission") == "O", "Automática").when(V("line") != 2, "manual"), lambda x: fields.mapped(x, fields.GEARBOXES, None),
       "case when transmission = 'O' then 'Automática' when line <> 2 then 'manual' end", CASES("x", fields.GEARBOXES, "null"), "gearbox")
on_raw("op_c06_engine", lambda: F.when(V("line") % 2 == 0, F.concat(_text(V("engine_size") * 1000 + 0.5), F.lit(" cc"))).otherwise(F.concat(F.lit("Motor "), V("engine_size").cast("string"), F.lit("L"))), fields.engine_clean,
       "case when line % 2 = 0 then floor(engine_size * 1000 + 0.5)::bigint || ' cc' else 'Motor ' || engine_size || 'L' end",
       "case when (case when y > 100 then y / 1000 else y end) between 0.5 and 10 then case when y > 100 then y / 1000 else y end end".replace("y", "regexp_extract(x, '([0-9]+(?:\\.[0-9]+)?)', 1)::double"), "litres", "litres")
on_raw("op_c07_place", lambda: F.when(V("location") == "FRANCE", "  LISBOA").when(V("location") == "GERMANY", "porto").otherwise(V("location")), fields.place_clean,
       "case location when 'FRANCE' then '  LISBOA' when 'GERMANY' then 'porto' else location end",
       f"case {TITLE.format('x')} when 'Lisboa' then 'Lisbon' when 'Porto' then 'Oporto' else {TITLE.format('x')} end", "place")
on_raw("op_c08_numeric_clean", lambda: F.concat(F.lit("-"), _text(V("price")), F.lit(".25 EUR")), fields.numeric_clean, "'-' || floor(price)::bigint || '.25 EUR'", "abs(regexp_replace(x, '[^0-9.\\-]', '', 'g')::double)", "number", "number")
on_raw("op_c09_words_clean", lambda: F.concat(F.lit("  "), V("version"), F.lit("! #(a_b)  1.5 "), V("seller"), F.lit(" ")), fields.words_clean, "'  ' || version || '! #(a_b)  1.5 ' || seller || ' '",
       "lower(regexp_replace(regexp_replace(trim(x), '\\s+', ' ', 'g'), '[^\\w\\s\\-.]', ' ', 'g'))", "words")
on_raw("op_x05_number", lambda: F.concat(_text(V("mileage") / 1000), F.when(V("line") % 3 == 0, ".500,75").when(V("line") % 3 == 1, ",500.75").otherwise(".500")), clean.number,
       "floor(mileage / 1000)::bigint || case line % 3 when 0 then '.500,75' when 1 then ',500.75' else '.500' end", "floor(mileage / 1000) * 1000 + 500 + case when line % 3 = 2 then 0 else 0.75 end", "number", "number")
on_raw("op_x06_terms", lambda: F.concat(F.lit("gasóleo "), V("version"), F.lit(" automático bombom bom")), lambda x: fields.replace_terms(x, fields.TERMS),
       "'gasóleo ' || version || ' automático bombom bom'", "'diesel ' || version || ' automatic bombom good'", "terms")
on_raw("op_x07_spam", lambda: F.concat(F.upper("version"), F.lit("!!!! "), F.when(V("line") > 3, "LAST CHANCE").otherwise("urgente zzz")), fields.without_spam,
       "upper(version) || '!!!! ' || case when line > 3 then 'LAST CHANCE' else 'urgente zzz' end", "case when line > 3 then lower(version) || '!! ' else upper(version) || '!!  zz' end", "kept")
on_raw("op_x18_slug", lambda: F.concat(F.lit("Ã "), V("version"), F.lit(" -- é #1 "), V("line").cast("string")), fields.slug, "'Ã ' || version || ' -- é #1 ' || line", "'a-' || replace(lower(version), ' ', '-') || '-e-1-' || line", "slug")
on_raw("op_x18_truncate", lambda: V("version"), lambda x: fields.truncated(x, 20), "version", "case when length(x) > 20 then substr(x, 1, 17) || '...' else x end", "short")
on_raw("op_x20_timestamp", lambda: F.when(V("line") % 3 == 0, F.unix_timestamp("last_seen").cast("string")).when(V("line") % 3 == 1, F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(V("line") % 3 == 2, F.date_format("last_seen", "yyyy-MM-dd")),
       fields.timestamp_of, "line", "case when line % 3 = 2 then last_seen::date::timestamp else date_trunc('second', last_seen) end", "seen")
on_raw("op_x31_relative_date", lambda: F.when(V("line") == 1, "Hoje, 12:30").when(V("line") == 2, "ontem").when(V("line") == 3, "há 12 dias").when(V("line") == 4, F.date_format("last_seen", "dd/MM/yyyy")).when(V("line") == 5, F.date_format("last_seen", "yyyy-MM-dd")).otherwise("nunca"),
       lambda x: fields.relative_date(x, "1998-08-01"), "line",
       "case line when 1 then date '1998-08-01' when 2 then date '1998-07-31' when 3 then date '1998-07-20' when 4 then last_seen::date when 5 then last_seen::date end", "day")
on_listings("op_x22_safe_ratio", lambda df: df.select(*ROW_ID, fields.safe_ratio(V("price"), V("line") - 3).alias("ratio"), fields.finite(F.when(V("line") == 1, float("nan")).when(V("line") == 2, float("inf")).otherwise(V("price"))).alias("fin")),
            f" select {ID}, price / nullif(line - 3, 0) as ratio, case when line > 2 then price end as fin from listings", "ratio fin")
on_listings("op_x28_km_per_year", lambda df: df.select(*ROW_ID, fields.per_year(V("mileage"), V("year"), 1997).alias("km_per_year")),
            f" select {ID}, case when year <= 1997 then mileage / greatest(1997 - year, 1) end as km_per_year from listings", "km_per_year")
on_listings("op_c10_valid_records", lambda df: fields.valid_records(df.withColumn("m", F.when(V("line") != 3, V("mileage"))), ["make", "price"], {"price": (500, 60000), "m": (0, 150000), "year": (1993, 2001)}).groupBy("make").agg(F.count(F.lit(1)).alias("n")),
            " select make, count(*) as n from listings where price between 500 and 60000 and (line = 3 or mileage between 0 and 150000) and year between 1993 and 2001 group by make")
on_listings("op_c18_frequency_index", lambda df: fields.frequency_index(df, "version"), ', g as (select version, count(*) as n from listings group by version) select version, n, row_number() over (order by n desc, version) as "index" from g')
on_listings("op_c19_split", lambda df: df.groupBy("location", fields.split_of(F.concat_ws("-", "order_id", "line", "seller")).alias("part")).agg(F.count(F.lit(1)).alias("n")),
            " select location, case when substr(md5(concat_ws('-', order_id, line, seller)), 1, 2) < 'b3' then 'train' when substr(md5(concat_ws('-', order_id, line, seller)), 1, 2) < 'da' then 'validation' else 'test' end as part, count(*) as n from listings group by all")

# --- whole texts
on_table("op_x01_accents", "documents", lambda df: df.select("doc_id", F.md5(fields.fold_accents(V("text"))).alias("folded")), r"select doc_id, md5(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g')) as folded from documents")
_has = lambda words: "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"
on_table("op_x08_flags", "documents", lambda df: df.select("doc_id", *fields.flags(V("text"))),
         "with d as (select doc_id, lower(text) as t from documents) select doc_id, " + ", ".join(f"coalesce({_has(ws)}, false) as {k}" for k, ws in FLAGS.items()) + " from d")
on_table("op_x09_text_checks", "documents", lambda df: df.select("doc_id", fields.text_quality(V("text")).alias("q")).select("doc_id", "q.*"),
         r"""with d as (select doc_id, coalesce(text, '') as t from documents), c as (select doc_id, length(t) >= 20 as long_enough, length(t) <= 2000 as short_enough, len(regexp_extract_all(t, '\S+')) >= 5 as enough_words,
 len(list_distinct(string_split(lower(t), ''))) >= 10 as varied, regexp_matches(t, '[0-9]{9}|[^\s@]+@[^\s@]+\.[a-z]') as has_contact from d)
select *, (long_enough::int + short_enough::int + enough_words::int + varied::int + has_contact::int) / 5 as score from c""", "score")
_count = lambda words: " + ".join(f"contains(t, '{w}')::int" for w in words)
on_table("op_x10_tone", "documents", lambda df: df.groupBy("lang", fields.tone(F.concat("text", F.when(V("doc_id") % 5 == 0, " perfeito").when(V("doc_id") % 5 == 1, " avariado").otherwise(""))).alias("tone")).agg(F.count(F.lit(1)).alias("n")),
         f"""with d as (select lang, lower(coalesce(text || case doc_id % 5 when 0 then ' perfeito' when 1 then ' avariado' else '' end, '')) as t from documents), s as (select lang, {_count(GOOD_WORDS)} as g, {_count(BAD_WORDS)} as b from d)
select lang, case when g / nullif(g + b, 0) > 0.6 then 'positive' when g / nullif(g + b, 0) < 0.4 then 'negative' else 'neutral' end as tone, count(*) as n from s group by all""")
on_table("op_x15_url", "pages", lambda df: df.select("page_id", fields.valid_url(V("url")).alias("ok")), r"select page_id, coalesce(regexp_matches(url, '^https?://[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+(:[0-9]+)?([/?#]\S*)?$'), false) as ok from pages")

# --- validators and element scores
_ELEMENT = r"<(p|li|h[1-6]|div)[^<>]*>[^<>]*"


def _elements(df):
    """Elements of a page with the text right after their start tag; the place on the page stands for the depth."""
    e = df.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(_ELEMENT), F.lit(0))).alias("i", "e"))
    return e.select("page_id", "i", F.substring_index("e", ">", -1).alias("text"), F.when(V("i") == 0, F.concat(F.lit("/anuncio-"), "url")).alias("href"), F.regexp_extract("e", _ELEMENT, 1).alias("tag"), (V("i") % 2 == 0).alias("image"), F.least(V("i"), F.lit(9)).alias("depth"))


on_table(
    "op_n30_element_scores", "pages", lambda df: _elements(df).select("page_id", "i", validators.element_score(V("text"), V("href"), V("tag"), V("image"), V("depth")).alias("s")).select("page_id", "i", "s.*"),
    rf"""with x as (select page_id, url, regexp_extract_all(html, '{_ELEMENT}') as es from pages), y as (select page_id, url, unnest(range(0, len(es))) as i, unnest(es) as e from x),
z as (select page_id, i, trim(string_split(e, '>')[-1], ' ' || chr(9) || chr(10) || chr(13)) as t, regexp_extract(e, '{_ELEMENT}', 1) as tag, i = 0 and url is not null as ad, i % 2 = 0 as image, least(i, 9) as depth from y),
s as (select page_id, i, 0.3e0 * regexp_matches(t, '[0-9]')::int + 0.25e0 * ad::int + 0.15e0 * regexp_matches(t, '\b(19[89][0-9]|20[0-2][0-9])\b')::int + 0.15e0 * regexp_matches(lower(t), '[0-9]{{1,3}}([.\s][0-9]{{3}})*\s*(km|quilómetros)')::int
  + 0.1e0 * regexp_matches(tag, '^h[1-6]$')::int + 0.05e0 * image::int - 0.02e0 * depth + 0.01e0 * length(t) as raw from z)
select page_id, i::int as i, greatest(0e0, least(1e0, raw / 1.01e0)) as confidence, greatest(0e0, least(1e0, raw / 1.01e0)) >= 0.5 as is_listing from s""",
    "confidence",
)
on_listings(
    "op_q12_validators",
    lambda df: df.select(validators.checked(F.when(V("line") != 2, F.concat(F.lit("https://a.example/"), "order_id")), F.when(V("line") != 3, V("price") * F.when(V("line") == 4, 20).otherwise(0.02)), F.when(V("line") == 7, "moto").otherwise("car"), V("year") - F.when(V("line") == 5, 20).otherwise(0), V("mileage") * 4, 1997).alias("c"))
    .groupBy("c.url", "c.price", "c.year", "c.km", "c.valid").agg(F.count(F.lit(1)).alias("n")),
    """, x as (select line, case when line <> 3 then price * case when line = 4 then 20 else 0.02e0 end end as p, year - case when line = 5 then 20 else 0 end as y, mileage * 4 as k from listings),
e as (select case when line = 2 then 'empty' end as url, case when p is null then 'missing' when p < case when line = 7 then 200 else 500 end then 'below' when p > case when line = 7 then 100000 else 500000 end then 'above' end as price,
 case when y < 1980 then 'below' when y > 1998 then 'above' end as year, case when k > 500000 then 'above' end as km from x)
select url, price, year, km, url is null and price is null and year is null as valid, count(*) as n from e group by all""",
)
