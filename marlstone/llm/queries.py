"""The numbered queries over the training-data tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import alignment, decontaminate, html, language, lm, manifest, mixing, pii, quality, secrets, simhash, suffix_dedup, urls
from marlstone.llm.common import materialise


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents")).drop("kept")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    # an earlier run saw about half of the rows; this one scans what its ledger lacks and joins all findings back
    _, ledger, findings = secrets.scan_secrets(docs.where(F.xxhash64("doc_id") > 0))
    rows, _, _ = secrets.scan_secrets(docs, ledger=materialise(ledger), findings=materialise(findings))
    of = lambda k: F.size(F.filter("found", lambda x: x["name"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["name"].isin(*secrets.BASE_KINDS))
    return rows.select("doc_id", *[of(k) for k in secrets.BASE_KINDS], F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("found")).alias("spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix_sources(docs).select("doc_id", "mix.domain", "lang", "source", "mix.n_tokens", "mix.epochs", "mix.extra_tokens", "mix.taken")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "verdict_of.host", "verdict_of.path", "verdict_of.rule", "verdict_of.verdict", "verdict_of.score")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html.extract_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    q = [F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat")]
    return got.select("doc_id", *q)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.fit(docs)).select("doc_id", "lm.n_tokens", "lm.log_prob", "lm.mean_log_prob")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    net = language.fit(docs.where(~held_out))
    got = language.identify_language(docs.select("doc_id", "text"), net)
    return got.select("doc_id", held_out.alias("held_out"), F.col("language.pred").alias("lang_pred"), F.col("language.score").alias("score"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.find_contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    items = F.array_join(F.array_sort("hits.items"), ",")
    return got.select("doc_id", "hits.n_words", n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return manifest.verified(manifest.manifest(docs, tampered={"text": manifest.lower_cased(docs["text"])}, when=picked))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find_pii(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE_KINDS))
    return got.select("doc_id", *[n(k) for k in pii.BASE_KINDS], F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("pii")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_secrets, op3_mixing, op4_url_filter, op5_html_extraction, op6_simhash, op7_quality, op8_lm_score, op9_language_id, op10_decontamination, op11_manifest, op12_alignment, op13_pii)}


_OP1 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, substr(x, 2 * i + 1, 400) as s from d, unnest(range(0, greatest(n - 199, 0))) t(i)),
h as (select doc_id, i, count(*) over (partition by s) as c from w),
p as (select doc_id, i, max(i + 200) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as reach from h where c > 1),
g as (select doc_id, i, sum(case when reach is null or i > reach then 1 else 0 end) over (partition by doc_id order by i) as k from p),
r as (select doc_id, k, min(i) as s, max(i) + 200 as e from g group by doc_id, k),
gap as (select doc_id, coalesce(lag(e) over (partition by doc_id order by s), 0) as a, s as b from r
        union all select d.doc_id, coalesce(max(r.e), 0), any_value(d.n) from d left join r on r.doc_id = d.doc_id group by d.doc_id),
left_over as (select gap.doc_id, string_agg(substr(d.x, 2 * a + 1, 2 * (b - a)), '' order by a) as kept from gap join d on d.doc_id = gap.doc_id group by gap.doc_id)
select d.doc_id, d.n::bigint as n_bytes, coalesce((select sum(e - s) from r where r.doc_id = d.doc_id), 0)::bigint as n_removed,
       (select count(*) from r where r.doc_id = d.doc_id)::bigint as n_spans, sha256(unhex(left_over.kept)) as kept_sha256
from d join left_over on left_over.doc_id = d.doc_id
"""


def _op2() -> str:
    kinds = []
    for order, (kind, pattern, group, least) in enumerate(secrets.RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        counted = "true" if group == 0 else f"length(regexp_extract_all(t, {p}, {group})[i]) >= {least}"
        kinds.append(
            f"select doc_id, {order} as o, '{kind}' as kind, list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda z: length(z)))"
            f" + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i-1], lambda z: length(z))), 0) as s,"
            f" length(regexp_extract_all(t, {p})[i]) as len, {counted} as ok from d, unnest(range(1, len(regexp_extract_all(t, {p})) + 1)) u(i)"
        )
    one = "kind || ':' || s::bigint || ':' || (s + len)::bigint"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as (select * from ({" union all ".join(kinds)}) where ok),
a as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      coalesce(string_agg({one}, ',' order by s, o) filter (o < 3), '') as base, string_agg({one}, ',' order by s, o) as spans from m group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (doc_id)
"""


def _share_sql(name: str, source: str, parent: str, order: str) -> str:
    """Water filling of one level, as in :func:`mixing.share`."""
    by = f"partition by {parent}" if parent else ""
    return f"""
{name}_r as (select *, coalesce(sum(cap) over ({by} order by cap / w, {order} rows between unbounded preceding and 1 preceding), 0e0) as c,
      sum(w) over ({by}) - coalesce(sum(w) over ({by} order by cap / w, {order} rows between unbounded preceding and 1 preceding), 0e0) as v from {source}),
{name}_f as (select *, c + cap / w * v <= budget as filled from {name}_r),
{name} as (select * exclude (c, v, filled), least(cap, case when filled then cap else greatest(0e0, (budget - coalesce(sum(case when filled then cap end) over ({by}), 0e0)) * w
      / sum(case when not filled then w end) over ({by})) end) as give from {name}_f)"""


def _op3() -> str:
    weigh = lambda col, ws: f"case {col} " + " ".join(f"when '{k}' then {v}e0" for k, v in ws.items()) + f" else {mixing.DEFAULT_WEIGHT}e0 end"
    key = f"sha256('{mixing.SEED}:' || epochs || ':' || doc_id)"
    return f"""
with m as (select doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') as int), 0) % 4) as domain, lang, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents),
l as (select domain, lang, source, sum(n_tokens)::bigint as tokens, sum(n_tokens)::double * {mixing.MAX_EPOCHS} as cap, 1e0 as w from m group by all having sum(n_tokens) > 0),
g as (select domain, lang, sum(cap) as cap from l group by all),
d0 as (select domain, sum(cap) as cap, {weigh("domain", mixing.DOMAIN_WEIGHTS)} as w, (select sum(tokens) from l)::double as budget from g group by domain),
{_share_sql("dom", "d0", "", "domain")},
g0 as (select g.*, {weigh("g.lang", mixing.LANG_WEIGHTS)} as w, dom.give as budget from g join dom using (domain)),
{_share_sql("lng", "g0", "domain", "lang")},
l0 as (select l.*, lng.give as budget from l join lng on l.domain = lng.domain and l.lang is not distinct from lng.lang),
{_share_sql("leaf", "l0", "domain, lang", "source")},
t as (select domain, lang, source, tokens, floor(give + 1e-6)::bigint as target from leaf),
e as (select m.*, (target // tokens)::int as epochs, target % tokens as rest from m join t on m.domain = t.domain and m.lang is not distinct from t.lang and m.source is not distinct from t.source),
r as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by {key}, n_tokens rows between unbounded preceding and 1 preceding), 0) as before from e),
x as (select *, greatest(0, least(n_tokens, rest - before))::bigint as extra_tokens from r)
select doc_id, domain, lang, source, n_tokens, epochs, extra_tokens, (epochs * n_tokens + extra_tokens)::bigint as taken from x where epochs * n_tokens + extra_tokens > 0
"""


_OP10 = r"""
with b as (select item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda z: z <> '') as w from benchmark where text is not null),
win as (select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s from b, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) u(i)),
d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda z: z <> '') as w from documents),
sizes as (select distinct size from win),
dw as (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as s from d, sizes, unnest(range(1, greatest(len(w) - size + 2, 1))) u(i)),
hit as (select distinct dw.doc_id, dw.i, dw.size, win.item_id from dw join win on win.size = dw.size and win.s = dw.s),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from hit) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join it using (doc_id)
"""


def _op11(levels: int = 6, top_levels: int = 4) -> str:
    """Towers of ``levels`` runs a source (16**6 documents) and ``top_levels`` over the sources, and a walk up them for each document."""
    field = lambda c: f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = []
    for name, n in (("n", levels), ("t", top_levels)):
        if name == "t":
            parts.append(f"t0 as (select '' as s, row_number() over (order by s) - 1 as i, s as name, h, count(*) over () as c from n{levels})")
        for k in range(n):
            parts.append(
                f"{name}{k + 1} as (select s, i // 16 as i, case when max(c) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end as h, (max(c) + 15) // 16 as c from {name}{k} group by s, i // 16)"
            )
    walk, at = [], "x0"
    for k, name in enumerate([f"n{k}" for k in range(levels)] + [f"t{k}" for k in range(top_levels)]):
        if name == "t0":
            walk.append(f"top as (select x.key, '' as s, t0.i, x.proof, x.f from {at} x join t0 on t0.name = x.s)")
            at = "top"
        walk.append(
            f"s{k} as (select x.key, coalesce(string_agg(n.h, '' order by n.i) filter (n.i < x.i), '') as l, coalesce(string_agg(n.h, '' order by n.i) filter (n.i > x.i), '') as r, max(n.c) as c"
            f" from {at} x join {name} n on n.s = x.s and n.i // 16 = x.i // 16 group by x.key)"
        )
        walk.append(f"x{k + 1} as (select x.key, x.s, x.i // 16 as i, proof || l || r as proof, case when c = 1 then f else sha256(l || f || r) end as f from {at} x join s{k} using (key))")
        at = f"x{k + 1}"
    return f"""
with recursive crc as (
  select doc_id, encode(doc_id::varchar) as b, 0 as k, 4294967295::bigint as v from (select distinct doc_id from documents where doc_id is not null)
  union all select doc_id, b, k + 1, list_reduce([xor(v, ascii(substr(doc_id::varchar, k + 1, 1))::bigint), 0, 1, 2, 3, 4, 5, 6, 7], lambda a, z: xor(a >> 1, (a & 1) * 3988292384)) from crc where k < length(doc_id::varchar)
),
picked as (select doc_id from crc where k = length(doc_id::varchar) and xor(v, 4294967295::bigint) % 5 = 0),
d as (select row_number() over () as key, doc_id, coalesce('1' || source, '0') as s, {leaf("text")} as h,
      case when doc_id in (select doc_id from picked) then {leaf(lower)} end as forged from documents),
n0 as (select key, doc_id, s, row_number() over (partition by s order by doc_id nulls first, h) - 1 as i, h, forged, count(*) over (partition by s) as c from d),
{", ".join(parts)},
x0 as (select key, s, i, '' as proof, coalesce(forged, h) as f from n0),
{", ".join(walk)}
select n0.doc_id, n0.h as leaf, n{levels}.h as subroot, t{top_levels}.h as root, sha256(proof) as proof_sha256, f as folded_root, f = t{top_levels}.h as verified
from n0 join {at} using (key) join n{levels} on n{levels}.s = n0.s, t{top_levels}
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": _OP1, "op2_secrets": _op2(), "op3_mixing": _op3(), "op10_decontamination": _OP10, "op11_manifest": _op11()}
