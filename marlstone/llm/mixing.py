"""Mix sources to target weights: budgets flow down a domain-language-source tree, leaves give seeded token prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise

#: Target weights of domains and of languages within each domain; what is not listed weighs DEFAULT_WEIGHT.
DOMAIN_WEIGHTS = {"d0": 4.0, "d1": 2.0, "d2": 1.0, "d3": 1.0}
LANG_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
DEFAULT_WEIGHT = 1.0
#: Passes over a leaf at most; its capacity is that many times its tokens.
MAX_EPOCHS = 4
SEED = "mix-1"
#: Hex digits of the seeded order that name a bucket: only a leaf's boundary bucket is sorted row by row.
BUCKET_DIGITS = 3


def domain_of(source: Column) -> Column:
    """Four domains from the number in a source's name (no number: d0)."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.when(number != "", number).cast("int"), F.lit(0)) % 4)


def weight_of(key: Column, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(DEFAULT_WEIGHT)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[key], F.lit(DEFAULT_WEIGHT))


def share(nodes: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Divide each parent's ``budget`` among its children by ``w``, none above its ``cap``; adds ``give``.

    Children sorted by cap / w fill first: a child is full if the level at which it fills costs its parent no more than the
    budget; the rest share what is left by weight. A shortage thus goes to siblings before it shows in the parent's cap.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    run = by.orderBy(F.col("cap") / F.col("w"), *order).rowsBetween(Window.unboundedPreceding, -1)
    level = F.col("cap") / F.col("w")
    n = (
        nodes.withColumn("_c", F.coalesce(F.sum("cap").over(run), F.lit(0.0)))
        .withColumn("_w", F.sum("w").over(by) - F.coalesce(F.sum("w").over(run), F.lit(0.0)))
        .withColumn("_full", F.col("_c") + level * F.col("_w") <= F.col("budget"))
    )
    open_w = F.sum(F.when(~F.col("_full"), F.col("w"))).over(by)
    full_c = F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(by), F.lit(0.0))
    give = F.when(F.col("_full"), F.col("cap")).otherwise(F.greatest(F.lit(0.0), (F.col("budget") - full_c) * F.col("w") / open_w))
    return n.withColumn("give", F.least(give, F.col("cap"))).drop("_c", "_w", "_full")


def budgets(leaves: DataFrame, total: Column, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, target long) from (domain, lang, source, tokens); ``total`` is the token budget.

    ``leaves`` has one row for each source, so these windows hold the tree's nodes, never documents. Nulls are nodes too.
    """
    cap = F.col("tokens").cast("double") * max_epochs
    leaf = leaves.where("tokens > 0").withColumn("cap", cap)
    lang = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    dom = lang.groupBy("domain").agg(F.sum("cap").alias("cap"))
    whole = leaf.agg(total.cast("double").alias("budget"))
    dom = share(dom.withColumn("w", weight_of(F.col("domain"), domain_weights)).crossJoin(F.broadcast(whole)), [], ["domain"])
    lang = lang.join(dom.select(F.col("domain").alias("_d"), F.col("give").alias("budget")), F.col("domain").eqNullSafe(F.col("_d"))).drop("_d")
    lang = share(lang.withColumn("w", weight_of(F.col("lang"), lang_weights)), ["domain"], ["lang"])
    up = lang.select(F.col("domain").alias("_d"), F.col("lang").alias("_l"), F.col("give").alias("budget"))
    leaf = leaf.join(up, F.col("domain").eqNullSafe(F.col("_d")) & F.col("lang").eqNullSafe(F.col("_l"))).drop("_d", "_l")
    leaf = share(leaf.withColumn("w", F.lit(1.0)), ["domain", "lang"], ["source"])
    return leaf.select("domain", "lang", "source", "tokens", F.floor(F.col("give") + 1e-6).cast("long").alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None,
                budget_share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: str = SEED, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS) -> DataFrame:
    """The rows of ``df`` that the mixture uses, with the struct ``mix``: domain, n_tokens, epochs, extra_tokens, taken.

    The budget is ``budget_share`` of all tokens (words between white space). A leaf whose target is k times its tokens and
    some more gives every text k whole epochs, and in epoch k the prefix of its seeded order that holds the rest: the text
    at the cut gives ``extra_tokens`` of its first tokens. taken = epochs * n_tokens + extra_tokens; rows with taken = 0
    are not returned. Texts without tokens (null, empty) cost nothing and are not returned. Null languages and sources
    are leaves of their own; repeated rows are taken as often as they stand (their order among each other is by id, then
    arbitrary); other columns pass through (``mix`` is replaced); an empty table gives an empty result.
    """
    names = [c for c in df.columns if c != "mix"]
    dom = domain if domain is not None else domain_of(df[source_col])
    rows = df.select(
        *[df[c] for c in names],
        F.struct(
            dom.alias("domain"), df[lang_col].alias("lang"), df[source_col].alias("source"),
            F.regexp_count(F.coalesce(df[text_col], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
            F.col(id_col).cast("string").alias("id"),
        ).alias("_m"),
    )
    small = rows.select("_m.*")
    leaves = small.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens"))
    leaf = budgets(leaves, F.floor(F.sum("tokens") * budget_share), domain_weights, lang_weights, max_epochs)
    # one row a leaf, written so that its size is known: Spark broadcasts it only below its threshold, else it deals both sides
    leaf = materialise(leaf.select("domain", "lang", "source", F.floor(F.col("target") / F.col("tokens")).cast("int").alias("epochs"), (F.col("target") % F.col("tokens")).alias("rest")))
    key = lambda m: F.sha2(F.concat_ws(":", F.lit(seed), m["epochs"].cast("string"), F.coalesce(m["id"], F.lit(""))), 256)
    same = lambda a, b: a["domain"].eqNullSafe(b["_domain"]) & a["lang"].eqNullSafe(b["_lang"]) & a["source"].eqNullSafe(b["_source"])
    named = leaf.select(F.col("domain").alias("_domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "epochs", "rest")
    m = {c: F.col(c) for c in ("domain", "lang", "source", "n_tokens", "id", "epochs", "rest")}
    # tokens of each bucket of the seeded order, and the bucket in which a leaf's rest ends
    ordered = small.join(named, same(small, named)).drop("_domain", "_lang", "_source").withColumn("bucket", F.substring(key(m), 1, BUCKET_DIGITS))
    sums = ordered.groupBy("domain", "lang", "source", "bucket").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("domain", "lang", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0)))
    cut = sums.where("before <= rest and before + t > rest").select(F.col("domain").alias("_domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("bucket").alias("cut"), "before")
    plan = named.join(cut.select(*[F.col(c).alias(f"x{c}") for c in ("_domain", "_lang", "_source")], "cut", "before"), F.col("_domain").eqNullSafe(F.col("x_domain")) & F.col("_lang").eqNullSafe(F.col("x_lang")) & F.col("_source").eqNullSafe(F.col("x_source")), "left").drop("x_domain", "x_lang", "x_source")
    plan = materialise(plan)
    r = rows.withColumns({"_d": F.col("_m.domain"), "_l": F.col("_m.lang"), "_s": F.col("_m.source")})
    r = r.join(plan, F.col("_d").eqNullSafe(F.col("_domain")) & F.col("_l").eqNullSafe(F.col("_lang")) & F.col("_s").eqNullSafe(F.col("_source"))).drop("_d", "_l", "_s")
    h = key({"epochs": F.col("epochs"), "id": F.col("_m.id")})
    r = r.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    at_cut = F.col("_b") == F.col("cut")
    w = Window.partitionBy(F.when(at_cut, F.lit(1)), "_domain", "_lang", "_source").orderBy("_h", F.col("_m.n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    inside = r.where(at_cut).withColumn("_run", F.col("before") + F.coalesce(F.sum("_m.n_tokens").over(w), F.lit(0)))
    extra_cut = F.greatest(F.lit(0), F.least(F.col("_m.n_tokens"), F.col("rest") - F.col("_run")))
    outside = r.where(~at_cut | F.col("cut").isNull()).withColumn("_extra", F.when(F.col("_b") < F.col("cut"), F.col("_m.n_tokens")).otherwise(F.lit(0)))
    both = outside.unionByName(inside.withColumn("_extra", extra_cut).drop("_run"))
    n = F.col("_m.n_tokens")
    out = both.select(*names, F.struct(F.col("_m.domain").alias("domain"), n.alias("n_tokens"), F.col("epochs"), F.col("_extra").cast("long").alias("extra_tokens"), (F.col("epochs") * n + F.col("_extra")).cast("long").alias("taken")).alias("mix"))
    return out.where("mix.taken > 0")
