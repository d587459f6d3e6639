"""URL filters: host and path rules, and gradient-boosted trees on lexical features; DataFrame functions and Spark ML only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the production query: verdict, host and path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Labelled rows that the trees are fitted on at most, picked by a seeded hash of the URL.
FIT_ROWS = 20_000
#: Labelled examples beside the rows that rules label (1: block), so that a rule-free table still has both kinds.
SEED_URLS = (
    ("http://free-pills.example.biz/buy/now?aff=8812&sid=99", 1), ("http://casino-bonus.example.info/win/77777", 1), ("http://cheap-watches.example.com/deal.php?id=1&ref=2&src=3", 1),
    ("http://x9k2q7z1.example.xyz/a/b/c/d/e/f?q=1&r=2&s=3&t=4", 1), ("http://spam-offers.example.org/click?u=83743&z=44", 1), ("http://adult-cams.example.net/live/?utm_campaign=x&utm_medium=y", 1),
    ("https://www.example.edu/research/papers", 0), ("https://news.example.com/world/story.html", 0), ("https://library.example.org/catalogue/history", 0),
    ("https://docs.example.net/guide/start", 0), ("https://blog.example.com/posts/autumn", 0), ("https://en.example.org/wiki/article", 0),
)
FEATURES = ("length", "depth", "digit_ratio", "entropy", "n_params", "n_dots", "n_hyphens", "host_length", "path_length", "secure", "suffix_rate", "suffix_count")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.split(_rest(url), "[/?#]", 2)[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = _rest(url)
    authority = F.split(rest, "[/?#]", 2)[0]
    return F.split(F.substring(rest, F.length(authority) + 1, F.length(rest)), "[?#]", 2)[0]


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null if none fits: a literal chain, longest first (for some hundred rules)."""
    kind = "struct<rule:string,verdict:string>"
    out = F.lit(None).cast(kind)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a string."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.coalesce(F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    return {
        "length": F.length(u).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n,
        "entropy": entropy(host),
        "n_params": F.regexp_count(u, F.lit("[?&][^=&#]+=")).cast("double"),
        "n_dots": F.regexp_count(host, F.lit(r"\.")).cast("double"),
        "n_hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "secure": u.startswith("https://").cast("double"),
    }


@dataclass
class UrlModel:
    trees: GBTClassificationModel
    suffixes: DataFrame
    prior: float


def fit_url_model(labelled: DataFrame, url_col: str = "url", label_col: str = "block", rows: int = FIT_ROWS, rounds: int = 20) -> UrlModel:
    """Fit the trees on at most ``rows`` labelled URLs (label 1: block), picked by a seeded hash; suffix statistics use all of them.

    A training row's own label is taken out of its suffix's statistics, so that the trees see what they see of a new URL.
    """
    spark = labelled.sparkSession
    seeds = spark.createDataFrame(list(SEED_URLS), f"{url_col} string, {label_col} int")
    both = labelled.select(url_col, F.col(label_col).cast("int").alias(label_col)).where(f"{url_col} is not null and {label_col} is not null")
    both = both.unionByName(seeds)
    host = host_of(F.col(url_col))
    stats = both.groupBy(F.substring_index(host, ".", -1).alias("suffix")).agg(F.avg(label_col).alias("rate"), F.count(F.lit(1)).cast("double").alias("count"))
    h = F.xxhash64(F.col(url_col), F.lit(7))
    # a hash filter sized by the count leaves about twice the rows wanted, however large the table is
    step = max(1, both.count() // (2 * rows))
    pick = both.where(F.pmod(h, F.lit(step)) == 0).orderBy(h, label_col).limit(rows).repartition(4)
    model = UrlModel(None, stats, 0.5)
    train = _featured(pick, model, url_col, label_col).withColumn("label", F.col(label_col).cast("double"))
    model.trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=4, stepSize=0.2, seed=7, maxBins=32).fit(train.select("features", "label"))
    return model


def _featured(df: DataFrame, model: UrlModel, url_col: str, own: str | None = None) -> DataFrame:
    """Features as a vector; ``own`` names the label of rows that are part of the suffix statistics."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = df.withColumns({f"_f_{k}": v for k, v in lexical(F.col(url_col), host, path).items()} | {"_suffix": F.substring_index(host, ".", -1)})
    stats = model.suffixes.select(F.col("suffix").alias("_s"), "rate", F.col("count").alias("_n"))
    # a suffix's rate is drawn to the prior by as much as twenty rows would
    rows = rows.join(stats, F.col("_suffix") == F.col("_s"), "left")
    n = F.coalesce(F.col("_n"), F.lit(0.0))
    blocked = F.coalesce("rate", F.lit(0.0)) * n
    if own is not None:
        n, blocked = n - 1, blocked - F.col(own)
    rows = rows.withColumn("_f_suffix_rate", (blocked + 20 * model.prior) / (n + 20)).withColumn("_f_suffix_count", F.log1p(n))
    out = VectorAssembler(inputCols=[f"_f_{k}" for k in FEATURES], outputCol="features").transform(rows)
    return out.drop(*[f"_f_{k}" for k in FEATURES], "_suffix", "_s", "rate", "_n")


def judge_urls(df: DataFrame, url_col: str = "url", rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``df`` with the struct ``verdict_of``: host, path, rule, verdict and the trees' score (probability of block).

    The longest fitting rule decides; where none fits the trees do, trained on ``labelled`` (url, block 0/1) or, without it,
    on the URLs that the rules label. Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are
    judged by their features; repeated rows are judged alike; other columns pass through (``verdict_of`` is replaced); an
    empty table gives an empty result.
    """
    names = [c for c in df.columns if c != "verdict_of"]
    url = F.col("_url")
    plain = df.select(F.struct(*[df[c] for c in names]).alias("_row"), df[url_col].alias("_url"))
    rows = plain.withColumn("_host", host_of(F.coalesce(url, F.lit("")))).withColumn("_path", path_of(F.coalesce(url, F.lit(""))))
    rows = rows.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    if labelled is None:
        labelled = rows.where("_rule is not null").select(url.alias("url"), (F.col("_rule.verdict") == "block").cast("int").alias("block"))
    model = fit_url_model(labelled)
    scored = model.trees.transform(_featured(rows, model, "_url"))
    score = vector_to_array("probability")[1]
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(score >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("_row.*", F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), score.alias("score")).alias("verdict_of"))
