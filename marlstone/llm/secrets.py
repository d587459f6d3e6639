"""Secret scans over an incremental ledger of content-addressed blobs; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length; kinds in the order in which equal starts sort.
#: ``hex`` and ``access`` carry their least length in the pattern, which gives the same maximal runs and no short ones.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
RULES = (
    ("assign", ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    # the method's own rules: key blocks and signed web tokens
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
BASE_KINDS = ("assign", "access", "hex")
#: Version of each rule: a changed rule gets a new one, and only its pairs with the blobs are scanned again.
VERSIONS = {rule[0]: "1" for rule in RULES}
#: What every match of a rule contains; a text without it is not searched for that rule. A rule without a hint searches all texts.
HINTS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": "AKIA",
    "hex": "[0-9a-f]{32}",
    "pem": "-----BEGIN",
    "jwt": "eyJ",
}
_FOUND = "array<struct<start:bigint,kind:int,name:string,end:bigint>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def hint_of(text: Column, rules=RULES) -> Column:
    """False only if no rule can match."""
    hints = [HINTS.get(r[0]) for r in rules]
    return F.lit(True) if None in hints else F.coalesce(text.rlike("|".join(hints)), F.lit(False))


def _pairs(rules, versions) -> Column:
    return F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.lit(versions[r[0]]).alias("version")) for r in rules]).cast("array<struct<rule:string,version:string>>")


def unseen_pairs(docs: DataFrame, ledger: DataFrame | None, rules=RULES, versions=VERSIONS) -> DataFrame:
    """(path, blob, todo): the (rule, version) pairs that the ledger lacks for each blob, with one path that holds it.

    The owner of a blob is its least path, found from digests alone. Blobs without such a pair are left out.
    """
    owners = docs.select("path", "blob").groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        return owners.select("path", "blob", _pairs(rules, versions).alias("todo"))
    left = owners.join(ledger.select("blob", "seen"), "blob", "left")
    return left.select("path", "blob", F.array_except(_pairs(rules, versions), F.coalesce("seen", F.array().cast("array<struct<rule:string,version:string>>"))).alias("todo")).where("size(todo) > 0")


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rule, version, start, end) from (blob, text, todo): matches of the rules in ``todo``; code points, end exclusive, leftmost without overlap per rule."""
    per_rule = []
    for kind, pattern, group, least in rules:
        p = F.lit(pattern)
        mine = F.filter("todo", lambda x: x["rule"] == kind)
        found = F.regexp_extract_all("text", p, F.lit(0))
        counts = F.transform(found if group == 0 else F.regexp_extract_all("text", p, F.lit(group)), lambda m: F.length(m) >= least)
        # split() leaves the pieces between matches, so lengths of pieces and matches add up to positions
        gaps = F.transform(F.split("text", pattern, -1), lambda x: F.length(x))
        per_rule.append(
            F.when(
                (F.size(mine) > 0) & F.col("text").rlike(pattern),
                F.struct(
                    F.lit(kind).alias("rule"), mine[0]["version"].alias("version"),
                    F.arrays_zip(gaps.alias("gap"), F.transform(found, lambda m: F.length(m)).alias("len"), counts.alias("ok")).alias("parts"),
                ),
            )
        )
    hits = blobs.select("blob", F.explode(F.filter(F.array(*per_rule), lambda x: x.isNotNull())).alias("h")).select("blob", "h.rule", "h.version", F.posexplode("h.parts").alias("i", "m")).distinct()
    before = F.expr("sum(m.gap + coalesce(m.len, 0)) over (partition by blob, rule order by i rows between unbounded preceding and current row)")
    placed = hits.select("blob", "rule", "version", "m", before.alias("e"))
    return placed.where("m.ok").select("blob", "rule", "version", (F.col("e") - F.col("m.len")).cast("long").alias("start"), F.col("e").cast("long").alias("end"))


def findings_of(findings: DataFrame, rules=RULES, versions=VERSIONS) -> DataFrame:
    """(blob, found): one row for each blob with findings of the given rule versions; spans sorted by start, then rule as listed."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r[0]), F.lit(k))]) if rules else F.create_map().cast("map<string,int>")
    now = findings.where(F.array_contains(_pairs(rules, versions), F.struct("rule", "version")))
    span = F.struct("start", order[F.col("rule")].alias("kind"), F.col("rule").alias("name"), "end")
    return now.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(_FOUND).alias("found"))


def scan_secrets(
    df: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, findings: DataFrame | None = None, rules=RULES, versions: dict[str, str] = VERSIONS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan every version of every path against the ledger.

    Returns (rows, ledger, findings): the rows of ``df`` with ``blob`` and ``found`` (array of start, kind, name, end,
    empty if none), the ledger (blob, seen array of (rule, version)) and the findings (blob, rule, version, start, end) to
    keep for the next run. Given an earlier ledger, which only counts together with its findings, only unseen pairs of blob
    and rule version are scanned; findings of the given rule versions are joined back to all paths, those of withdrawn
    rules and older versions stay in the table alone. Null text is the empty blob; a path may have many versions, a null
    path counts as the empty one and rows may repeat (a repeated row is the same version); other columns pass through
    whatever their names (``blob`` and ``found`` are replaced); an empty table gives empty results. Texts are searched
    whole; only those in which a rule's hint stands move.
    """
    if (ledger is None) != (findings is None):
        raise ValueError("a ledger tells what need not be scanned again only together with its findings")
    names = [c for c in df.columns if c not in ("blob", "found")]
    docs = df.select(F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    todo = unseen_pairs(docs, ledger, rules, versions)
    new = scan_blobs(docs.where(hint_of(F.col("text"), rules)).join(todo, ["path", "blob"]).select("blob", "text", "todo"), rules)
    every = new if findings is None else findings.select("blob", "rule", "version", "start", "end").unionByName(new)
    seen = docs.select("blob").distinct().select("blob", _pairs(rules, versions).alias("seen"))
    if ledger is not None:
        seen = ledger.select("blob", "seen").unionByName(seen).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"))
    rows = df.select(*[df[c] for c in names], blob_of(df[text_col]).alias("blob"))
    may = hint_of(F.col(text_col), rules)
    none = F.array().cast(_FOUND)
    hit = rows.where(may).join(findings_of(every, rules, versions), "blob", "left").select(*names, "blob", F.coalesce("found", none).alias("found"))
    return hit.unionByName(rows.where(~may).select(*names, "blob", none.alias("found"))), seen, every


def span_list(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(rows: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``rows`` of :func:`scan_secrets` with every found span replaced by ``mark``; overlapping spans become one.

    Texts without findings stay as they are, nulls included; rows and other columns pass through.
    """
    x = F.col(text_col)
    # fold over the sorted spans: text so far and the position up to which the input is used
    step = F.aggregate(
        "found",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(
            s["end"] <= a["at"], a
        ).otherwise(
            F.struct(
                F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(x, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).alias("out"),
                s["end"].alias("at"),
            )
        ),
    )
    done = F.concat(step["out"], F.substring(x, (step["at"] + 1).cast("int"), F.length(x)))
    return rows.withColumn(text_col, F.when(F.size("found") > 0, done).otherwise(x))
