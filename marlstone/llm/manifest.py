"""Merkle manifest of a table: ranks from digit histograms, and a trie keyed by the digits of the ranks."""

from __future__ import annotations

import math
import os.path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import discard, materialise

#: Children of a trie node (2 to 36: ranks are written with these many digits).
FANOUT = 16
#: Digits that one exchange reduces: a block holds FANOUT**HELD nodes at most.
HELD = 2
#: Rows that a bucket of keys has on average and at most; a bucket over MOST is parted by its next digits.
AIM, MOST = 1024, 16384
_ALPHABET = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def field(c: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon and value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def id_digits(c: Column) -> Column:
    """A long as text that sorts like it, null first."""
    return F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(c.bitwiseXOR(F.lit(-(2**63)))), 16, "0")), F.lit("0"))


def _shared_digits(lo: Column, hi: Column) -> Column:
    """Number of leading characters that two texts have in common."""
    same = F.transform(F.sequence(F.lit(1), F.length(lo) + 1), lambda i: F.substring(lo, i, F.lit(1)) != F.substring(hi, i, F.lit(1)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(True)), F.lit(0)) - 1, F.length(lo)).cast("int")


def ranked(rows: DataFrame, aim: int = AIM, most: int = MOST) -> DataFrame:
    """(grp, key, ...) with ``rank``, the number of smaller keys of the same group, and ``n``, the rows of the group.

    Keys are texts, none of which occurs twice in a group; they sort bytewise. Histograms of leading characters are
    counted, a bucket of more than ``most`` rows is parted by the characters that follow those all its keys share, and
    offsets run down the trie of buckets. A row then only needs its place within its bucket: nothing is sorted as a whole,
    and a group of any size is dealt over its buckets. ``rows`` is read several times, so it should be a written table.
    """
    total, lo, hi = rows.agg(F.count("*"), F.min("key"), F.max("key")).first()
    start = len(os.path.commonprefix([lo or "", hi or ""]))
    cuts = list(range(start, start + math.ceil(math.log(max(total, 1) / aim, 16)) + 1 if total > aim else start + 1))
    dealt = rows.withColumn("bucket", F.substring("key", 1, cuts[-1]))
    while True:
        hist = materialise(dealt.groupBy("grp", "bucket").agg(F.count("*").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi")))
        full = hist.where(F.col("size") > most).select("grp", "bucket", (_shared_digits(F.col("lo"), F.col("hi")) + 2).alias("depth"))
        depths = [r[0] for r in full.select("depth").distinct().collect()]  # at most one for each character of a key
        if not depths:
            break
        cuts += depths
        # full buckets are large by definition: their rows meet them in 64 slices
        slices = 64
        full = full.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")).join(full, ["grp", "bucket", "slice"], "left")
        dealt = dealt.withColumn("bucket", F.coalesce(F.substring(F.col("key"), F.lit(1), F.col("depth")), "bucket")).drop("slice", "depth")
    # offsets from the top of the trie of buckets: a node has at most 256 children, as a cut adds two digits or none are shared
    at = hist.groupBy("grp").agg(F.sum("size").alias("n")).select("grp", F.lit("").alias("node"), F.lit(0).cast("long").alias("offset"), "n")
    before = 0
    for cut in sorted(set(cuts) - {0}):
        nodes = hist.groupBy("grp", F.substring("bucket", 1, cut).alias("node")).agg(F.sum("size").alias("size")).withColumn("up", F.substring("node", 1, before))
        w = Window.partitionBy("grp", "up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumn("less", F.coalesce(F.sum("size").over(w), F.lit(0)))
        at = nodes.join(at.withColumnRenamed("node", "up"), ["grp", "up"]).select("grp", "node", (F.col("offset") + F.col("less")).alias("offset"), "n")
        before = cut
    placed = dealt.join(at.withColumnRenamed("node", "bucket"), ["grp", "bucket"])
    within = F.row_number().over(Window.partitionBy("grp", "bucket").orderBy("key")) - 1
    return placed.withColumn("rank", F.col("offset") + within).drop("bucket", "offset")


def trie_path(fanout: int = FANOUT) -> Column:
    """Digits of ``rank`` to base ``fanout``, as many as the largest rank of the group has; none for a lone leaf."""
    digits = lambda c: F.lower(F.conv(c.cast("string"), 10, fanout))
    return F.when(F.col("n") == 1, F.lit("")).otherwise(F.lpad(digits(F.col("rank")), F.length(digits(F.col("n") - 1)), "0"))


def _parent(path: str, k: int = 1) -> Column:
    return F.expr(f"substring({path}, 1, greatest(length({path}) - {k}, 0))")


def _reduced(nodes: DataFrame) -> DataFrame:
    """One exchange up the trie: (grp, path, hash, inner) of the blocks over nodes (grp, path, hash, inner), the longest prefixes first."""
    x = nodes.withColumn("block", _parent("path", HELD)).repartition("grp", "block")
    for _ in range(HELD):
        run = F.array_sort(F.collect_list(F.struct("path", "hash", "inner")))
        x = x.groupBy("grp", "block", _parent("path").alias("up")).agg(run.alias("inner"))
        # a node without digits is the top of its group already
        one = F.length(F.col("inner")[0]["path"]) == 0
        joined = F.array_join(F.transform("inner", lambda c: c["hash"]), "")
        x = x.select("grp", "block", F.col("up").alias("path"), F.when(one, F.col("inner")[0]["hash"]).otherwise(F.sha2(joined, 256)).alias("hash"), "inner")
    return x.select("grp", "path", "hash", "inner")


def climb(leaves: DataFrame, longest: int) -> list[DataFrame]:
    """Block tables from the leaves (grp, path, hash, inner) up to one block for each group, each written once."""
    out, nodes = [], leaves
    for _ in range(max(1, math.ceil(longest / HELD))):
        out.append(materialise(_reduced(nodes)))
        nodes = out[-1].select("grp", "path", "hash", F.lit(None).cast("int").alias("inner"))
    return out


def descend(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """(grp, path, hash, inner, levels, ...) of the leaves: ``levels`` holds, from the leaf up, the hashes of its run and its place there.

    ``above`` has the levels over the top of each group (grp, levels, ...); other columns go down to the leaves.
    """
    levels = above.withColumn("path", F.lit(""))
    for k, table in enumerate(reversed(tables)):
        x = table.drop("hash").join(levels, ["grp", "path"]).drop("path")
        for _ in range(HELD):
            x = x.withColumn("run", F.transform("inner", lambda c: c["hash"]))
            x = x.select(*[c for c in x.columns if c not in ("inner", "path", "hash")], F.posexplode("inner").alias("at", "node"))
            step = F.array(F.struct("run", "at"))
            x = x.withColumn("levels", F.when(F.length("node.path") == 0, F.col("levels")).otherwise(F.concat(step, "levels")))
            x = x.withColumn("inner", F.col("node.inner")).withColumn("path", F.col("node.path")).withColumn("hash", F.col("node.hash")).drop("at", "node", "run")
        levels = x if k == len(tables) - 1 else x.drop("hash", "inner")
    return levels


def proof_of(levels: Column) -> Column:
    """Digest of the siblings along the levels, left to right."""
    others = F.transform(levels, lambda v: F.array_join(F.filter(v["run"], lambda h, i: i != v["at"]), ""))
    return F.sha2(F.array_join(others, ""), 256)


def fold(leaf: Column, levels: Column) -> Column:
    """Root that follows from a leaf and the siblings along its levels."""
    join = lambda a: F.array_join(a, "")
    up = lambda acc, v: digest(join(F.slice(v["run"], 1, v["at"])), acc, join(F.slice(v["run"], v["at"] + 2, F.size(v["run"]))))
    return F.aggregate(levels, leaf, up)


def leaf_of(df: DataFrame, columns: tuple[str, ...], replaced: dict[str, Column] | None = None) -> Column:
    return digest(*[field((replaced or {}).get(c, df[c])) for c in columns])


def manifest(
    df: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source",
    tampered: dict[str, Column] | None = None, when: Column | None = None, fanout: int = FANOUT, aim: int = AIM, most: int = MOST,
) -> DataFrame:
    """One row for each row of ``df``: id, group, ``leaf``, ``subroot``, ``root``, ``levels``, and ``tampered``.

    Leaves of one group ascend by id, null first; rows with equal ids by their leaf; equal rows take places next to each
    other, in any order. A null group is a group of its own, before all others. ``tampered`` is the leaf with the given
    columns replaced where ``when`` holds, else null. Nulls in any column, empty and very long texts are leaves like any
    other; only the named columns are read, so others and their names play no part. An empty table gives an empty manifest.
    Texts are read once and only their digests move.
    """
    if not 2 <= fanout <= 36:
        raise ValueError("fanout must be 2 to 36")
    group = F.coalesce(F.concat(F.lit("1"), df[group_col].cast("string")), F.lit("0"))
    forged = F.when(F.lit(False) if when is None else when, leaf_of(df, columns, tampered))
    rows = df.select(df[id_col].cast("long").alias("id"), group.alias("grp"), leaf_of(df, columns).alias("hash"), forged.alias("tampered"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows)
    key = F.concat(id_digits(F.col("id")), F.col("hash"), F.lpad(F.hex("row"), 16, "0"))
    placed = ranked(rows.select("*", key.alias("key")), aim, most)
    inner = F.struct("id", "tampered")
    leaves = placed.select("grp", trie_path(fanout).alias("path"), "hash", inner.alias("inner"))
    most_of_one = rows.groupBy("grp").count().agg(F.max("count")).first()[0] or 1
    tables = climb(leaves, _digits(most_of_one, fanout))
    discard(rows)
    # the subroots are the leaves of one more trie, in order of their groups
    tops = materialise(tables[-1].select(F.lit("").alias("grp"), F.hex("grp").alias("key"), F.col("grp").alias("inner"), "hash"))
    top_leaves = ranked(tops, aim, most).select("grp", trie_path(fanout).alias("path"), "hash", "inner")
    top_tables = climb(top_leaves, _digits(tops.count(), fanout))
    none = F.array().cast("array<struct<run:array<string>,at:int>>")
    root = top_tables[-1].select("grp", none.alias("levels"), F.col("hash").alias("root"))
    groups = descend(top_tables, root).select(F.col("inner").alias("grp"), "levels", "root", F.col("hash").alias("subroot"))
    out = descend(tables, groups)
    name = F.when(F.substring("grp", 1, 1) == "1", F.expr("substring(grp, 2)"))
    return out.select(F.col("inner.id").alias(id_col), name.alias(group_col), F.col("hash").alias("leaf"), "subroot", "root", "levels", F.col("inner.tampered").alias("tampered"))


def _digits(n: int, fanout: int) -> int:
    """Digits of the largest of ``n`` ranks (none for a lone leaf)."""
    k = 0
    while fanout**k < n:
        k += 1
    return k


def verified(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of :func:`manifest` with ``proof_sha256``, the root folded from the tampered leaf (else the leaf), and whether it is the root."""
    folded = fold(F.coalesce("tampered", "leaf"), F.col("levels"))
    out = rows.select(id_col, "leaf", "subroot", "root", proof_of(F.col("levels")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_cased(c: Column) -> Column:
    return F.translate(c, *_ALPHABET)
