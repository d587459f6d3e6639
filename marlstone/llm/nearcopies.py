"""Near copies by SimHash, completed to an exact Jaccard similarity of 0.8: fingerprint links first, then a prefix filter that loses no pair.

At a similarity of 0.8 fingerprints of 64 bits differ by ten bits and more, where neither bit ranges nor pivot tables prune.
So fingerprints of five-word shingles give the first groups (every link verified), and the pairs still apart are found by
shingles: any near pair shares one among the first fifth of both sets, in whatever one order of all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import chunks, discard, materialise, mix, small_batches, word_hashes, words_of
from marlstone.llm.components import connected_components
from marlstone.llm.simhash import majority, near_links

#: Words of a shingle; two sets are near if 5 * common >= 4 * all (similarity 0.8). Shingles are told apart by 64-bit hashes.
WIDTH = 5
#: A shingle in the prefixes of more sets than about HOT goes last in the first order of all shingles, so that rarer ones
#: stand for them. Any one order loses no pair, so this is judged on one row in SAMPLE only.
HOT, DEMOTIONS, SAMPLE = 512, 3, 8
#: Rounds in which the members of a bucket are compared with one of them, before all pairs still apart are.
STARS = 2
TILE = 1024
#: Parity bits of a set, 64 in a column: enough that they tell apart sets of some thousand shingles.
BITS = tuple(f"b{i}" for i in range(16))
_PLACES = np.random.default_rng(17).integers(1, 2**63, WIDTH).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> set[bytes]:
    """Distinct runs of WIDTH words (a shorter text is one run; a text without words has none)."""
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))}


def similar(a: set, b: set) -> bool:
    common = len(a & b)
    return 5 * common >= 4 * (len(a) + len(b) - common)


def prefix_size(n):
    """Elements of a set of n of which at least one must be in any near set: all but 4/5, and one."""
    return n - (4 * n + 4) // 5 + 1


def spare(n):
    """By how much the first prefixes are longer: so many more shingles must be common there."""
    return n // 8


def _hash_sets(texts) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; many texts at once."""
    for part in chunks(pd.DataFrame({"t": texts}), "t"):
        word, first = word_hashes(part["t"].tolist())
        run = np.zeros(len(word), np.uint64)
        for j in range(WIDTH):
            run[: len(word) - j] += word[j:] * _PLACES[j]
        run = mix(run)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
            if e - s >= WIDTH:
                yield np.unique(run[s : e - WIDTH + 1])
            else:
                yield mix(np.array([np.sum(word[s:e] * _PLACES[: e - s]) + np.uint64(e - s)], np.uint64)) if e > s else np.zeros(0, np.uint64)


def _described(df: DataFrame, hot: np.ndarray) -> DataFrame:
    """(row, n, digest of the set, fingerprint, prefix, parity bits of 1024 bins) of the shingle set of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, h in zip(b["row"], _hash_sets(b["text"])):
                n = len(h)
                d = xxhash.xxh3_128_digest(h.tobytes())
                fp = np.uint64(majority(h)).view(np.int64) if n else 0
                bits = np.packbits((np.bincount((h & np.uint64(64 * len(BITS) - 1)).astype(np.int64), minlength=64 * len(BITS)) & 1).astype(np.uint8)).view(np.int64).tolist()
                if len(hot) and n:
                    late = np.isin(h, hot, assume_unique=True)
                    h = np.concatenate([h[~late], h[late]])
                out.append((row, n, d, fp, h[: prefix_size(n) + spare(n)].view(np.int64) if n else h.view(np.int64), *bits))
            yield pd.DataFrame(out, columns=["row", "n", "digest", "fp", "prefix", *BITS])

    return df.select("row", "text").mapInPandas(run, "row long, n int, digest binary, fp long, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS))


def _hot(texts: DataFrame) -> np.ndarray:
    """Shingles that head many sets of a sample of rows, those included that come up once the first ones are last."""
    some = materialise(texts.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0))
    hot = np.zeros(0, np.uint64)
    for _ in range(DEMOTIONS):
        keys = _described(some, hot).dropDuplicates(["digest"]).select(F.explode("prefix").alias("key"))
        found = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(1, HOT // SAMPLE)).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)
        if not len(np.setdiff1d(found, hot)):
            break
        hot = np.union1d(found, hot)
    return hot


def _whole_sets(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, n, h): all shingle hashes of the given rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = [x.view(np.int64) for x in _hash_sets(b["text"])]
            yield pd.DataFrame({"row": b["row"], "n": np.array([len(x) for x in h], np.int32), "h": h})

    return texts.join(rows, "row", "left_semi").select("row", "text").mapInPandas(run, "row long, n int, h array<long>")


def _by_rarity(sets: DataFrame) -> DataFrame:
    """(row, key, central): prefixes of ``sets(row, n, h)`` with the rarest shingles first, and how common all of a set are.

    Shingles of one set only head its prefix but can be shared with none, so only the rest of the prefix is returned.
    """
    keys = sets.select("row", "n", F.explode("h").alias("key"))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = keys.join(counts, "key").groupBy("row").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "key"))).alias("s"), F.sum(F.log2("c")).alias("sum"))
    size = F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1
    left = (size - (F.col("n") - F.size("s"))).cast("int")
    heads = shared.where(left > 0).select("row", (F.col("sum") / F.col("n")).alias("central"), F.explode(F.slice("s", F.lit(1), left)).alias("x"))
    return heads.select("row", "central", "x.key")


def _possible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and parity bits leave possible: each shingle in one set only flips one bin's parity."""
    of = lambda c: facts.select(*[F.col(x).alias(f"{c}_{x}" if x != "row" else c) for x in ("row", "n", *BITS)])
    flips = sum((F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in BITS), F.lit(0))
    both = F.col("a_n") + F.col("b_n")
    near = (5 * F.least("a_n", "b_n") >= 4 * F.greatest("a_n", "b_n")) & (flips <= both - 2 * F.floor((4 * both + 8) / 9))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows of ``sets(row, h)`` that are near."""
    of = lambda c: sets.select(F.col("row").alias(c), F.col("h").alias(f"{c}_h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["a_h"], b["b_h"]):
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(5 * common >= 4 * (len(both) - common))
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_h", "b_h").mapInPandas(run, "a long, b long")


def _tile_pairs(x: np.ndarray) -> np.ndarray:
    """Pairs of one tile (rows of row, n, comp and bits) in different components that sizes and parity bits leave possible."""
    x = x[np.argsort(x[:, 1], kind="stable")]
    row, n, comp, bits = x[:, 0], x[:, 1], x[:, 2], x[:, 3:].view(np.uint64)
    reach = np.searchsorted(n, n * 5 // 4, side="right")
    out = []
    step = max(1, (1 << 16) // len(x))
    for s in range(0, len(x), step):
        i = np.arange(s, min(s + step, len(x)))
        j = np.arange(s, reach[i].max())
        p, q = np.nonzero((j[None, :] > i[:, None]) & (j[None, :] < reach[i][:, None]) & (comp[i][:, None] != comp[j][None, :]))
        p, q = i[p], j[q]
        both = n[p] + n[q]
        near = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64) <= both - 2 * ((4 * both + 8) // 9)
        out.append(np.stack([row[p[near]], row[q[near]]], axis=1))
    return np.sort(np.concatenate(out), axis=1)


def _pairs_apart(live: DataFrame) -> DataFrame:
    """All possible pairs of each bucket that lie in different components; buckets over TILE members are cut into tiles of two parts."""
    sizes = live.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("parts"))
    tiles = (
        live.join(sizes, "key")
        .withColumn("mine", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "row", "n", "comp", *BITS)
        .repartition("key", "p", "q")
        .sortWithinPartitions("key", "p", "q")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def solve(x: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
            got = [_tile_pairs(x[s:e, 3:]) for s, e in zip([0, *cuts[:-1]], cuts) if e - s > 1]
            arr = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *got]), axis=0)
            return pd.DataFrame({"a": arr[:, 0], "b": arr[:, 1]})

        for b in batches:  # a tile may span batches: keep the last one until the next begins
            x = b.to_numpy(np.int64)
            x = x if held is None else np.concatenate([held, x])
            if not len(x):
                continue
            cut = np.flatnonzero((x[1:, :3] != x[:-1, :3]).any(axis=1)) + 1
            held = x[cut[-1] if len(cut) else 0 :]
            yield solve(x, cut)
        if held is not None:
            yield solve(held, np.array([len(held)]))

    return tiles.mapInPandas(run, "a long, b long").distinct()


def _fingerprint_links(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows of ``sets(row, fp)`` whose fingerprints link: equal ones with the least row of theirs, others over those."""
    own = sets.groupBy("fp").agg(F.min("row").alias("rep"))
    equal = sets.join(own, "fp").where("row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b"))
    named = lambda c: own.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_row"))
    near = near_links(own.select("fp")).join(named("a"), "a").join(named("b"), "b").select(F.col("a_row").alias("a"), F.col("b_row").alias("b"))
    return equal.unionByName(near)


def _apart(live: DataFrame) -> DataFrame:
    """The rows of ``live(key, row, comp, ...)`` in buckets that hold several components."""
    keys = live.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return live.join(keys, "key", "left_semi")


def _partnered(sets: DataFrame) -> DataFrame:
    """The rows of ``sets(row, n, prefix)`` that share enough of their prefix with other sets to have a near one among them."""
    # one exchange by key, no join: a key in over about HOT prefixes has been put last, so these groups are small
    of_key = Window.partitionBy("key")
    keys = sets.select(F.explode("prefix").alias("key"), "row").withColumn("lo", F.min("row").over(of_key)).withColumn("hi", F.max("row").over(of_key))
    counts = keys.where("lo < hi").groupBy("row").agg(F.count(F.lit(1)).alias("c"))
    # the least partner has 4/5 of the size, and so many spare shingles
    need = F.floor(F.ceil(4 * F.col("n") / 5) / 8) + 1
    return counts.join(sets.select("row", "n"), "row").where(F.col("c") >= need).select("row")


def near_groups(df: DataFrame) -> DataFrame:
    """(row, root) for every row of ``df`` (row long, unique; text): root is one row of its group, linked by similarities of 0.8 or more.

    Equal sets are one; null and word-free texts are one group. Fingerprints of the shingle sets that differ in four bits or
    fewer give the first candidates, by :func:`simhash.near_links`. Prefixes in hash order tell who can have a partner at all:
    with ``spare`` more shingles in both prefixes a near pair has at least as many more in common. Among those sets meet in
    buckets of their rarest shingles. There each member is compared with the most common set of the bucket, and buckets that
    hold several components after that compare all pairs across them. Every link is verified. An empty table gives an empty
    result; very long texts are taken whole.
    """
    small_batches(df.sparkSession)
    texts = df.select("row", "text")
    meta = materialise(_described(texts, _hot(texts)))
    same = materialise(meta.groupBy("digest").agg(F.min("row").alias("rep")))
    reps = same.select(F.col("rep").alias("row"))
    facts = meta.select("row", "n", *BITS)
    close = materialise(_possible(_fingerprint_links(meta.select("row", "fp").join(reps, "row", "left_semi")), facts))
    rows = materialise(_partnered(meta.select("row", "n", "prefix").join(reps, "row", "left_semi")).union(close.select("a")).union(close.select("b")).distinct())
    sets = materialise(_whole_sets(texts, rows))
    heads = materialise(_by_rarity(sets))
    facts = facts.join(rows, "row", "left_semi")
    found, labels = [], None
    for turn in range(STARS + 1):
        live = heads.withColumn("comp", F.col("row"))
        if labels is not None:
            live = heads.join(labels, heads["row"] == labels["node"], "left").select("key", "row", "central", F.coalesce("root", "row").alias("comp"))
        live = materialise(_apart(live))
        if turn and live.isEmpty():
            break
        if turn < STARS:
            first_of = F.col("central") if turn == 0 else F.xxhash64("row", F.lit(turn))
            centre = live.groupBy("key").agg(F.max(F.struct(first_of.alias("h"), "row", "comp")).alias("m"))
            met = live.join(centre, "key").where("comp <> m.comp").select(F.least("row", "m.row").alias("a"), F.greatest("row", "m.row").alias("b")).distinct()
            pairs = _possible(met, facts)
            if turn == 0:
                pairs = pairs.union(close).distinct()
        else:
            pairs = _pairs_apart(live.select("key", "row", "comp").join(facts, "row"))
        found.append(materialise(_verified(pairs, sets)))
        links = found[0]
        for more in found[1:]:
            links = links.unionByName(more)
        labels = connected_components(links)
        heads = live.select("key", "row", "central")
    discard(close, sets, *found, live)
    named = same.join(labels, same["rep"] == labels["node"], "left").select("digest", F.coalesce("root", "rep").alias("rep"))
    return meta.select("row", "digest").join(named, "digest").select("row", F.col("rep").alias("root"))
