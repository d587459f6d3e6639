"""SimHash near-duplicates: 64-bit fingerprints, pivot distance tables, connected groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, small_batches, words_of
from marlstone.llm.components import connected_components

#: Differing bits that link two fingerprints at most; the bit ranges below are complete for so many.
BITS = 4
#: Fingerprints that share a key of all ranges but BITS, on average, before more and narrower ranges give longer keys.
CROWD = 64
#: Members of one bucket that meet in one task; larger buckets are cut into tiles of pairs of parts.
TILE = 2048
#: Reference fingerprints: fixed random ones; which they are changes the work, never the links.
PIVOTS = np.random.default_rng(5).integers(0, 2**64, 24, dtype=np.uint64)
_TABLE = ("t0", "t1", "t2")  # distances to eight pivots each, a byte a distance


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 (seed 42) hashes of the word shingles; repeats count."""
    words = words_of(text)
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[s:e], 42) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 13):
        part = hashes[i : i + (1 << 13)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((total * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprinter(width: int):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long) for every row; null, empty and word-free texts have fp 0. Only the text goes to Python."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), _fingerprinter(width)(F.col(text_col)).alias("fp"))


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fps(fp)`` with its Hamming distances to all pivots, written once: every later comparison reads this table."""
    cols = []
    for k, name in enumerate(_TABLE):
        part = PIVOTS[8 * k : 8 * k + 8].view(np.int64).tolist()
        packed = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i) for i, p in enumerate(part)]
        cols.append(sum(packed[1:], packed[0]).alias(name))
    return materialise(fps.select("fp", *cols))


def ranges(n: int) -> list[tuple[int, int]]:
    """(start, length) of the bit ranges for ``n`` fingerprints: six, and more once keys would be shared by over CROWD."""
    count = BITS + 2
    while count < 12 and n > CROWD << (64 * (count - BITS) // count):
        count += 1
    edge = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def _links(fp: np.ndarray, table: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over one tile: the pivot table discards pairs, popcount verifies survivors."""
    order = np.argsort(table[:, 0], kind="stable")
    every, table = fp[order], table[order]
    root = list(range(len(every)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    first = table[:, 0]
    reach = np.searchsorted(first, first + bits, side="right")
    for i in range(len(every)):
        e = reach[i]
        if e <= i + 1:
            continue
        near = np.arange(i + 1, e)
        for lo in (slice(1, 8), slice(8, 24)):
            near = near[np.abs(table[near, lo] - table[i, lo]).max(axis=1) <= bits]
            if not len(near):
                break
        if len(near):
            near = near[np.bitwise_count(every[near] ^ every[i]) <= bits]
            for j in near.tolist():
                p, q = find(i), find(j)
                if p != q:
                    root[q] = p
                    out.append((int(every[i]), int(every[j])))
    return out


def near_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps(fp)`` at ``bits`` (4 at most) or fewer differing bits, enough to connect every group.

    A pair that differs in at most four of r bit ranges agrees on the others, so it meets in one of the buckets keyed by all
    ranges but four; r grows with the number of fingerprints, so buckets do not. The pivot table gives each fingerprint's
    distances to the reference fingerprints: a pair whose distances to any of them differ by more than ``bits`` cannot be
    near (triangle inequality) and is discarded, survivors are verified. Each tile returns a spanning forest, never all
    pairs. Buckets over TILE members are cut into parts and handled as tiles of two parts, in many tasks. Nulls and
    repeats are left out; an empty table gives no links.
    """
    if bits > BITS:
        raise ValueError(f"the bit ranges prove completeness for {BITS} differing bits at most")
    table = pivot_table(fps.where("fp is not null").select("fp").distinct())
    part = lambda r: F.shiftrightunsigned(F.col("fp"), r[0]).bitwiseAND(F.lit((1 << r[1]) - 1))
    blocks, keys = ranges(table.count()), []
    for n, kept in enumerate(combinations(blocks, len(blocks) - BITS)):
        key = F.lit(n).cast("long")
        for r in kept:
            key = F.shiftleft(key, r[1]).bitwiseOR(part(r))
        keys.append(key)
    rows = table.select("fp", *_TABLE, F.explode(F.array(*keys)).alias("key"))
    # a row for each pair of parts in buckets over TILE members, else one
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / F.lit(TILE)).cast("int"))
    tiles = (
        rows.join(sizes.select("key", "parts"), "key")
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "fp", *_TABLE)
        .repartition("key", "p", "q")
        .sortWithinPartitions("key", "p", "q")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def solve(x: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
            fp = x[:, 3].view(np.uint64)
            table = np.ascontiguousarray(x[:, 4:]).view(np.int8)
            found = [p for s, e in zip([0, *cuts[:-1]], cuts) if e - s > 1 for p in _links(fp[s:e], table[s:e], bits)]
            arr = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
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


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = BITS) -> DataFrame:
    """(id_col, fingerprint string, component_id) for every row of ``df``.

    component_id is the smallest id reachable over fingerprint links, the row itself included. Null and word-free texts
    have fingerprint zero and link like any other; repeated rows stay repeated; rows with a null id take part but give no
    component_id; other columns are ignored, so clashing names do no harm; an empty table gives an empty result.
    Only distinct fingerprints meet, so thousands of copies count once.
    """
    fp = materialise(fingerprints(df, id_col, text_col, width))
    own = fp.groupBy("fp").agg(F.min("id").alias("least"))
    links = near_links(own.select("fp"), bits)
    comp = connected_components(links)
    named = own.join(comp, own["fp"] == comp["node"], "left").select(own["fp"], "least", F.coalesce("root", own["fp"]).alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialise(named.join(best, "root").select("fp", "component_id"))
    return fp.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
