import hashlib
import random
import zlib

import pytest
from marlstone.llm import manifest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, path string, levels int"
BITS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]])


def reduce_(level, fanout):
    out = [level]
    while len(level) > 1:
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        out.append(level)
    return out


def brute(rows, fanout=16):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    towers = {}
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        groups[s], towers[s] = mine, reduce_([leaf_of(r) for r in mine], fanout)
    top = reduce_([towers[s][-1][0] for s in order], fanout)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            proof, at, levels = "", i, towers[s][:-1]
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf_of((*r[:4], r[4].translate(lower) if forged and r[4] else r[4]))
            for tower, at in ((levels, i), (top[:-1], k)):
                for level in tower:
                    a = at // fanout * fanout
                    run = level[a : a + fanout]
                    proof += "".join(x for j, x in enumerate(run) if j != at - a)
                    now = h(*[now if j == at - a else x for j, x in enumerate(run)])
                    at //= fanout
            root = top[-1][0]
            out.append((r[0], leaf_of(r), towers[s][-1][0], root, h(proof), now, now == root))
    return sorted(out, key=str)


def run(df, **k):
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    got = manifest.verified(manifest.manifest(df, tampered={"text": manifest.lower_cased(F.col("text"))}, when=picked, **k))
    return sorted([tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcXYZ é") for _ in range(rng.randint(0, 12)))
    out = [(rng.randint(-(10**18), 10**18), rng.choice(["hot", "hot", "ß", "a", "Z", ""]), "en", 3, word()) for _ in range(500)]
    out += [(i, "dense", None, None, word()) for i in range(300)]
    out += [(7, "dense", None, None, "same")] * 40 + [(None, None, "de", 1, "A"), (None, "a", "de", 1, None), (5, None, "de", None, "")]
    return out + [(9, "lone", "en", 0, "X" * 300_000), (-(2**63), "a", "x", 1, "Q"), (2**63 - 1, "a", "x", 1, "Q")] + [(i, "seventeen", "en", 1, "B") for i in range(17)]


def test_manifest(spark, rows):
    assert run(table(spark, rows)) == brute(rows)


def test_buckets_are_parted_where_keys_differ(spark, rows):
    """Buckets of ten keys at most: dense and sparse ids, one id many times, equal rows."""
    assert run(table(spark, rows), aim=8, most=10, fanout=3) == brute(rows, 3)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_small_tables(spark, n):
    few = [(i, "s", "en", 1, "T") for i in range(n)]
    assert run(table(spark, few)) == brute(few) if few else run(table(spark, few)) == []


def test_ranks(spark):
    rng = random.Random(5)
    keys = {("g%d" % (i % 3), "%x" % rng.randrange(16 ** rng.randint(1, 12))) for i in range(3000)}
    got = manifest.ranked(spark.createDataFrame(list(keys), "grp string, key string"), aim=4, most=20).collect()
    for g in ("g0", "g1", "g2"):
        mine = sorted(k for x, k in keys if x == g)
        assert {r["key"]: (r["rank"], r["n"]) for r in got if r["grp"] == g} == {k: (i, len(mine)) for i, k in enumerate(mine)}


def test_columns_and_bounds(spark, rows):
    with pytest.raises(ValueError):
        manifest.manifest(table(spark, rows[:3]), fanout=1)
    got = manifest.manifest(table(spark, rows[:3]), columns=("text",)).collect()
    assert {r["leaf"] for r in got} == {h(f"{len(r[4].encode())}:{r[4]}") for r in rows[:3]} and {r["tampered"] for r in got} == {None}
