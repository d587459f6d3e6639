import random

import corpus_pipeline
import pytest
from marlstone.llm import nearcopies
from pyspark.sql import functions as F

from tests.llm.conftest import prose


def edited(rng, text, share):
    """A copy with a run of words replaced, so that about ``share`` of the shingles of both is common to both."""
    words = text.split()
    k = max(1, round(len(words) * (1 - share) / (1 + share)) - 4)
    at = rng.randint(5, len(words) - k - 5)
    return " ".join(words[:at] + [f"new{rng.random()}" for _ in range(k)] + words[at + k :])


def brute_groups(texts):
    sets = [nearcopies.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (not sets[i] and not sets[j] or sets[i] and sets[j] and nearcopies.similar(sets[i], sets[j])):
                old = root[i]
                root = [root[j] if r == old else r for r in root]
    return root


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_against_brute_force(spark, monkeypatch, edge_texts, small):
    rng = random.Random(8)
    line = prose(rng, 14)
    base = [prose(rng, rng.randint(60, 160)) for _ in range(15)]
    texts = edge_texts[:40] + [b + " " + line for b in base] + base + base[:3]
    texts += [edited(rng, b, s) for b in base for s in (0.7, 0.78, 0.82, 0.87, 0.92, 0.95)]
    if small:  # demoted shingles and tiles of few members
        monkeypatch.setattr(nearcopies, "HOT", 3)
        monkeypatch.setattr(nearcopies, "SAMPLE", 1)
        monkeypatch.setattr(nearcopies, "TILE", 4)
        monkeypatch.setattr(nearcopies, "STARS", 0)
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = {r["row"]: r["root"] for r in nearcopies.near_groups(df).collect()}
    want = brute_groups(texts)
    assert len(got) == len(texts)
    pairs = {(got[i], want[i]) for i in range(len(texts))}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs}) < len(texts)


def test_hashed_sets_follow_the_shingles(edge_texts):
    texts = [*edge_texts, "a b c d", "a b c d e", "A  b c\td", "a b c d e f a b c d e f"]
    sets, got = [nearcopies.shingles(t) for t in texts], [set(h.tolist()) for h in nearcopies._hash_sets(texts)]
    assert [len(x) for x in got] == [len(x) for x in sets]
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(sets[i] & sets[j])


def test_run_removes_planted_near_copies_and_keeps_null_and_repeated_ids(spark, monkeypatch, tmp_path):
    rng = random.Random(9)
    base = [prose(rng, 120) for _ in range(8)]
    near = [edited(rng, b, 0.82 + 0.015 * i) for i, b in enumerate(base)]
    single = [prose(rng, 90) for _ in range(4)]
    assert all(nearcopies.similar(nearcopies.shingles(a), nearcopies.shingles(b)) for a, b in zip(base, near))
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(near)] + [(None, single[0]), (None, single[1]), (7, single[2]), (7, single[3])]
    docs = spark.createDataFrame([(i, t, "en", "s1") for i, t in rows], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] == "near_dedup"])
    got = sorted((r["text"], r["doc_id"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [t for t, _ in got] == sorted(base + single)
    assert sum(i is None for _, i in got) == 2 and all(i is None or i < 100 for _, i in got)
