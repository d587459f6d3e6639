"""Every stage of the pipeline against a brute-force version, on nulls, empty and long texts, ties, repeats and extra columns."""

import random
import re

import corpus_pipeline
import duckdb
import pyarrow as pa
import pytest
from marlstone.llm import nearcopies, quality
from marlstone.llm import queries as q
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tests.llm.test_nearcopies import brute_groups, edited
from tests.llm.test_text_operators import brute_hits, brute_quality, brute_secrets

COLUMNS = list(corpus_pipeline.COLUMNS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, null_ids=True):
    out = []
    for i, t in enumerate(texts):
        doc_id = None if null_ids and i % 13 == 5 else 2**53 + i if i % 5 else 2**53 + i - 1
        out.append((doc_id, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 7 else None, None if t is None else len(t)))
    return out + out[3:5]


@pytest.fixture(scope="module")
def texts(edge_texts):
    rng = random.Random(12)
    base = [prose(rng, rng.randint(60, 140)) for _ in range(10)]
    near = [edited(rng, b, s) for b in base[:5] for s in (0.7, 0.83, 0.93)]
    looped = [(prose(rng, 12) + " ") * 9, prose(rng, 150) + " " + (passage := prose(rng, 80)) + " x " + passage]
    secret = [f"{base[0]} password = hunter2hunter2 {base[1]} AKIA{'A' * 16}", "token=secret:longvalue123 " + base[2]]
    return edge_texts + base + near + looped + secret


@pytest.fixture(scope="module")
def items(edge_texts, texts):
    return [("a1", " ".join((edge_texts[4] or "").split()[:25])), ("a2", edge_texts[5]), (None, texts[3]), ("a4", None), ("a5", ""), ("a6", " ".join(texts[-1].split()[5:40]))]


def key(row):
    return [(x is None, x or 0 if not isinstance(x, str) else x) for x in row]


def collected(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=key)


def longest_repeat(text):
    w = re.split(r"[\x20\x09-\x0d]+", (text or "").strip(" \t\n\v\f\r"))
    best = 0
    while len({tuple(w[i : i + best + 1]) for i in range(len(w) - best)}) < len(w) - best:
        best += 1
    return best, len(w)


def brute_quality_stage(rows):
    out = []
    for r in rows:
        if not brute_quality(r[1])[-1]:
            longest, n = longest_repeat(r[1])
            if not (longest >= quality.LONGEST_WORDS and longest > quality.LONGEST_SHARE * n):
                out.append(r)
    return out


def brute_dedup_stage(rows):
    root, best = brute_groups([r[1] for r in rows]), {}
    for g, r in zip(root, rows):
        if g not in best or key(r[:1]) < key(best[g][:1]):
            best[g] = r
    return list(best.values())


def brute_decontamination(rows, items):
    """(row, words left) of the rows that stay."""
    items = [(i, t) for i, t in items if i is not None]
    for r in rows:
        n, hit, _ = brute_hits(r[1], items)
        if 2 * len(hit) <= n:
            words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) if w]
            yield r, [w for k, w in enumerate(words) if k not in hit], bool(hit)


def brute_redacted(text):
    if text is None:
        return None
    out, at = "", 0
    for s, _, _, e in brute_secrets(text):
        if e <= at:
            continue
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = e
    return out + text[at:]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def with_extras(df):
    """Extra columns whose names clash with those the operators use."""
    clash = ["quality", "hits", "found", "blob", "mix", "row", "key", "root", "fp", "lm"]
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


def test_quality_stage(spark, texts):
    rows = rows_of(texts)
    want = sorted(brute_quality_stage(rows), key=key)
    assert 0 < len(want) < len(rows)
    assert collected(corpus_pipeline.quality_stage(spark, with_extras(frame(spark, rows)), "")) == want


def test_near_dedup_stage(spark, texts):
    rows = rows_of(texts)
    got = collected(corpus_pipeline.dedup_stage(spark, with_extras(frame(spark, rows)), ""))
    want = brute_dedup_stage(rows)
    # ties of the smallest id leave any one of them
    assert sorted((r[0] for r in got), key=lambda x: key([x])) == sorted((r[0] for r in want), key=lambda x: key([x]))
    sets = [nearcopies.shingles(r[1]) for r in got]
    assert not any(a and b and nearcopies.similar(a, b) for i, a in enumerate(sets) for b in sets[:i])


def test_decontamination_stage(spark, texts, items, tmp_path):
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = rows_of(texts)
    got = collected(corpus_pipeline.decontamination_stage(spark, with_extras(frame(spark, rows)), str(tmp_path)))
    want = list(brute_decontamination(rows, items))
    assert len(got) == len(want) < len(rows) and any(hit for *_, hit in want)
    words = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    left = lambda r, w: (key(r[:1]), key(r[2:4]), w)
    assert sorted(left(r, words(r[1])) for r in got) == sorted(left(r, w) for r, w, _ in want)
    same = {key_ for r, _, hit in want if not hit for key_ in [(r[0], r[1])]}
    assert same <= {(r[0], r[1]) for r in got} and all(r[4] == (None if r[1] is None else len(r[1])) for r in got)


def test_secret_stage(spark, texts):
    rows = rows_of(texts)
    got = collected(corpus_pipeline.secret_stage(spark, with_extras(frame(spark, rows)), ""))
    want = [(i, t := brute_redacted(text), lang, source, None if t is None else len(t)) for i, text, lang, source, _ in rows]
    assert got == sorted(want, key=key) and any("[SECRET]" in (r[1] or "") for r in got)


def test_mixing_stage(spark, texts):
    rows = [(i, *r[1:]) for i, r in enumerate(rows_of(texts))]
    got = corpus_pipeline.mixing_stage(spark, with_extras(frame(spark, rows)), "")
    assert got.columns == [*COLUMNS, "domain", "n_tokens", "epochs", "extra_tokens", "taken"]
    con = duckdb.connect()
    documents = pa.table({c: [r[k] for r in rows] for k, c in enumerate(COLUMNS)})  # noqa: F841  read by name
    con.sql("create table documents as select * from documents")
    want = con.sql(f"select doc_id, domain, lang, source, n_tokens, epochs, extra_tokens, taken from ({q.oracle_sql()['op3_mixing']})").fetchall()
    names = ("doc_id", "domain", "lang", "source", "n_tokens", "epochs", "extra_tokens", "taken")
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=key) == sorted(want, key=key)
    by = {r[0]: r for r in rows}
    assert all(tuple(r[c] for c in COLUMNS) == by[r["doc_id"]] for r in got.collect())


def test_stages_of_empty_tables(spark, items, tmp_path):
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path))
        assert got.columns[: len(COLUMNS)] == COLUMNS and got.count() == 0, name


def test_run_is_the_chain_of_its_stages(spark, texts, items, tmp_path):
    rows = rows_of(texts)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r for r, _, _ in brute_decontamination(brute_dedup_stage(brute_quality_stage(rows)), items)]
    ids = lambda rs: sorted((r[0] for r in rs), key=lambda x: key([x]))
    # capacity is four epochs, so a mixture of all tokens leaves no leaf out but by its weight
    left = ids(kept)
    for x in ids(got):
        left.remove(x)
    assert len(got) > 0 and sum(r["taken"] for r in got) > 0
