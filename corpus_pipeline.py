"""Corpus pipeline: quality rules, near-copy removal by shingle similarity, benchmark decontamination, secret redaction, source mixing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; :func:`run` applies them to
``documents``, each stage written to the shared folder and read again. Stages read the columns of COLUMNS and return them,
so extra columns, whatever their names, go. An empty table gives an empty table of the same columns. Nulls may stand in any
column, ids may repeat; what each stage makes of them is stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, mixing, nearcopies, quality, secrets
from marlstone.llm.common import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The chain is not expressible in SQL (fingerprints, suffix arrays): tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: short, null and empty texts and those that consist of repeats.

    Rows are judged one by one, so repeated rows and ids share their fate; a null id, language or source plays no part.
    """
    return quality.quality_rules(docs).where("quality.kept").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: the one with the smallest id.

    Rows have keys of their own here, so null and repeated ids lose nothing; a null id goes last within its group, ties and
    repeated rows leave one of them. Null and word-free texts are copies of each other.
    """
    rows = materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    groups = nearcopies.near_groups(rows)
    first = rows.select("row", "doc_id").join(groups, "row").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m"))
    return rows.join(first.select("m.row"), "row", "left_semi").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that consist mostly of them go.

    Null and empty texts have no words and stay; n_chars follows the text; repeated rows are treated alike.
    """
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _documents(decontaminate.remove_spans(found))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes, repeated rows and null texts included."""
    rows, _, _ = secrets.scan_secrets(docs)
    return _documents(secrets.redact(rows))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture uses, with how often and how much of each.

    Texts without words cost nothing and go; null languages and sources are leaves of their own; repeated rows count as often
    as they stand.
    """
    mixed = mixing.mix_sources(docs)
    return mixed.select(*COLUMNS, "mix.domain", "mix.n_tokens", "mix.epochs", "mix.extra_tokens", "mix.taken")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
