"""A folder that all executors share, for results that are written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if the session names it; on one machine else a folder made here. A cluster without it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='marlstone-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/marlstone/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
