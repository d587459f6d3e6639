"""Registered queries: each applies library operators to the driver tables and carries its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 4
#: Added before rounding in both engines: means of cents often lie exactly between two rounded values.
NUDGE = 3.7e-7


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, so that the order of sums in either engine does not show."""
    return df.select(*[F.round(F.col(c) + NUDGE, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql_rounded(sql: str, doubles: str = "") -> str:
    if not doubles:
        return sql
    return f"select * replace ({', '.join(f'round({c} + {NUDGE}, {DIGITS}) as {c}' for c in doubles.split())}) from ({sql})"
