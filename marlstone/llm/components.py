"""Connected components of an edge table by repeated minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Return (node, root): root is the smallest node of the component.

    Alternates large-star and small-star rounds, so a chain of n nodes takes O(log n) rounds; every round's edge table is
    written to the shared folder. Hot nodes are summed by the partial minimum before the shuffle. Nulls are ignored;
    self-loops and repeated edges do no harm; an empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialise(e)
    # done once the edge set stands still: compare counts and order-free digests
    stat = lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    was = stat(e)
    if not was["n"]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        # large-star: every node links its larger neighbours to the smallest node it sees
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: every node links itself and its smaller neighbours to the smallest
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        new = materialise(small.where("u <> v").distinct())
        e, now = new, stat(new)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
