"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined map-side) and an equi-join; nothing is
collected, and each round's edges are cut in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
    return int(row["n"]), int(row["x"] or 0)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) as longs -> (node, label): label is the least node of the component. Nodes without an edge are absent; empty input gives an empty result."""
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct()
    e = cut(e, "cc")
    seen = _checksum(e)
    if not seen[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(small.where("u <> v").distinct(), "cc")
        now = _checksum(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    label = e.groupBy("u").agg(F.min("v").alias("label"))
    return label.select(F.col("u").alias("node"), "label").union(label.select(F.col("label").alias("node"), "label").distinct())
