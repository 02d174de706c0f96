"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges point from the larger vertex to the smaller and stay distributed. A round
replaces each edge's smaller end by the least vertex next to that end (large
star), then ties all smaller neighbours of a vertex to the least of them (small
star). Callers number likely hubs low: a vertex with many edges is then mostly a
smaller end, which a join that skew handling can split looks up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from refsieve.llm.common import written


def _round(edges: DataFrame) -> DataFrame:
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    large = edges.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).repartition("u")
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every vertex of ``edges`` (u, v), root being the component's least vertex.

    Each round writes its edges to the shared folder and counts them on the way.
    No edges: no rows. Loops and repeated edges change nothing. ``rounds`` is far
    above the logarithm of any component's size and only guards against a fault:
    running out raises.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = written(now.distinct(), "edges")
    mark = None
    for _ in range(rounds):
        seen = Observation()
        sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        now = written(_round(now).observe(seen, *sums), "stars")
        before, mark = mark, seen.get
        if before == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
    raise RuntimeError("components did not settle")
