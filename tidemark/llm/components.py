"""Connected components of an edge table by alternating stars.

Large stars hang every larger neighbour of a node on the smallest node around it, small stars do the
same with smaller neighbours; a few rounds (the logarithm of the longest chain) leave one star per
component. Every round is a grouped minimum, combined before its shuffle, and a join that adaptive
execution can split where a centre is hot; it ends in a staged table. The driver sees one count and
one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_staged, stage_table


def _hang(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Edges (neighbour, smallest node around u) for the edges (u, v)."""
    least = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")).withColumnRenamed("u", "_u")
    joined = edges.join(least, F.col("u") == F.col("_u"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if larger_only else joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of the edges; root is the smallest node it reaches."""
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = stage_table(start, "edges")
    before = None
    while True:
        n, mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == (n, mark):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = (n, mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, larger_only=True).where("u <> v")
        small = _hang(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), larger_only=False)
        after = stage_table(small.where("u <> v").distinct(), "edges")
        drop_staged(now)
        now = after
