"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Rounds after which something is wrong: the number needed is logarithmic in the longest path.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node with an edge; edges: a, b (bigint).

    Large-star and small-star steps in turn.  Each is a minimum by node, made in each task first,
    and a join against those minima; every round is written, and the driver sees one count and
    checksum a round.
    """
    held = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        both = held.union(held.select("v", "u"))
        # The minima are written: as a table of its own, a join with them can be split at a hub's edges.
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "edges")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "edges")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, held = held, written(small.select("e.*").filter("u <> v").distinct(), "edges")
        discard(before, low, large, least)
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return held.select(F.col("u").alias("node"), F.col("v").alias("label")).union(held.select("v", "v").distinct())
