"""Connected components by alternating large-star and small-star.

Both steps are joins and aggregates over an edge table that is written after
each, so lineage stays one step long.  A node that many edges share is hot in
the join on it; `shared.lookup` keeps such rows in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corploom.llm import shared


def _checksum(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, int(r.s or 0)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    if large:
        arcs = edges.select("u", "v").union(edges.select(v.alias("u"), u.alias("v")))
    else:
        arcs = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = shared.lookup(arcs, least, "u")
    if large:
        out = met.where(v > u).select(v.alias("u"), F.col("m").alias("v"))
    else:
        own = least.where(F.col("m") < u).select("u", F.col("m").alias("v"))
        out = met.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).union(own)
    return shared.written(out.where(u != v).distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the least node reachable, for every node on an edge (u, v) of longs."""
    now = shared.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    seen = _checksum(now)
    while seen[0]:
        bigger = _star(now, large=True)
        after = _star(bigger, large=False)
        shared.forget(bigger)
        shared.forget(now)
        now, last, seen = after, seen, _checksum(after)
        if seen == last:
            break
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
