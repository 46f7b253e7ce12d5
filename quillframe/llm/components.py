"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum with map-side combine and one join; no node's
neighbours are gathered in one row, and nothing but two numbers per round comes
to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import Workspace


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(u, v)``.

    Returns ``(node, component)``, one row per node that has an edge to another
    node; ``component`` is the smallest node reachable. Null ends and loops are
    ignored, repeated edges count once, no edges give no rows.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = ws.save(e, f"{name}-0")
    state = _state(e)
    for i in range(1, max_rounds + 1):
        if not state[0]:
            break
        # large star: every larger neighbour is tied to the smallest node around
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = ws.save(least, f"{name}-{i}-large")
        wide = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        wide = ws.save(wide, f"{name}-{i}-wide")
        # small star: every node and its smaller neighbours are tied to the smallest of them
        least = ws.save(wide.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{i}-small")
        tied = wide.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = ws.save(tied.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{i}")
        for old in (f"{name}-{i - 1}", f"{name}-{i}-large", f"{name}-{i}-wide", f"{name}-{i}-small"):
            ws.drop(old)
        e, last, state = new, state, _state(new)
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
