"""Connected components of an edge list by alternating large-star and small-star steps.

Both steps are a grouped minimum (with map-side combine) and a join back; the edge list
never leaves the executors.  A hot node's edges sit on the streamed side of a sort-merge
join whose partitions adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u")
    if small:
        # u > v throughout: hang u and all its neighbours on the least neighbour
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        # hang every neighbour above u on the least of u and its neighbours
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any orderable type -> ``(node, root)`` for every node that has an edge.

    ``root`` is the least node of the component.  Self loops and nulls are ignored; an empty
    edge list gives an empty result.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = cut(edges), None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or (before is not None and before == state):
            break
        before = state
        edges = cut(_star(_star(edges, small=False), small=True))
    else:
        raise RuntimeError("connected components did not converge")
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
