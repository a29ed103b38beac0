"""Connected components of an undirected graph, as DataFrames.

Every round hooks each node's parent to the smallest grandparent among its neighbours and then shortens the parent
chains, so the rounds grow with the logarithm of the diameter.  A round is joins and grouped minima; its result is
written to the shared folder, so no lineage builds up and nothing but one row per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.workspace import Workspace


def connected_components(edges: DataFrame, work: Workspace, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` to ``(node, component)``, component being the smallest node reachable.

    Repeated edges, loops and either direction are accepted; edges with a null end are ignored.  Empty in, empty out.
    """
    both = edges.select("u", "v").where("u is not null and v is not null")
    both = both.union(both.select(F.col("v"), F.col("u"))).distinct()
    both = work.table(both, "cc_edges")
    state = work.table(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("f"), F.least("node", "v").alias("gf")),
        "cc_start",
    )
    last = ["cc_start"]
    for k in range(max_rounds):
        near = both.where("u <> v").join(state.select(F.col("node").alias("v"), "gf"), "v").groupBy("u").agg(F.min("gf").alias("near"))
        seen = state.join(near, state["node"] == near["u"], "left")
        low = F.least("near", "gf", "f")
        moves = seen.select(F.explode(F.array(F.struct(F.col("node").alias("node"), low.alias("f")), F.struct(F.col("f").alias("node"), low.alias("f")))).alias("m"))
        hooked = work.table(moves.groupBy(F.col("m.node").alias("node")).agg(F.min("m.f").alias("f")), f"cc_hooked{k}")
        above = hooked.select(F.col("node").alias("f"), F.col("f").alias("gf"))
        fresh = hooked.join(above, "f").select("node", "f", "gf")
        old = state.select("node", F.col("f").alias("f0"), F.col("gf").alias("gf0"))
        fresh = work.table(fresh.join(old, "node").select("node", "f", "gf", ((F.col("f") != F.col("f0")) | (F.col("gf") != F.col("gf0"))).alias("moved")), f"cc_round{k}")
        done = fresh.where("moved").limit(1).count() == 0
        work.drop(f"cc_hooked{k}", *last)
        last, state = [f"cc_round{k}"], fresh
        if done:
            return state.select("node", F.col("f").alias("component"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
