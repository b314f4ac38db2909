"""Connected components by contraction: every round maps each node to the
smallest label nearby and keeps only edges between different labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import drop, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node.

    edges: two columns of one orderable type. Null ends, loops and repeated
    edges have no effect; an empty table gives an empty result. Each round is
    hash aggregations and equi-joins (AQE splits a hub's partition), and its
    state is a table in the shared folder, so no round is recomputed. The
    number of nodes with edges at least halves per round.
    """
    x, y = F.col(a), F.col(b)
    e = materialize(edges.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), x.isNotNull().alias("l"), y.isNotNull().alias("r"))
                    .where("l and r and a < b").select("a", "b").distinct(), "cc-edges")
    kind = e.schema["a"].dataType
    mapping = None
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        first = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        jump = first.select(F.col("u").alias("p"), F.col("p").alias("q"))
        label = materialize(first.join(jump, "p").select("u", F.col("q").alias("p")), "cc-label")
        la, lb = label.select(F.col("u").alias("a"), F.col("p").alias("pa")), label.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        nxt = materialize(e.join(la, "a").join(lb, "b").where("pa <> pb")
                          .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        if mapping is None:
            new = label
        else:
            step = label.select(F.col("u").alias("p"), F.col("p").alias("q"))
            new = materialize(mapping.join(step, "p", "left").select("u", F.coalesce("q", "p").alias("p")), "cc-map")
            drop(mapping)
            drop(label)
        drop(e)
        e, mapping = nxt, new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    drop(e)
    if mapping is None:
        return edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    return mapping.select(F.col("u").alias("node"), F.col("p").alias("component"))
