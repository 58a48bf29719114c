"""Connected components by contraction: every round each node adopts its smallest neighbour, parents are
shortened twice, and links are rewritten between parents until none is left.  A star of any size goes in one
round, a path shrinks by a factor a round.  Nothing is collected; each round's tables lie in the shared folder until the next round's
are written.  The leaves of a giant component share their parent: that join keeps hot keys apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.operators.skew import hot_join
from kinmesh.storage import drop, keep

MOST_ROUNDS = 60


def component_minimum(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) of linked nodes; nodes (node, least).  Returns node, root (the smallest node of its
    component), root_least (the smallest non-null least there), for each node that has a link."""
    edges, labels = pairs.select("a", "b"), None
    for n in range(MOST_ROUNDS):
        parents = (
            edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
            .groupBy(F.col("e.u").alias("u"))
            .agg(F.min("e.v").alias("v"))
            .select("u", F.least("u", "v").alias("p"))
        )
        parents = keep(parents, f"parents{n}")
        for _ in range(2):
            up = parents.select(F.col("u").alias("p"), F.col("p").alias("q"))
            old, parents = parents, keep(hot_join(parents, up, "p").select("u", F.col("q").alias("p")), f"parents{n}")
            drop(old)
        old = labels
        if labels is None:
            labels = keep(parents.select(F.col("u").alias("node"), F.col("p").alias("root")), "labels0")
        else:
            labels = keep(labels.join(parents, labels.root == parents.u, "left").select("node", F.coalesce("p", "root").alias("root")), f"labels{n}")
        left = parents.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = parents.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        before, edges = edges, keep(
            edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            f"edges{n}",
        )
        drop(old, before, parents)
        if edges.isEmpty():
            drop(edges)
            break
    else:
        raise RuntimeError(f"components are not done after {MOST_ROUNDS} rounds")
    least = labels.join(nodes, "node").groupBy("root").agg(F.min("least").alias("root_least"))
    return labels.join(least, "root").select("node", "root", "root_least")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices (node), edges (a, b).  Returns node, component (its smallest node) of every vertex; one without
    an edge is its own component."""
    roots = component_minimum(edges.where("a <> b"), vertices.select("node", vertices["node"].alias("least"))).select("node", "root")
    return vertices.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def star_edges(members: DataFrame) -> DataFrame:
    """members (token, node): edges from each node to the smallest of its token; linear, where all pairs would be a clique."""
    members = keep(members.select("token", "node"), "members")
    least = members.groupBy("token").agg(F.min("node").alias("a"))
    return hot_join(members, least, "token").where("node <> a").select("a", F.col("node").alias("b")).distinct()
