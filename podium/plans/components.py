"""Connected components of an edge table, by contraction.

Each round every node points at its least neighbour (or itself), pointers are
jumped until they reach roots, edges are relabelled by root and deduplicated.
The number of live nodes at least halves per round and a star is finished in
one.  Aggregations combine map-side, and every join has a freshly exchanged
table on both sides, so adaptive execution may split a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from podium.plans.scratch import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node on a link; component is its least node.

    Null ends and self-links are ignored, repeated links count once, an empty
    edge table gives an empty result.  Only ``src`` and ``dst`` are read.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    a, b = F.col(src), F.col(dst)
    live = scratch.table(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    labels = None
    while True:
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = scratch.table(
            both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("p")), "parent"
        )
        if labels is not None and parent.isEmpty():
            break
        while True:
            up = parent.select(F.col("u").alias("m"), F.col("p").alias("g"))
            hop = scratch.table(
                parent.join(up, F.col("p") == F.col("m")).select("u", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")),
                "hop",
            )
            moved = not hop.where("moved").isEmpty()
            scratch.drop(parent)
            parent, parent_path = hop.select("u", "p"), hop
            parent._podium_path = parent_path._podium_path
            if not moved:
                break
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
            old = None
        else:
            old = labels
            labels = scratch.table(
                labels.join(parent, F.col("component") == F.col("u"), "left").select("node", F.coalesce("p", "component").alias("component")),
                "labels",
            )
        ru = parent.select("u", F.col("p").alias("ru"))
        rv = parent.select(F.col("u").alias("v"), F.col("p").alias("rv"))
        nxt = scratch.table(
            live.join(ru, "u").join(rv, "v").where("ru <> rv")
            .select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct(),
            "edges",
        )
        scratch.drop(live, old)
        live = nxt
        if live.isEmpty():
            break
    return labels
