"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.session import materialize


def component_roots(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; ``root`` is its component's least node.

    A forest of parents is kept, at first every node its own.  A round hooks each root
    below the least root it meets over an edge, then halves all paths until every node
    points at a root; edges inside one tree drop out.  About log n rounds, each written to
    the shared folder; it ends when no edge joins two trees, never by a round limit.
    """
    links = materialize(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    parents = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                          .select("node", F.col("node").alias("root")))
    while links.limit(1).count():
        # links join roots; of two the larger is hooked, below the least it meets
        hooks = links.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("low")) \
            .groupBy("child").agg(F.min("low").alias("low"))
        hooks = materialize(hooks)
        while True:
            up = hooks.select(F.col("child").alias("low"), F.col("low").alias("next"))
            stepped = materialize(hooks.join(up, "low", "left").select("child", F.coalesce("next", "low").alias("low"),
                                                                       F.col("next").isNotNull().alias("moved")))
            hooks = stepped.select("child", "low")
            if not stepped.where("moved").limit(1).count():
                break

        def lifted(df: DataFrame, col: str) -> DataFrame:
            found = hooks.select(F.col("child").alias(col), F.col("low").alias("_low"))
            return df.join(found, col, "left").withColumn(col, F.coalesce("_low", col)).drop("_low")

        parents = materialize(lifted(parents, "root").select("node", "root"))
        links = materialize(lifted(lifted(links, "a"), "b").where(F.col("a") != F.col("b")).select("a", "b").distinct())
    return parents
