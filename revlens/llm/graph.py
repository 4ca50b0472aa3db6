"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revlens.llm import kit


def components(edges: DataFrame, stage: kit.Stage) -> DataFrame:
    """(node, root) for every node of edges (a, b): the root is the smallest node
    of its component.

    Each round hooks every node to its smallest smaller neighbour, follows the
    hooks twice, and contracts the edges; each round's tables are written, so
    lineage stays short. A node with very many neighbours is pre-aggregated by the
    minimum and by the distinct edges.
    """
    every = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = stage.table(every.select("node", F.col("node").alias("root")), "roots")
    left = stage.table(_contracted(edges), "edges")
    while not left.isEmpty():
        hooks = stage.table(left.groupBy("high").agg(F.min("low").alias("low")), "hooks")
        further = hooks.select(F.col("high").alias("low"), F.col("low").alias("lower"))
        jumps = stage.table(
            hooks.join(further, "low", "left").select(
                F.col("high").alias("from"), F.coalesce("lower", "low").alias("to")
            ),
            "jumps",
        )
        renamed = roots.join(jumps, F.col("root") == F.col("from"), "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
        moved = left.join(jumps, F.col("high") == F.col("from")).select("low", F.col("to").alias("a"))
        moved = moved.join(jumps, F.col("low") == F.col("from"), "left").select(
            "a", F.coalesce("to", "low").alias("b")
        )
        old = (roots, left, hooks, jumps)
        roots, left = stage.table(renamed, "roots"), stage.table(_contracted(moved), "edges")
        stage.drop(*old)
    stage.drop(left)
    return roots


def _contracted(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .distinct()
    )
