"""Connected components of a table of links, with the smallest id as the name of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitscope.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every id that ``links`` (a, b) names.

    Each round hooks every node to its smallest neighbour, follows the hooks twice, and joins what hooks together,
    which at least halves the nodes that still have links; rounds end when no link between different nodes is left.
    A round is joins and pre-aggregated groupings over written tables, so a node with very many links is no single
    group of rows anywhere.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    edges = written(edges.union(edges.select("v", "u")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        hooks = edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("p"))
        for _ in range(2):
            upper = hooks.select(F.col("u").alias("at"), F.col("p").alias("above"))
            hooks = hooks.join(upper, F.col("p") == F.col("at")).select("u", F.col("above").alias("p"))
        hooks = written(hooks, "hooks")
        upper = hooks.select(F.col("u").alias("at"), F.col("p").alias("above"))
        if found is None:
            found = hooks
        else:
            found = found.join(upper, F.col("p") == F.col("at"), "left").select("u", F.coalesce("above", "p").alias("p"))
        moved = edges.join(upper, F.col("u") == F.col("at")).select(F.col("above").alias("u"), "v")
        moved = moved.join(upper, F.col("v") == F.col("at")).select("u", F.col("above").alias("v"))
        edges = written(moved.where("u <> v").distinct(), "edges")
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.select(F.col("u").alias("node"), F.col("p").alias("component"))
