"""Connected components by repeated contraction: each round hooks every vertex to its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, hot_keys, split_join


def connected_components(tables: Tables, links: DataFrame) -> DataFrame:
    """(node, component) for every vertex of links (a, b longs); component is the smallest vertex reachable.

    Each round replaces the graph by the graph of its hooked groups, so the edges shrink until none is left;
    a star takes one round and a path of n vertices about log n. A vertex with very many edges, and a component with very many
    vertices, are split in the joins that they key. Empty links give no rows.
    """
    edges = tables.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = tables.write(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("to"), F.count(F.lit(1)).alias("n")), "hooks")
        hot = hot_keys(tables, hook, "v")  # no more vertices hook to one than it has edges
        named = lambda c: None if hot is None else hot.withColumnRenamed("v", c)  # noqa: B023, E731
        hooked = split_join(hook.select("v", "to"), hook.select(F.col("v").alias("to"), F.col("to").alias("to2")), ["to"], named("to"), ["v"], "left")
        hook2 = tables.write(hooked.select("v", F.coalesce("to2", "to").alias("to")), "jumps")
        if labels is None:
            grown = hook2.select(F.col("v").alias("node"), F.col("to").alias("component"))
        else:
            crowds = hot_keys(tables, labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
            grown = split_join(labels, hook2.select(F.col("v").alias("component"), "to"), ["component"], crowds, ["node"], "left").select("node", F.coalesce("to", "component").alias("component"))
        grown = tables.write(grown, "labels")
        a, b = hook2.select(F.col("v").alias("a"), F.col("to").alias("x")), hook2.select(F.col("v").alias("b"), F.col("to").alias("y"))
        shrunk = split_join(split_join(edges, a, ["a"], named("a"), ["b"]), b, ["b"], named("b"), ["a"]).where("x <> y")
        shrunk = tables.write(shrunk.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        tables.drop(edges, hook, hook2, *([labels] if labels is not None else []))
        edges, labels = shrunk, grown
    tables.drop(edges)
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component")).where("false")
