"""Connected components of a link table, by rounds of large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merklake.sources.scratch import materialize


def _stars(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest node around it, then every node's smaller ones and itself."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    large = materialize(large, "large_star")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return materialize(small.union(least).where("a != b").distinct(), "small_star")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node in `links` (a, b: bigint, a != b).

    A round halves the distance to the smallest node at least, and nodes with many links cost no more than their links:
    minima are taken before the shuffle, and the joins may be split by adaptive execution. Rounds end when nothing changes.
    """
    state = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if now == seen:
            break
        seen, state = now, _stars(state)
    nodes = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)


def extend(grouped: DataFrame | None, links: DataFrame) -> DataFrame:
    """`components` of the links behind `grouped` (node, component) and of more: only links between different components are
    followed, each component as one node."""
    if grouped is None:
        return components(links)
    known = grouped.withColumnRenamed("component", "known")
    for side in ("a", "b"):
        links = links.join(known.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("known", side)).drop("known")
    merged = materialize(components(links.where("a != b").select("a", "b")), "merged")
    renamed = merged.select(F.col("node").alias("known"), "component")
    old = known.join(renamed, "known", "left").select("node", F.coalesce("component", "known").alias("component"))
    return old.unionByName(merged.join(grouped, "node", "left_anti"))
