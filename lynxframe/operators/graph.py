"""Links between nearby points and the connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynxframe.shared import Scratch


def near_pairs(points: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links ``a`` > ``b`` between points (id, integers x and y) of one key that are at most ``radius`` apart.

    Points meet in grid squares of that side: each is sent to its own square and looked for in the nine around it. Points
    at one place should be merged before, as all points of a square are compared.
    """
    square = lambda c: F.floor(F.col(c) / radius)
    own = points.select(*keys, "id", "x", "y", square("x").alias("gx"), square("y").alias("gy"))
    around = F.explode(F.expr("flatten(transform(sequence(-1L, 1L), i -> transform(sequence(-1L, 1L), j -> struct(gx + i as gx, gy + j as gy))))"))
    asked = own.select(*keys, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), around.alias("g")).select("*", "g.*").drop("g")
    close = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y")) <= radius * radius
    return asked.join(own, [*keys, "gx", "gy"]).where((F.col("a") > F.col("id")) & close).select("a", F.col("id").alias("b"))


def connected(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``a``, ``b`` (longs) -> ``node``, ``root``: the smallest node that each linked node reaches.

    Alternating star contractions: each round hangs every node's larger neighbours, then its smaller ones, on the
    smallest node of its neighbourhood, until nothing changes; the number of rounds grows with the logarithm of the
    longest path. Only minima are grouped, so a node with very many links never gathers them in one task. Rounds are
    written to the shared folder, so a lost executor repeats one at most. Links of a node with itself are left out.
    """
    scratch = scratch or Scratch(links.sparkSession, "graph", tidy=False)
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: a node's larger neighbours go to its least.
        large = scratch.save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: a node and its smaller neighbours go to its least.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.withColumnRenamed("m", "v")).distinct()
        small = scratch.save(small)
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.drop(edges, large)
        edges = small
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id``, ``component`` (the smallest id reachable by links ``a``, ``b``) for every node; repeated ids keep their rows."""
    roots = connected(links).withColumnRenamed("node", "id")
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def decided_groups(said: DataFrame, merge: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Groups by decisions ``a``, ``b``, ``decision``: (node, root of all that merges connect; the distinct splits ``a``,
    ``b``, ``root`` whose two sides merges have put into one group, for a human to solve)."""
    roots = connected(said.where(F.col("decision") == merge).select("a", "b"))
    asked = said.where(F.col("decision") == split).select("a", "b").distinct()
    left = asked.join(roots.select(F.col("node").alias("a"), "root"), "a")
    both = left.join(roots.select(F.col("node").alias("b"), F.col("root").alias("other_root")), "b").where("root = other_root")
    return roots, both.select("a", "b", "root")
