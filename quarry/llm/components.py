"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.storage import Scratch, join_groups


def _star(pairs: DataFrame, both: bool, scratch: Scratch, name: str) -> DataFrame:
    """One half-step: every node u points its neighbours at the least of them and itself."""
    low = scratch.keep(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), name)
    joined = join_groups(pairs, low, "u")
    if both:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    links = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return links.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is its least node.

    First every node keeps its least neighbour below, and its other neighbours are tied to
    that one: nodes that nobody is tied to are leaves and wait aside. On the core that
    remains, large and small stars alternate: each round sends a node's larger neighbours,
    then its smaller ones, to its least neighbour, until every component is a star. Rounds
    grow with the logarithm of the longest path; hubs are joined in slices. ``name`` names
    the intermediates. Self-links and repeats are allowed; no edges give no rows.
    """
    down = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tied = scratch.keep(down.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs")), f"{name}_tied")
    # Nodes with the same neighbours below tie them together once.
    cross = tied.where(F.size("bs") > 1).select("bs").distinct()
    cross = cross.select(F.explode(F.slice("bs", F.lit(2), F.size("bs") - 1)).alias("a"), F.get("bs", F.lit(0)).alias("b"))
    tree = tied.select("a", F.get("bs", F.lit(0)).alias("b"))
    cross = scratch.keep(cross.distinct(), f"{name}_cross")
    inner = tree.select(F.col("b").alias("n")).distinct().unionByName(cross.select(F.col("a").alias("n"))).distinct()
    core = tree.join(inner, tree["a"] == inner["n"], "left_semi").unionByName(cross)
    leaves = scratch.keep(tree.join(inner, tree["a"] == inner["n"], "left_anti"), f"{name}_leaves")

    now = scratch.keep(core.distinct(), f"{name}0")
    mark, turn = None, 0
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(found) == mark or not found[0]:
            break
        mark, turn = tuple(found), turn + 1
        ways = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        large = _star(ways.unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v"))), True, scratch, f"{name}_all{turn}").where("a != b").distinct()
        lower = scratch.keep(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), f"{name}_large{turn}")
        now = scratch.keep(_star(lower, False, scratch, f"{name}_low{turn}").where("a != b").distinct(), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}", f"{name}_all{turn}", f"{name}_large{turn}", f"{name}_low{turn}")

    ends = leaves.select("b").distinct()
    ends = ends.join(now.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select("b", F.coalesce("c", "b").alias("component"))
    ends = scratch.keep(ends, f"{name}_ends")
    far = join_groups(leaves, ends, "b").select(F.col("a").alias("node"), "component")
    inside = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    heads = now.select("b").unionByName(ends.where("b = component").select("b")).distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return far.unionByName(inside).unionByName(heads)
