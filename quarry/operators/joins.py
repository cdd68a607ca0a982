"""Joins that are more than equality: tiers, containment, nearest value, ranges, mutual best."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tiered_lookup(rows: DataFrame, key: str, dimension: DataFrame, tiers: list[tuple[str, Column, Column, float, float | None]], value: Column) -> DataFrame:
    """rows' key, value, tier, confidence: the first tier with a match wins.

    A tier is (name, key of the row, key of the dimension, confidence, confidence if its key
    has several values). All tiers are one equality join on (tier, key), so the dimension
    may be of any size. Empty and null keys match nothing.
    """
    asked = rows.select(key, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), k.alias("k")) for i, (_, k, _, _, _) in enumerate(tiers)))).alias("t")).select(key, "t.i", "t.k").where("k is not null and k != ''")
    offered = dimension.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), k.alias("k"), value.alias("value")) for i, (_, _, k, _, _) in enumerate(tiers)))).alias("t")).select("t.*")
    offered = offered.where("k is not null and k != ''").groupBy("i", "k").agg(F.min("value").alias("value"), F.count_distinct("value").alias("values"))
    found = asked.join(offered, ["i", "k"]).groupBy(key).agg(F.min(F.struct("i", "value", "values")).alias("m"))
    names = F.array(*(F.lit(t[0]) for t in tiers))
    sure, unsure = F.array(*(F.lit(t[3]) for t in tiers)), F.array(*(F.lit(t[3] if t[4] is None else t[4]) for t in tiers))
    out = found.select(key, F.col("m.value").alias("value"), F.get(names, F.col("m.i")).alias("tier"), F.when(F.col("m.values") > 1, F.get(unsure, F.col("m.i"))).otherwise(F.get(sure, F.col("m.i"))).alias("confidence"))
    return rows.join(out, key, "left")


def nearest_value(rows: DataFrame, key: str, value: str, entries: DataFrame, entry_value: str, entry_order: str, columns: list[str], tolerance: float = 0.15) -> DataFrame:
    """rows with the ``columns`` of the entry whose value is nearest, within ``tolerance`` of the row's; ties by order.

    Values fall into logarithmic buckets as wide as the tolerance, so an entry meets only
    rows that it can match: an equality join, whatever the size of either side. Only
    positive values match.
    """
    width = math.log1p(tolerance)
    bucket = lambda c: F.floor(F.ln(F.col(c).cast("double")) / width)
    reach = math.ceil(-math.log1p(-tolerance) / width)
    near = entries.where(F.col(entry_value) > 0).select(F.col(entry_value).alias("_v"), F.col(entry_order).alias("_o"), F.struct(*columns).alias("_e"), F.explode(F.sequence(bucket(entry_value) - 1, bucket(entry_value) + reach)).alias("_b"))
    asked = rows.where(F.col(value) > 0).select(F.col(key).alias("_k"), F.col(value).alias("_x"), bucket(value).alias("_b"))
    off = F.abs(F.col("_v") - F.col("_x"))
    met = asked.join(near, "_b").where(off <= F.col("_x") * F.lit(tolerance))
    best = met.groupBy("_k").agg(F.min(F.struct(off.alias("off"), "_o", "_e")).alias("m")).select("_k", "m._e.*")
    # Neither side may be small: Spark misjudges rows that explode() made, and would gather them in the driver.
    return rows.join(best.hint("merge"), rows[key] == best["_k"], "left").drop("_k")


def contains_match(rows: DataFrame, key: str, text: Column, keywords: DataFrame, most_listed: int = 1000) -> DataFrame:
    """key, target, keyword: the first keyword, in the keywords' order, that a text contains.

    keywords (ord, keyword, target). Up to ``most_listed`` of them are one array that every
    text is held against. More are joined by their first letters: each text offers its
    distinct runs of as many letters as the shortest keyword has, four at most. Both ways give
    the same rows. Empty keywords match nothing.
    """
    keywords = keywords.where("keyword != ''").select("ord", "target", "keyword")
    if keywords.limit(most_listed + 1).count() <= most_listed:
        listed = keywords.agg(F.array_sort(F.collect_list(F.struct("ord", "target", "keyword"))).alias("k")).scalar()
        held = rows.select(key, text.alias("_t"), listed.alias("_k"))
        found = held.select(key, F.get(F.filter("_k", lambda k: F.contains(F.col("_t"), k["keyword"])), F.lit(0)).alias("m"))
        return found.where("m is not null").groupBy(key).agg(F.min("m").alias("m")).select(key, "m.target", "m.keyword")
    n = min(4, keywords.agg(F.min(F.length("keyword"))).first()[0])
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
    offered = rows.select(key, text.alias("_t"), F.explode(runs).alias("_g"))
    met = offered.join(keywords.withColumn("_g", F.substring("keyword", 1, n)), "_g").where(F.contains(F.col("_t"), F.col("keyword")))
    return met.groupBy(key).agg(F.min(F.struct("ord", "target", "keyword")).alias("m")).select(key, "m.target", "m.keyword")


def in_ranges(points: DataFrame, point: str, ranges: DataFrame, first: str, last: str, on: list[str], step: int) -> DataFrame:
    """Points joined with the ranges (both ends included) of their group that hold them.

    Ranges are listed once for each ``step`` of numbers they touch, so the join is one of
    equality; choose a step near the usual length of a range.
    """
    wide = ranges.where(F.col(first) <= F.col(last)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(first) / step), F.floor(F.col(last) / step))))
    cells = points.withColumn("_cell", F.floor(F.col(point) / step))
    return cells.join(wide, [*on, "_cell"]).where(F.col(point).between(F.col(first), F.col(last))).drop("_cell")


def outside_ranges(points: DataFrame, point: str, ranges: DataFrame, first: str, last: str, on: list[str], step: int) -> DataFrame:
    """Points that no range of their group holds."""
    held = in_ranges(points.select(*on, point), point, ranges.select(*on, first, last), first, last, on, step).select(*on, point).distinct()
    return points.join(held, [*on, point], "left_anti")


def best_overlap(rows: DataFrame, key: str, first: str, last: str, blocks: DataFrame, block_first: str, block_last: str, block: str, on: list[str], step: int) -> DataFrame:
    """key, block, overlap: the block of the group that shares most numbers with the row's range; the first block on ties."""
    wide = rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(first) / step), F.floor(F.col(last) / step))))
    tiles = blocks.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(block_first) / step), F.floor(F.col(block_last) / step))))
    shared = F.least(last, block_last) - F.greatest(first, block_first) + 1
    met = wide.join(tiles, [*on, "_cell"]).withColumn("_shared", shared).where("_shared > 0").select(*on, key, block, "_shared").distinct()
    return met.groupBy(*on, key).agg(F.min(F.struct((-F.col("_shared")).alias("s"), F.col(block).alias("b"))).alias("m")).select(*on, key, F.col("m.b").alias(block), (-F.col("m.s")).alias("overlap"))


def mutual_best(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are each other's best: highest score, then least id."""
    by_left = W.partitionBy(left).orderBy(F.desc(score), right)
    by_right = W.partitionBy(right).orderBy(F.desc(score), left)
    ranked = pairs.withColumn("_l", F.row_number().over(by_left)).withColumn("_r", F.row_number().over(by_right))
    return ranked.where("_l = 1 and _r = 1").drop("_l", "_r")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """All rows by key; the latest by ``order`` wins, and of equals the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = both.groupBy(*key).agg(F.max_by(F.struct(*both.columns), F.struct(order, "_new")).alias("r"))
    return latest.select("r.*").drop("_new")


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there."""
    return old.unionByName(new.join(old, key, "left_anti"))


def changed_fields(before: DataFrame, after: DataFrame, key: list[str], field: str, value: str) -> DataFrame:
    """Fields whose value differs: key, field, change (added, removed, changed), old, new."""
    a = before.select(*key, field, F.col(value).alias("old"), F.lit(True).alias("_a"))
    b = after.select(*key, field, F.col(value).alias("new"), F.lit(True).alias("_b"))
    both = a.join(b, [*key, field], "full").where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    return both.withColumn("change", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")).drop("_a", "_b")


def positional_compare(lines: DataFrame, group: str, position: str, text: str, members: str) -> DataFrame:
    """group, position, kind: fixed where all members of the group have the same text there, else variable."""
    sizes = lines.groupBy(group).agg(F.count_distinct(members).alias("_all"))
    at = lines.groupBy(group, position).agg(F.min(text).alias("_low"), F.max(text).alias("_high"), F.count_distinct(members).alias("_n"))
    same = (F.col("_low") == F.col("_high")) & (F.col("_n") == F.col("_all"))
    return at.join(sizes, group).select(group, position, F.when(same, "fixed").otherwise("variable").alias("kind"))
