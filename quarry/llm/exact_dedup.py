"""Exact dedup: equal texts share a 128-bit hash; bytes are compared inside groups.

Only DataFrame functions run here. The texts themselves are shuffled only where a
group has two members or more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.storage import Scratch, join_groups, key_filter, may_be_in

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() works on whole words of bytes, but it is right only where all is ASCII.
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] = ascii_lower, digest: Callable[[Column], Column] = lambda t: F.unhex(F.md5(t))) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Rows whose normalised texts are byte for byte equal form a group; the row with the
    smallest (``keep="min"``) or largest id stays. ``digest`` is the grouping hash of the
    normalised text; texts that collide under it are told apart by their bytes.

    Null text counts as empty, and all empty texts are one group. Rows with the same id
    count each on their own, and all of them have kept = true if their id is the group's.
    A null id loses to any other; a group of null ids alone keeps null with kept = true.
    An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    best = F.min if keep == "min" else F.max
    text = normalise(docs[text_col])
    signed = scratch.keep(docs.select(docs[id_col].alias("id"), digest(text.cast("binary")).alias("h"), F.sha2(text.cast("binary"), 256).alias("sha")), "signed")
    groups = signed.groupBy("h").agg(best("id").alias("keep_id"), F.count("*").alias("n"))
    several = scratch.keep(groups.where("n > 1"), "several")

    # Members of groups with their texts, beside the text of the row that would stay.
    # The filter keeps the texts of single rows out of the shuffle.
    member = docs.select(docs[id_col].alias("id"), digest(text.cast("binary")).alias("h"), text.alias("t"), F.sha2(text.cast("binary"), 256).alias("sha"))
    member = scratch.keep(join_groups(member.where(may_be_in(key_filter(several, "h"), F.col("h"))), several, "h"), "member")
    leaders = scratch.keep(member.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("h").agg(F.min("t").alias("leader")), "leaders")
    compared = join_groups(member, leaders, "h")
    differ = scratch.keep(compared.where("t != leader").select("h").distinct(), "differ")
    clashes = not differ.isEmpty()
    if clashes:
        signed = signed.join(differ, "h", "left_anti")
    # A row without a group of several is its own.
    result = join_groups(signed, several.withColumnRenamed("keep_id", "best"), "h", "left")
    result = result.select("id", "sha", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"))
    if clashes:  # different texts under one hash: group those by the texts themselves
        clash = member.drop("n", "keep_id").join(differ, "h", "left_semi")
        by_text = scratch.keep(clash.groupBy("t").agg(best("id").alias("keep_id"), F.count("*").alias("n")), "by_text")
        result = result.unionByName(join_groups(clash, by_text, "t").select(*result.columns))
    return result.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
