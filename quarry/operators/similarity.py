"""Similarity of texts: edit distance, TF-IDF cosine, token SimHash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer; 1 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(F.least(F.length(a), F.length(b)) / longer)


def edit_similarity(a: Column, b: Column) -> Column:
    """0.7 for few edits and 0.3 for like lengths."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(0.7 * (1 - F.levenshtein(a, b) / longer) + 0.3 * (1 - F.abs(F.length(a) - F.length(b)) / longer))


def term_weights(docs: DataFrame, doc: str, terms: Column) -> DataFrame:
    """(doc, term, weight): tf over the document's greatest tf, times ln((N + 1) / (df + 1)) + 1; weights have length 1."""
    counted = docs.select(doc, F.explode(terms).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))
    most = counted.groupBy(doc).agg(F.max("tf").alias("most"))
    rarity = counted.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    raw = counted.join(most, doc).join(rarity, "term").withColumn("w", F.col("tf") / F.col("most") * (F.ln((n.scalar() + 1) / (F.col("df") + 1)) + 1))
    norms = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, doc).select(doc, "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosine_pairs(a: DataFrame, a_id: str, b: DataFrame, b_id: str) -> DataFrame:
    """(a_id, b_id, cosine) of all pairs that share a term, from term weights of both sides."""
    met = a.select(a_id, "term", F.col("weight").alias("_x")).join(b.select(b_id, "term", F.col("weight").alias("_y")), "term")
    return met.groupBy(a_id, b_id).agg(F.sum(F.col("_x") * F.col("_y")).alias("cosine"))


def token_simhash(docs: DataFrame, doc: str, terms: Column) -> DataFrame:
    """(doc, simhash): each token votes with the first eight bytes of its MD5, little-endian; a bit is 1 at no less than half.

    Votes are summed per document before the shuffle, so a document's tokens never meet in one place.
    """
    head = F.reverse(F.regexp_extract_all(F.substring(F.md5("term"), 1, 16), F.lit(".."), F.lit(0)))
    number = F.conv(F.array_join(head, ""), 16, -10).cast("long")
    votes = [F.sum(F.when(F.call_function("shiftrightunsigned", F.col("h"), F.lit(i)).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)).alias(f"b{i}") for i in range(64)]
    summed = docs.select(doc, F.explode(terms).alias("term")).select(doc, number.alias("h")).groupBy(doc).agg(*votes)
    bits = [F.when(F.col(f"b{i}") >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(i))).otherwise(F.lit(0).cast("long")) for i in range(64)]
    whole = bits[0]
    for b in bits[1:]:
        whole = whole.bitwiseOR(b)
    return summed.select(doc, whole.alias("simhash"))
