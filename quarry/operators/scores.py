"""Aggregates and scores: ratios, medians, weights, coverage, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import compact, digits, normalize_for_match


def scan_summary(pages: DataFrame, group: str, words: str, images: str) -> DataFrame:
    """Pages, words and scanned share in percent (half to even); a page without words but with images is scanned."""
    scanned = F.count_if((F.col(words) == 0) & (F.col(images) > 0))
    ratio = F.bround((scanned * 100).cast("decimal(20,4)") / F.count("*"), 2).cast("decimal(5,2)")
    return pages.groupBy(group).agg(F.count("*").alias("pages"), F.sum(words).alias("words"), scanned.alias("scanned"), ratio.alias("scan_ratio"), (ratio >= 90).alias("is_scanned"))


def upper_quantiles(values: DataFrame, group: str, value: str, shares: dict[str, float | None]) -> DataFrame:
    """group, n and a column for each share: the value at place floor(share * (n - 1)), or n div 2 for None (upper median), from 0.

    Ranked by one window, so a group is sorted once, and on disk if it must be, not gathered in a row.
    """
    w = W.partitionBy(group)
    ranked = values.select(group, value).withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1)
    place = {name: F.floor(F.col("_n") / 2) if share is None else F.floor(F.lit(share) * (F.col("_n") - 1)) for name, share in shares.items()}
    return ranked.groupBy(group, F.col("_n").alias("n")).agg(*(F.max(F.when(F.col("_i") == at, F.col(value))).alias(name) for name, at in place.items()))


def upper_quantile(values: DataFrame, group: str, value: str, share: float | None = None) -> DataFrame:
    """group, n, quantile: one of ``upper_quantiles``."""
    return upper_quantiles(values, group, value, {"quantile": share})


def two_means(values: DataFrame, value: str, rounds: int = 50, epsilon: float = 1e-6) -> tuple[float, float, float, int, int, bool]:
    """Two clusters on a line, begun at least and greatest value: low, high, cut, counts, and whether the centres had come to rest.

    Values are counted once; each of at most ``rounds`` rounds is one aggregate over the distinct ones.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("k")).cache()
    low, high = (x if x is not None else 0.0 for x in counted.agg(F.min("x"), F.max("x")).first())
    below = above = 0
    resting = False
    for _ in range(rounds):
        near = F.abs(F.col("x") - low) <= F.abs(F.col("x") - high)
        mean = lambda c: F.sum(F.when(c, F.col("x") * F.col("k"))) / F.sum(F.when(c, F.col("k")))
        a, b, below, above = counted.agg(mean(near), mean(~near), F.coalesce(F.sum(F.when(near, F.col("k"))), F.lit(0)), F.coalesce(F.sum(F.when(~near, F.col("k"))), F.lit(0))).first()
        new = (low if a is None else a, high if b is None else b)
        moved = max(abs(new[0] - low), abs(new[1] - high))
        low, high = new
        if resting := moved < epsilon:
            break
    counted.unpersist()
    return low, high, (low + high) / 2, below, above, resting


def keyword_score(text: Column, every: list[str], some: list[str]) -> Column:
    """0 unless all of ``every`` and one of ``some`` (if given) occur; else how many occur."""
    found_every = [F.contains(text, F.lit(k)).cast("int") for k in every]
    found_some = [F.contains(text, F.lit(k)).cast("int") for k in some]
    n_every = sum(found_every, F.lit(0))
    n_some = sum(found_some, F.lit(0))
    passes = (n_every == len(every)) & ((n_some > 0) if some else F.lit(True))
    return F.when(passes, n_every + n_some).otherwise(0)


def weighted_score(weights: dict[str, float], flags: dict[str, Column]) -> Column:
    """The weights of the detectors that fired."""
    return sum((F.when(flags[name], F.lit(float(w))).otherwise(0.0) for name, w in weights.items() if name in flags), F.lit(0.0))


def resolve_type(evidence: DataFrame, group: str, kind: str, strength: str, unknown: str = "UNKNOWN") -> DataFrame:
    """One type per group: the only known one, the strongest of several, CONFLICT if they tie, else unknown."""
    known = evidence.where((F.col(kind) != unknown) & F.col(kind).isNotNull())
    per = known.groupBy(group, kind).agg(F.max(strength).alias("_s"))
    top = per.groupBy(group).agg(F.max("_s").alias("_top"), F.max(F.struct("_s", kind)).alias("_m"), F.count("*").alias("kinds"), F.collect_list("_s").alias("_all"))
    ties = F.size(F.filter("_all", lambda s: s == F.col("_top")))
    resolved = top.select(group, F.when(ties > 1, "CONFLICT").otherwise(F.col(f"_m.{kind}")).alias("resolved"), F.col("kinds"))
    return evidence.select(group).distinct().join(resolved, group, "left").select(group, F.coalesce("resolved", F.lit(unknown)).alias("resolved"), F.coalesce("kinds", F.lit(0)).cast("long").alias("kinds"))


def coverage(fields: DataFrame, field: str, value: str, method: str, confidence: str, least: float = 0.6) -> DataFrame:
    """Per field: filled, missing, low_confidence, top_method (most often, then by name)."""
    filled = F.col(value).isNotNull() & (F.trim(value) != "")
    per = fields.groupBy(field, method).agg(F.count_if(filled).alias("f"), F.count_if(~filled).alias("m"), F.count_if(filled & (F.col(confidence) < least)).alias("l"))
    return per.groupBy(field).agg(F.sum("f").alias("filled"), F.sum("m").alias("missing"), F.sum("l").alias("low_confidence"), F.min(F.struct((-F.col("f")).alias("k"), F.col(method).alias("name")))["name"].alias("top_method"))


def resolve_fields(candidates: DataFrame, key: list[str], value: str, priority: Column, confidence: str, order: str, strict: bool = False) -> DataFrame:
    """One candidate per key: by priority, confidence, then order; resolved, confidence, values, strict_value.

    ``strict_value`` is AMBIGUOUS where a key has several values; with ``strict``, so is ``resolved``.
    """
    same = F.lower(F.trim(value))
    best = candidates.withColumn("_p", priority).groupBy(*key).agg(F.max_by(F.struct(value, confidence), F.struct("_p", confidence, -F.col(order))).alias("m"), F.count_distinct(same).alias("values"))
    sure = F.when(F.col("values") > 1, "AMBIGUOUS").otherwise(F.col(f"m.{value}"))
    return best.select(*key, (sure if strict else F.col(f"m.{value}")).alias("resolved"), F.col(f"m.{confidence}").alias("confidence"), "values", sure.alias("strict_value"))


def probe(value: Column, page: Column) -> Column:
    """How a value shows on a page: normalized, digits (six or more), compact (six or more); null if it doesn't."""
    plain, number, dense = normalize_for_match(value), digits(value), compact(value)
    return (
        F.when((plain != "") & F.contains(normalize_for_match(page), plain), "normalized")
        .when((F.length(number) >= 6) & F.contains(digits(page), number), "digits")
        .when((F.length(dense) >= 6) & F.contains(compact(page), dense), "compact")
    )


def probe_summary(probes: DataFrame, group: str, method: str) -> DataFrame:
    found = F.count_if(F.col(method).isNotNull())
    return probes.groupBy(group).agg(F.count("*").alias("checked"), found.alias("found"), F.count_if(F.col(method).isNull()).alias("missing"))


def page_averages(pages: DataFrame, keys: list[str], averages: dict[str, Column], sums: dict[str, Column], digits: int = 4) -> DataFrame:
    """Per key: pages, averages of the page values (rounded), and sums."""
    return pages.groupBy(*keys).agg(F.count("*").alias("pages"), *(F.round(F.avg(c), digits).alias(n) for n, c in averages.items()), *(F.sum(c).alias(n) for n, c in sums.items()))


def union_box(words: DataFrame, keys: list[str], x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Per key the box around all boxes."""
    return words.groupBy(*keys).agg(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"))


def page_density(words: DataFrame, keys: list[str], area: Column, page_area: Column) -> DataFrame:
    """Per key the share of the page that words cover; a page has an area of 1 at least."""
    return words.groupBy(*keys).agg((F.sum(area) / F.greatest(F.lit(1.0), F.max(page_area))).alias("density"))


def accuracy(files: DataFrame, checked: str, found: str, least: float = 0.95) -> DataFrame:
    """One row: the share found over all and on average, how many files reach ``least``, and files."""
    share = F.col(found) / F.col(checked)
    return files.agg((F.sum(found) / F.sum(checked)).alias("weighted"), F.avg(share).alias("mean"), F.count_if(share >= least).alias("passed"), F.count("*").alias("files"))
