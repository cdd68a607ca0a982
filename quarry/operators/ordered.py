"""Operators over ordered rows: ranges, runs, neighbours, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranges_from_starts(df: DataFrame, group: str, start: str, order: list[str], last_end: Column) -> DataFrame:
    """Adds ``range_end``: one before the next start of the group, at least its own start; ``last_end`` for the last row.

    Callers choose how the last range ends: at its own start, at the group's last page, or open (null).
    """
    w = W.partitionBy(group).orderBy(start, *order)
    following = F.lead(start).over(w)
    return df.withColumn("range_end", F.when(following.isNotNull(), F.greatest(F.col(start), following - 1)).otherwise(last_end))


def islands(df: DataFrame, group: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: group, run_start, run_end, run_size. Repeats count once."""
    distinct = df.select(*group, number).distinct()
    w = W.partitionBy(*group).orderBy(number)
    runs = distinct.withColumn("_run", F.col(number) - F.row_number().over(w))
    return runs.groupBy(*group, "_run").agg(F.min(number).alias("run_start"), F.max(number).alias("run_end"), F.count("*").alias("run_size")).drop("_run")


def sequence_key(df: DataFrame, group: str, order: list[str], name: Column, page: Column) -> DataFrame:
    """Adds ``doc_key``: name, three-digit number within the group, four-digit page."""
    n = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("doc_key", F.concat_ws("_", name, F.lpad(n.cast("string"), 3, "0"), F.lpad(page.cast("string"), 4, "0")))


def type_runs(df: DataFrame, group: str, order: str, kind: str, most: dict[str, int], unknown: str = "UNKNOWN") -> DataFrame:
    """Segments of consecutive rows of one type: group, segment, kind, first, last, rows.

    An unknown row after a known type belongs to it; a segment ends at the type's ``most``
    rows, or where the order has a hole. A fold over the group's rows, in order.
    """
    limits = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("n"), F.coalesce(F.col(kind), F.lit(unknown)).alias("k"))))
    segment = "struct<k:string,first:long,last:long,size:int>"
    start = F.struct(F.lit(None).cast(segment).alias("open"), F.array().cast(f"array<{segment}>").alias("done"))

    def step(acc: Column, row: Column) -> Column:
        now = acc["open"]
        room = F.coalesce(F.get(F.array(F.element_at(limits, now["k"])), 0), F.lit(2**31 - 1))
        joins = now.isNotNull() & (row["n"] == now["last"] + 1) & ((row["k"] == now["k"]) | ((row["k"] == unknown) & (now["k"] != unknown))) & (now["size"] < room)
        longer = F.struct(now["k"].alias("k"), now["first"].alias("first"), row["n"].alias("last"), (now["size"] + 1).alias("size"))
        fresh = F.struct(row["k"].alias("k"), row["n"].alias("first"), row["n"].alias("last"), F.lit(1).alias("size"))
        done = F.when(F.coalesce(joins, F.lit(False)) | now.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(now)))
        return F.struct(F.when(F.coalesce(joins, F.lit(False)), longer).otherwise(fresh).alias("open"), done.alias("done"))

    folded = F.aggregate(rows, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    out = df.groupBy(group).agg(folded.alias("segments")).select(group, F.posexplode("segments").alias("segment", "s"))
    return out.select(group, "segment", F.col("s.k").alias("kind"), F.col("s.first").alias("first"), F.col("s.last").alias("last"), F.col("s.size").cast("long").alias("rows"))


def fill_gaps(df: DataFrame, group: str, order: str, kind: str, most: int, unknown: str = "UNKNOWN") -> DataFrame:
    """Adds ``filled``: an unknown run between two rows of one type takes it, if run and both rows are at most ``most``."""
    known = F.when(F.col(kind) != unknown, F.struct(F.col(kind).alias("k"), F.col(order).alias("n")))
    w = W.partitionBy(group).orderBy(order)
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    fits = (F.col(kind) == unknown) & (before["k"] == after["k"]) & (after["n"] - before["n"] + 1 <= most)
    return df.withColumn("filled", F.when(F.coalesce(fits, F.lit(False)), before["k"]).otherwise(F.col(kind)))


def best_per_group(df: DataFrame, group: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group. Give an order without ties, ordinals included."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def running_offsets(df: DataFrame, group: str, order: list[str], text: str, gap: int = 1) -> DataFrame:
    """Adds ``begin`` and ``end``: where each text lies in the group's texts joined by ``gap`` characters."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0))
    return df.withColumn("begin", begin).withColumn("end", F.col("begin") + F.length(text))


def neighbours(df: DataFrame, group: str, order: list[str], fixed: Column, value: str) -> DataFrame:
    """Adds ``previous`` and ``next``: the nearest fixed value before and after each row."""
    w = W.partitionBy(group).orderBy(*order)
    held = F.when(fixed, F.col(value))
    return df.withColumn("previous", F.last(held, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("next", F.first(held, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))


def lines_from_words(words: DataFrame, page: list[str], x: str, y: str, text: str, tolerance: float) -> DataFrame:
    """Words to lines: page, line, text. From the top down; a new line where y falls by more than ``tolerance``."""
    w = W.partitionBy(*page).orderBy(F.desc(y), F.asc(x), F.asc(text))
    drop = F.coalesce(F.abs(F.lag(y).over(w) - F.col(y)) > tolerance, F.lit(True))
    numbered = words.withColumn("line", F.sum(drop.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text).alias("t"))))
    return numbered.groupBy(*page, "line").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"))


def spaced_text(words: DataFrame, line: list[str], x0: str, x1: str, text: str, gap: float) -> DataFrame:
    """Pieces of a line joined, with a blank where the gap to the piece before is over ``gap``."""
    w = W.partitionBy(*line).orderBy(x0)
    blank = F.when(F.col(x0) - F.lag(x1).over(w) > gap, " ").otherwise("")
    made = words.withColumn("_piece", F.struct(F.col(x0).alias("x"), F.concat(blank, F.col(text)).alias("t")))
    return made.groupBy(*line).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda s: s["t"]), "").alias("text"))


def without_overlaps(spans: Column) -> Column:
    """Of array<struct<start, end, ...>>: by start, longest first, those that begin at or after the last kept end."""
    by_start = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    kept = F.slice(by_start, F.lit(1), F.lit(0))

    def step(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["end"]
        return F.struct(F.when(fits, s["end"]).otherwise(acc["end"]).alias("end"), F.when(fits, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(by_start, F.struct(F.lit(-1).alias("end"), kept.alias("kept")), step)["kept"]


def page_windows(hits: DataFrame, group: str, page: str, last_page: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Candidate windows from each hit: group, first, last; clipped at the last page, each once."""
    wide = hits.select(group, F.col(page).alias("first"), F.explode(F.array(*(F.least(F.col(page) + n, F.col(last_page)) for n in sizes))).alias("last"))
    return wide.distinct()


def spaced_by_quantile(words: DataFrame, line: list[str], x0: str, x1: str, text: str, share: float = 0.9, least: float = 0.0) -> DataFrame:
    """Pieces of a line joined, with a blank where the gap to the piece before is over the line's own quantile of gaps, and over ``least``."""
    w = W.partitionBy(*line).orderBy(x0)
    gapped = words.withColumn("_gap", F.col(x0) - F.lag(x1).over(w))
    ranked = gapped.where("_gap is not null").withColumn("_n", F.count("*").over(W.partitionBy(*line))).withColumn("_i", F.row_number().over(W.partitionBy(*line).orderBy("_gap")) - 1)
    cut = ranked.where(F.col("_i") == F.floor(F.lit(share) * (F.col("_n") - 1))).select(*line, F.greatest(F.col("_gap"), F.lit(least)).alias("_cut"))
    made = gapped.join(cut, line, "left").withColumn("_piece", F.struct(F.col(x0).alias("x"), F.concat(F.when(F.col("_gap") > F.col("_cut"), " ").otherwise(""), F.col(text)).alias("t")))
    return made.groupBy(*line).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda s: s["t"]), "").alias("text"))


def blocks_by_position(ops: DataFrame, group: str, order: str, op: str, value: str, tolerance: float) -> DataFrame:
    """Adds ``block``: operators counted into blocks, a new one at BT, ET and T*, and where Tm or Td moves the line by over ``tolerance``.

    Tm sets the height, Td and TD add to it, BT and T* forget it: heights are running sums
    behind the last operator that set or forgot one.
    """
    w = W.partitionBy(group).orderBy(order)
    name, y = F.col(op), F.col(value).cast("double")
    fresh = name.isin("BT", "T*") | ((name == "Tm") & y.isNotNull())
    moved = F.when((name == "Tm") | name.isin("Td", "TD"), y)
    spans = ops.withColumn("_span", F.sum(fresh.cast("int")).over(w)).withColumn("_moved", moved)
    inside = W.partitionBy(group, "_span").orderBy(order)
    summed = spans.withColumn("_sum", F.sum("_moved").over(inside)).withColumn("_some", F.count("_moved").over(inside))
    height = F.when(F.col("_some") > 0, F.col("_sum"))
    before = F.lag(height).over(w)
    known = F.when(F.lag(F.col("_some")).over(w) > 0, before)
    jump = F.col("_moved").isNotNull() & known.isNotNull() & (F.abs(height - known) > tolerance)
    flush = name.isin("BT", "ET", "T*") | F.coalesce(jump, F.lit(False))
    return summed.withColumn("block", F.sum(flush.cast("int")).over(w)).drop("_span", "_moved", "_sum", "_some")


def operators_only(ops: DataFrame, op: str, allowed: list[str]) -> DataFrame:
    """Operators of a short list; an empty list keeps all."""
    return ops.where(F.col(op).isin(*allowed)) if allowed else ops
