"""Queries over windows, runs, sorts and streams' batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import ordered
from quarry.plans.registry import query
from quarry.sources.files import pick_inputs
from quarry.storage import table
from quarry.streaming.incremental import sessions as user_sessions


@query("""
    SELECT conv_id, turn, turn * 3 + 1 AS start, CASE WHEN lead(turn) OVER w IS NULL THEN turn * 3 + 1 ELSE greatest(turn * 3 + 1, lead(turn * 3 + 1) OVER w - 1) END AS own_end,
           CASE WHEN lead(turn) OVER w IS NULL THEN max(turn * 3 + 3) OVER (PARTITION BY conv_id) ELSE greatest(turn * 3 + 1, lead(turn * 3 + 1) OVER w - 1) END AS page_end
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def bookmark_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 3 + 1).alias("start")).withColumn("last_page", F.max(F.col("turn") * 3 + 3).over(W.partitionBy("conv_id")))
    own = ordered.ranges_from_starts(rows, "conv_id", "start", ["turn"], F.col("start")).withColumnRenamed("range_end", "own_end")
    page = ordered.ranges_from_starts(own, "conv_id", "start", ["turn"], F.col("last_page")).withColumnRenamed("range_end", "page_end")
    return page.drop("last_page")


@query("""
    SELECT l_orderkey, min(l_linenumber) AS run_start, max(l_linenumber) AS run_end, count(*) AS run_size FROM (
        SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
    GROUP BY l_orderkey, run""")
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.islands(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("SELECT conv_id, turn, role || '_' || lpad(row_number() OVER (PARTITION BY conv_id ORDER BY turn)::VARCHAR, 3, '0') || '_' || lpad(turn::VARCHAR, 4, '0') AS doc_key FROM conversations")
def sequence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.sequence_key(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("role"), F.col("turn")).select("conv_id", "turn", "doc_key")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "UNKNOWN").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"), kind.alias("kind"))


@query("""
    WITH RECURSIVE t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_type = 'error' THEN 'UNKNOWN' ELSE event_type END AS kind FROM events),
    s AS (SELECT user_id, n, kind AS k, n AS first, 1 AS size, 0 AS seg FROM t WHERE n = 1
        UNION ALL SELECT t.user_id, t.n, CASE WHEN j THEN s.k ELSE t.kind END, CASE WHEN j THEN s.first ELSE t.n END, CASE WHEN j THEN s.size + 1 ELSE 1 END, CASE WHEN j THEN s.seg ELSE s.seg + 1 END
        FROM s JOIN t ON t.user_id = s.user_id AND t.n = s.n + 1, LATERAL (
            SELECT (t.kind = s.k OR (t.kind = 'UNKNOWN' AND s.k <> 'UNKNOWN')) AND s.size < CASE s.k WHEN 'click' THEN 3 WHEN 'view' THEN 3 WHEN 'purchase' THEN 2 ELSE 2147483647 END AS j) l)
    SELECT user_id, seg AS segment, k AS kind, first, max(n) AS last, max(size)::BIGINT AS rows FROM s GROUP BY user_id, seg, k, first""")
def type_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.type_runs(_typed(spark, sf_dir), "user_id", "n", "kind", {"click": 3, "view": 3, "purchase": 2})


@query("""
    WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_type = 'error' THEN 'UNKNOWN' ELSE event_type END AS kind FROM events),
    k AS (SELECT *, last_value(CASE WHEN kind <> 'UNKNOWN' THEN kind END IGNORE NULLS) OVER b AS pk, last_value(CASE WHEN kind <> 'UNKNOWN' THEN n END IGNORE NULLS) OVER b AS pn,
        first_value(CASE WHEN kind <> 'UNKNOWN' THEN kind END IGNORE NULLS) OVER a AS ak, first_value(CASE WHEN kind <> 'UNKNOWN' THEN n END IGNORE NULLS) OVER a AS an FROM t
        WINDOW b AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, n, CASE WHEN kind = 'UNKNOWN' AND pk = ak AND an - pn + 1 <= 3 THEN pk ELSE kind END AS filled FROM k""")
def gap_fill_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.fill_gaps(_typed(spark, sf_dir), "user_id", "n", "kind", 3).select("user_id", F.col("n").cast("long").alias("n"), "filled")


@query("SELECT source, doc_id, quality, n_chars FROM (SELECT source, doc_id, quality, n_chars, row_number() OVER (PARTITION BY source ORDER BY quality DESC, n_chars DESC, doc_id) AS r FROM documents JOIN labels USING (doc_id)) WHERE r <= 3")
def candidate_best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return ordered.best_per_group(rows, ["source"], [F.desc("quality"), F.desc("n_chars"), F.asc("doc_id")], 3)


@query("""
    SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER w, 0)::BIGINT AS begin, (coalesce(sum(length(text) + 1) OVER w, 0) + length(text))::BIGINT AS "end"
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.running_offsets(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text").select("conv_id", "turn", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


@query("""
    SELECT conv_id, turn, coalesce(previous, -1) AS previous, coalesce(next, -1) AS next FROM (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
        first_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next
    FROM conversations)""")
def fixed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.neighbours(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("role") == "user", "turn").select("conv_id", "turn", F.coalesce("previous", F.lit(-1)).alias("previous"), F.coalesce("next", F.lit(-1)).alias("next"))


@query("""
    WITH f AS (SELECT l_orderkey, l_partkey AS x, l_quantity AS y, 'w' || l_linenumber || '_' || l_suppkey AS t, CASE WHEN abs(lag(l_quantity) OVER w - l_quantity) <= 5 THEN 0 ELSE 1 END AS new
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, 'w' || l_linenumber || '_' || l_suppkey)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY y DESC, x, t ROWS UNBOUNDED PRECEDING) AS line FROM f)
    SELECT l_orderkey, line::BIGINT AS line, string_agg(t, ' ' ORDER BY x, t) AS text FROM n GROUP BY 1, 2""")
def lines_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("x"), F.col("l_quantity").alias("y"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")).alias("t"))
    return ordered.lines_from_words(words, ["l_orderkey"], "x", "y", "t", 5)


@query("""
    WITH s AS (SELECT l_orderkey, l_partkey AS x0, l_partkey + l_quantity AS x1, chr(65 + l_linenumber::INTEGER) AS t, lag(l_partkey + l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS before FROM lineitem
        QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey) = 1)
    SELECT l_orderkey, string_agg(CASE WHEN x0 - before > 300 THEN ' ' ELSE '' END || t, '' ORDER BY x0) AS text FROM (
        SELECT l_orderkey, x0, t, lag(x1) OVER (PARTITION BY l_orderkey ORDER BY x0) AS before FROM s) GROUP BY 1""")
def spaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "lineitem").withColumn("k", F.count("*").over(W.partitionBy("l_orderkey", "l_partkey"))).where("k = 1")
    pieces = pieces.select("l_orderkey", F.col("l_partkey").alias("x0"), (F.col("l_partkey") + F.col("l_quantity")).alias("x1"), F.char(65 + F.col("l_linenumber")).alias("t"))
    return ordered.spaced_text(pieces, ["l_orderkey"], "x0", "x1", "t", 300)


@query("SELECT DISTINCT conv_id, turn AS first, least(turn + k, last) AS last FROM conversations JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1) USING (conv_id), (VALUES (1), (2), (3)) v(k) WHERE role = 'user'")
def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    hits = turns.where("role = 'user'").join(turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn")), "conv_id")
    return ordered.page_windows(hits, "conv_id", "turn", "last_turn")


@query("SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_name LIMIT 41 OFFSET 19")
def picked_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit and offset are the feature here: the 20th to 60th input by name."""
    return pick_inputs(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", 20, 60)


@query("""
    WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM s GROUP BY user_id, s""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = user_sessions(table(spark, sf_dir, "events"), "user_id", "ts")
    return found.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total")
