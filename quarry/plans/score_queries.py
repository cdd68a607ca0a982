"""Queries over aggregates, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import extract, scores
from quarry.plans.registry import query
from quarry.storage import table


@query("""
    SELECT l_orderkey, count(*) AS pages, sum(words)::BIGINT AS words, count(*) FILTER (scanned) AS scanned, round_even(100.0 * count(*) FILTER (scanned) / count(*), 2)::DOUBLE AS scan_ratio,
        round_even(100.0 * count(*) FILTER (scanned) / count(*), 2) >= 90 AS is_scanned
    FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity END AS words, l_returnflag = 'A' AND l_linenumber > 1 AS scanned FROM lineitem) GROUP BY 1""")
def scan_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", 0).otherwise(F.col("l_quantity")).alias("words"), (F.col("l_linenumber") - 1).alias("images"))
    out = scores.scan_summary(pages, "l_orderkey", "words", "images")
    return out.withColumns({"scan_ratio": F.col("scan_ratio").cast("double"), "words": F.col("words").cast("long")})


@query("""
    SELECT l_suppkey, n, list_extract(q, (n // 2 + 1)::INTEGER) AS median, list_extract(q, (floor(0.9 * (n - 1)) + 1)::INTEGER) AS p90
    FROM (SELECT l_suppkey, count(*) AS n, list_sort(list(l_extendedprice)) AS q FROM lineitem GROUP BY 1)""")
def upper_median_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.upper_quantiles(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", {"median": None, "p90": 0.9})


@query("""
    WITH RECURSIVE s(i, low, high, below, above, moved) AS (
        SELECT 0, min(value), max(value), 0::BIGINT, 0::BIGINT, 1e9::DOUBLE FROM events
        UNION ALL SELECT i + 1, coalesce(a.lo, low), coalesce(a.hi, high), a.b, a.c, greatest(abs(coalesce(a.lo, low) - low), abs(coalesce(a.hi, high) - high)) FROM s, LATERAL (
            SELECT avg(value) FILTER (abs(value - s.low) <= abs(value - s.high)) AS lo, avg(value) FILTER (abs(value - s.low) > abs(value - s.high)) AS hi,
                count(*) FILTER (abs(value - s.low) <= abs(value - s.high)) AS b, count(*) FILTER (abs(value - s.low) > abs(value - s.high)) AS c FROM events) a WHERE moved >= 1e-6 AND i < 50)
    SELECT round(low, 4) AS low, round(high, 4) AS high, round((low + high) / 2, 4) AS cut, below, above, moved < 1e-6 AS resting FROM s ORDER BY i DESC LIMIT 1""")
def two_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores.two_means(table(spark, sf_dir, "events").select("value"), "value")
    out = spark.createDataFrame([found], "low double, high double, cut double, below long, above long, resting boolean")
    return out.withColumns({c: F.round(c, 4) for c in ("low", "high", "cut")})


_KINDS = {"licence": (["under the"], ["licen", "released"]), "secret": ([], ["token =", "password"]), "marked": (["###"], ["***", "%%%"])}


@query(
    "SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'UNKNOWN' WHEN a >= b AND a >= c THEN 'licence' WHEN b >= c THEN 'secret' ELSE 'marked' END AS kind, greatest(a, b, c) AS score FROM (SELECT doc_id, "
    + ", ".join(
        "CASE WHEN " + " AND ".join([f"contains(t, '{k}')" for k in every] + ["(" + " OR ".join(f"contains(t, '{k}')" for k in some) + ")"]) + " THEN " + " + ".join(f"contains(t, '{k}')::INTEGER" for k in [*every, *some]) + f" ELSE 0 END AS {name}"
        for name, (every, some) in zip("abc", _KINDS.values())
    )
    + " FROM (SELECT doc_id, lower(text) AS t FROM documents))"
)
def keyword_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower("text")
    found = F.array(*(F.struct(scores.keyword_score(text, every, some).alias("score"), F.lit(-i).alias("o"), F.lit(kind).alias("kind")) for i, (kind, (every, some)) in enumerate(_KINDS.items())))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_max(found).alias("b"))
    return rows.select("doc_id", F.when(F.col("b.score") == 0, "UNKNOWN").otherwise(F.col("b.kind")).alias("kind"), F.col("b.score").alias("score"))


_WEIGHTS = {"licence": 5.0, "mail": 4.0, "number": 2.5, "long": 1.0}


@query(r"""
    SELECT source, round(sum(5.0 * regexp_matches(text, '(?i)licensed under')::INTEGER + 4.0 * regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')::INTEGER
        + 2.5 * regexp_matches(text, '\d{10,}')::INTEGER + 1.0 * (n_chars > 5000)::INTEGER), 2)::DOUBLE AS score FROM documents GROUP BY 1""")
def weighted_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"licence": F.col("text").rlike("(?i)licensed under"), "mail": F.contains(F.col("text"), F.lit("@")) & F.col("text").rlike(extract.MAIL), "number": F.col("text").rlike(r"\d{10,}"), "long": F.col("n_chars") > 5000}
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.sum(scores.weighted_score(_WEIGHTS, flags)), 2).alias("score"))


@query("""
    WITH k AS (SELECT user_id, event_type AS t, max(floor(value)) AS s FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
    m AS (SELECT user_id, max(s) AS top, count(*) AS kinds FROM k GROUP BY 1),
    r AS (SELECT k.user_id, count(*) AS ties, max(t) AS t FROM k JOIN m ON k.user_id = m.user_id AND s = top GROUP BY 1)
    SELECT u.user_id, CASE WHEN r.user_id IS NULL THEN 'UNKNOWN' WHEN ties > 1 THEN 'CONFLICT' ELSE t END AS resolved, coalesce(kinds, 0) AS kinds
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) LEFT JOIN m USING (user_id)""")
def doc_type_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", "UNKNOWN").otherwise(F.col("event_type")).alias("kind"), F.floor("value").alias("s"))
    return scores.resolve_type(events, "user_id", "kind", "s")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = extract.GENERAL
    docs = table(spark, sf_dir, "documents")
    found = F.array(*(F.struct(F.lit(k).alias("field"), F.when(F.contains(F.col("text"), F.lit(extract.NEEDS.get(k, ""))), F.regexp_extract("text", p, 0)).otherwise(F.substring("text", 1, 0)).alias("value")) for k, p in kinds.items()))
    return docs.select("doc_id", "lang", (F.col("doc_id") % 10 / 10).alias("confidence"), F.explode(found).alias("f")).select("doc_id", "lang", "confidence", "f.*")


@query(
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT doc_id, lang, doc_id % 10 / 10 AS c, '{k}' AS field, regexp_extract(text, '{p}') AS value FROM documents" for k, p in extract.GENERAL.items())
    + """), m AS (SELECT field, lang, count(*) FILTER (value <> '') AS k FROM f GROUP BY 1, 2)
    SELECT field, count(*) FILTER (value <> '') AS filled, count(*) FILTER (value = '') AS missing, count(*) FILTER (value <> '' AND c < 0.6) AS low_confidence,
        (SELECT lang FROM m WHERE m.field = f.field ORDER BY k DESC, lang LIMIT 1) AS top_method FROM f GROUP BY field"""
)
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.coverage(_fields(spark, sf_dir), "field", "value", "lang", "confidence")


@query("""
    WITH c AS (SELECT l_orderkey, l_returnflag AS value, CASE l_linestatus WHEN 'F' THEN 3 ELSE 1 END AS p, floor(l_discount * 100) AS c, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS o FROM lineitem)
    SELECT l_orderkey, CASE WHEN count(DISTINCT value) > 1 THEN 'AMBIGUOUS' ELSE min(value) END AS strict_value, arg_max(value, p * 1e15 + c * 1e12 - o) AS value, count(DISTINCT value) AS "values"
    FROM c GROUP BY 1""")
def resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("value"), "l_linestatus", F.floor(F.col("l_discount") * 100).alias("c"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("o"))
    priority = F.when(F.col("l_linestatus") == "F", 3).otherwise(1)
    return scores.resolve_fields(lines, ["l_orderkey"], "value", priority, "c", "o").select("l_orderkey", "strict_value", F.col("resolved").alias("value"), "values")


@query("""
    SELECT CASE c_custkey % 4 WHEN 0 THEN 'normalized' WHEN 1 THEN 'digits' WHEN 2 THEN 'compact' ELSE 'none' END AS method, count(*) AS checked,
        count(*) FILTER (c_custkey % 4 < 3) AS found, count(*) FILTER (c_custkey % 4 = 3) AS missing FROM customer GROUP BY 1""")
def probe_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, number = F.col("c_custkey") % 4, F.lpad(F.col("c_custkey").cast("string"), 9, "7")
    value = F.when(key == 0, F.concat(F.lit("Fee  ÓRDER "), number)).when(key == 1, number).when(key == 2, F.lit("alpha-beta gamma")).otherwise(F.lit("not on any page"))
    dotted = F.concat_ws(".", F.substring(number, 1, 3), F.substring(number, 4, 3), F.substring(number, 7, 3))
    page = F.concat(F.lit("paid: fee order "), F.when(key == 0, number).otherwise(dotted), F.lit(" to ALPHA BETAGAMMA"))
    probes = table(spark, sf_dir, "customer").select(F.coalesce(scores.probe(value, page), F.lit("none")).alias("shown"), scores.probe(value, page).alias("method"))
    return scores.probe_summary(probes, "shown", "method").withColumnRenamed("shown", "method")


@query("""
    SELECT round(sum(found) / sum(checked), 6) AS weighted, round(avg(found / checked), 6) AS mean, count(*) FILTER (found / checked >= 0.95) AS passed, count(*) AS files
    FROM (SELECT l_orderkey, count(*) AS checked, count(*) FILTER (l_returnflag <> 'R') AS found FROM lineitem GROUP BY 1)""")
def accuracy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("checked"), F.count_if(F.col("l_returnflag") != "R").alias("found"))
    return scores.accuracy(files, "checked", "found").withColumns({c: F.round(c, 6) for c in ("weighted", "mean")})


@query("SELECT user_id, min(value) AS x0, max(value) AS x1, min(event_id) AS y0, max(event_id) AS y1, round(sum(value * 2) / greatest(1, max(value) * 10), 6) AS density FROM events GROUP BY 1")
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    boxes = scores.union_box(events, ["user_id"], "value", "event_id", "value", "event_id")
    dense = scores.page_density(events, ["user_id"], F.col("value") * 2, F.col("value") * 10)
    return boxes.join(dense, "user_id").withColumn("density", F.round("density", 6))
