"""Queries over operators that make records: rule-driven fields, fees, experts, segments, final fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import align, assemble, documents, enrich, extract, ordered, rules
from quarry.plans.cases import case_rows, case_sql, quoted
from quarry.plans.registry import query
from quarry.sources import rules as rule_files
from quarry.storage import table


def expected(rows: list[tuple], names: str, n: int) -> str:
    """SQL for rows (i, ...) once for every customer whose key is i modulo ``n``, counted."""
    body = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) and not isinstance(x, bool) else quoted(x if x is None else str(x)) for x in r) + ")" for r in rows)
    columns = [c.strip() for c in names.split(",")]
    return f"SELECT {', '.join(f'v.{c}' for c in columns)}, count(*) AS n FROM customer c JOIN (VALUES {body}) v({names}) ON c.c_custkey % {n} = v.i GROUP BY ALL"


def counted(rows: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """How many customers of each case got each record."""
    return found.join(rows.select("c_custkey", "i"), "c_custkey").groupBy("i", *columns).agg(F.count("*").alias("n"))


#: The lines of orders, with a word of their own for each part.
LINES = "(SELECT *, CASE l_partkey % 4 WHEN 0 THEN 'AIR' WHEN 1 THEN 'FOB' WHEN 2 THEN 'MAIL' ELSE 'RAIL' END AS l_shipmode FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.get(F.array(*map(F.lit, ("AIR", "FOB", "MAIL", "RAIL"))), (F.col("l_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "lineitem").withColumn("l_shipmode", word)


FIELD_MAP = {"fields": {
    "who": {"sources": [{"band": "front", "nlp_labels": ["EMAIL"], "regex": [{"pattern": r"by (\w+)", "group": 1}]}, {"band": "back", "regex": [{"pattern": r"signed (\w+)", "group": 1}]}]},
    "fee": {"band": "front", "patterns": ["fee of {{value}} due"], "value_regex": r"\d+", "regex": [r"paid (\d+)"]},
}}
_MAPPED = ["by ana, fee of 12 due|x", "paid 7|signed bia", "mail a@b.co by ana|x", "x|y"]


@query(expected([(0, "who", "ana", "0:regex"), (0, "fee", "12", "0:regex"), (1, "who", "bia", "1:regex"), (1, "fee", "7", "0:regex"), (2, "who", "a@b.co", "0:label")], "i, field, value, source", 4))
def mapped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, _MAPPED)
    front, back = F.substring_index("x", "|", 1), F.substring_index("x", "|", -1)
    spans = F.transform(extract.entities(front), lambda e: F.struct(e["label"], e["text"]))
    found = rules.map_fields(rows, "c_custkey", {"front": front, "back": back}, rule_files.field_rules(FIELD_MAP), spans)
    return counted(rows, found, ["field", "value", "source"])


@query(f"""SELECT * FROM (VALUES ('who', 0, 'front', 'by (\\w+)', 1), ('who', 1, 'back', 'signed (\\w+)', 1), ('fee', 0, 'front', 'fee\\s+of\\s+(\\d+)\\s+due', 1), ('fee', 1, 'front', 'paid (\\d+)', 1), ('day', 0, 'full', 'on (\\d+)', 1)) v(field, ord, band, pattern, "group")""")
def pattern_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_files.pattern_catalog(spark, [FIELD_MAP, {"fields": {"fee": {"regex": [r"paid (\d+)"]}, "day": {"regex": [r"on (\d+)"]}}}])


STRATEGIES = [
    {"priority": 1.0, "sources": [{"bucket": "principal", "name_matches": ["*order*"]}], "patterns": [{"type": "regex", "label": "fee", "pattern": r"fee (\d+)", "field": "FEE", "weight": 1.0}, {"type": "keyword", "label": "law", "pattern": "Civil", "field": "AREA", "weight": 0.5}], "clean": [], "validate": []},
    {"priority": 2.0, "patterns": [{"type": "regex", "label": "pair", "pattern": r"(\w+) against (\w+)", "field": "A", "second_field": "B", "weight": 1.0}], "validate": ["VALIDATECOMARCA"]},
]


@query(expected([
    (0, "FEE", "12", "strategy_regex:fee", "0.73125"), (0, "FEE", "30", "strategy_regex:fee", "0.73125"), (0, "AREA", "civil", "strategy_keyword:law", "0.590625"),
    (1, "A", "ana", "strategy_regex:pair", "0.9"), (1, "B", "bia", "strategy_regex:pair", "0.9"), (1, "FEE", "7", "strategy_regex:fee", "0.617344"),
], "i, field, value, method, confidence", 3))
def strategy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, ["order.pdf|fee 12 and fee 30, civil", "other.pdf|fee 7, ana against bia, x against y", "order.pdf|"])
    found = rules.strategy_candidates(rows, "c_custkey", F.substring_index("x", "|", 1), F.substring_index("x", "|", -1), F.lit(1.0), STRATEGIES)
    return counted(rows, found.withColumn("confidence", F.round("confidence", 6).cast("string")), ["field", "value", "method", "confidence"])


SPAN_RULES = [
    {"key": "PERITO_CPF", "labels": ["CPF"], "before_any": ["perito", "perita"], "exclude_any": ["autor"], "window": 20, "priority": 1},
    {"key": "PAGO", "labels": ["VALOR"], "after_any": ["pago"], "window": 15, "priority": 2, "regex": {"pattern": r"total (\d+)", "group": 1}},
]


@query(expected([(0, "PERITO_CPF", "529.982.247-25", "CPF", 2), (1, "PERITO_CPF", "111.222.333-44", "CPF", 2), (1, "PAGO", "20,00", "VALOR", 3), (2, "PAGO", "5", "regex", 2)], "i, field, value, label, score", 3))
def span_rule_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, ["autor: 111.222.333-44, consta o laudo, perito 529.982.247-25", "Perita 111.222.333-44 e 20,00 e 10,00 pago", "total 5"])
    text = F.col("x")
    return counted(rows, rules.span_fields(rows, "c_custkey", text, extract.entities(text), SPAN_RULES), ["field", "value", "label", "score"])


@query(expected([(0, "WHO", "ana"), (0, "FEE", "12"), (2, "WHO", "bia b"), (2, "FEE", "7 now")], "i, field, value", 3))
def region_template_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, ["the expert ana gets  12 due", "the expert ana", "THE EXPERT bia b GETS 7 now due"])
    return counted(rows, rules.region_fields(rows, "c_custkey", F.col("x"), "the expert {{WHO}} gets {{FEE}} due"), ["field", "value"])


@query("SELECT doc_id, n, hits FROM (SELECT doc_id, n, hits, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, n) AS k FROM (SELECT doc_id, n - 1 AS n, contains(line, 'licensed under')::INTEGER + contains(line, 'the')::INTEGER AS hits FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))) AS lines FROM documents))) WHERE hits > 0) WHERE k = 1")
def best_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return rules.best_region(lines, "doc_id", "n", F.col("line"), ["Licensed  under {{WHAT}} the"]).select("doc_id", "n", "hits")


@query(f"SELECT l_orderkey, first, min(l_linenumber) FILTER (l_linenumber >= first AND l_shipmode = 'AIR') AS last FROM (SELECT *, min(l_linenumber) FILTER (l_returnflag = 'N') OVER (PARTITION BY l_orderkey) AS first FROM {LINES}) GROUP BY 1, 2 HAVING last IS NOT NULL AND first IS NOT NULL")
def operator_range_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.concat_ws(" ", F.concat(F.lit("flag"), F.col("l_returnflag")), F.concat(F.lit("mode"), F.col("l_shipmode"))).alias("t"))
    return rules.operator_range(lines, "l_orderkey", "l_linenumber", "t", "flagN", "modeAIR$")


@query(expected([(0, "cpf", "529.982.247-25", "true"), (0, "name", "Ana Lima", "false"), (1, "cpf", "111.222.333-44", "false"), (2, "name", "Bia", "false")], "i, field, value, moved", 3))
def relocated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, ["name=Ana Lima;court=x 529.982.247-25", "cpf=111.222.333-44;court=529.982.247-25", "name=Bia;court=12"])
    parts = rows.select("c_custkey", F.explode(F.split("x", ";")).alias("p")).select("c_custkey", F.substring_index("p", "=", 1).alias("field"), F.substring_index("p", "=", -1).alias("value"))
    found = rules.relocated(parts, "c_custkey", "field", "value", F.col("field") != "court", {"cpf": r"\d{3}\.\d{3}\.\d{3}-\d{2}"})
    return counted(rows, found.withColumn("moved", F.col("moved").cast("string")), ["field", "value", "moved"])


@query(expected([(0, "fee", "12", "1.0"), (0, "who", "ana", "0.85"), (1, "fee", "7", "0.85")], "i, field, value, confidence", 2))
def rescanned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, ["12|fee 9 by ana", "|fee 7"])
    fields = rows.select("c_custkey", F.lit("fee").alias("field"), F.substring_index("x", "|", 1).alias("value"))
    found = rules.rescanned(fields, rows.withColumn("t", F.substring_index("x", "|", -1)), "c_custkey", "field", "value", "t", {"fee": [(r"fee (\d+)", 1)], "who": [(r"by (\w+)", 1)]})
    return counted(rows, found.withColumn("confidence", F.col("confidence").cast("string")), ["field", "value", "confidence"])


@query("""
    WITH r AS (SELECT p_brand AS kind, p_size <= 25 AS active, p_name AS name FROM part),
    g AS (SELECT kind, bool_or(true) AS b, active, count(*) AS rules, list_sort(list(DISTINCT name)) AS names FROM r GROUP BY kind, active)
    SELECT kind, active, rules, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' +' || (len(names) - 3) ELSE '' END AS about FROM g""")
def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), F.when(F.col("p_size") <= 25, F.col("p_brand")).otherwise("off").alias("state"), F.col("p_name").alias("name"))
    flagged = parts.withColumn("active", F.col("kind") == F.col("state"))
    both = [rule_files.rule_catalog(flagged.where(flag).drop("active", "state"), "kind", names) for flag, names in ((F.col("active"), [r[0] for r in _brands(spark, sf_dir)]), (~F.col("active"), []))]
    return both[0].unionByName(both[1])


def _brands(spark: SparkSession, sf_dir: str) -> list:
    return table(spark, sf_dir, "part").select("p_brand").distinct().collect()  # 25 names, whatever the table's size


FEES = [("1.1", "A", "300.00", 0), ("1.1A", "A", "300.00", 1), ("2.1", "B", "430.00", 2), ("3.1", "C", "1000.00", 3)]


def _fees(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEES, "id string, area string, fee string, ord int").withColumn("fee", F.col("fee").cast("decimal(24,8)"))


@query(expected([(0, "1.1", "raw", "310.00", "area", "0.75"), (1, "2.1", "raw", "400.00", "alias", "0.9"), (2, "3.1", "percent_total", "1000.00", "all", "0.6"), (3, "2.1", "raw", "420.00", "all", "0.6"), (4, "1.1", "multiple_2", "300.00", "area", "0.75")], "i, entry, way, value, source, confidence", 6))
def fee_table_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value / percent / instalments / alias / area of each case against a small table of fees."""
    rows = case_rows(spark, sf_dir, ["310/-/-/-/A", "400/-/-/2.1/B", "150/15/-/-/Z", "420/-/-/-/Z", "600/-/-/-/A", "5/-/-/-/A"])
    at = lambda n: F.nullif(F.get(F.split("x", "/"), F.lit(n)), F.lit("-"))
    asked = rows.select("c_custkey", F.lit("V").alias("field"), at(0).cast("decimal(18,2)").alias("value"), at(1).cast("double").alias("percent"), at(2).cast("int").alias("parts"), at(3).alias("alias"), at(4).alias("area"))
    found = enrich.fee_matches(asked, "c_custkey", _fees(spark))
    return counted(rows, found.select("c_custkey", "entry", "way", F.col("value").cast("decimal(18,2)").cast("string").alias("value"), "source", F.col("confidence").cast("string").alias("confidence")), ["entry", "way", "value", "source", "confidence"])


@query(expected([(0, "ok", "1.1", "JZ", "0.75"), (1, "ambiguous_match", None, None, None), (2, "ok", "2.1", "FATOR", "0.95"), (3, "ambiguous_match", None, None, None), (4, "ok", "9", "FATOR", "0.95"), (5, "ok", "1.1", "DE", "0.9")], "i, status, entry, field, confidence", 6))
def chosen_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches field:entry:confidence of each case, and the entry that its document names."""
    rows = case_rows(spark, sf_dir, ["JZ:1.1:0.75|-", "JZ:1.1:0.75 DE:2.1:0.9|-", "JZ:2.1:0.6|2.1", "JZ:1.1:0.6|2.1", "|9", "JZ:1.1:0.75 DE:1.1:0.9|-"])
    parts = rows.select("c_custkey", F.explode(F.filter(F.split(F.substring_index("x", "|", 1), " "), lambda p: p != "")).alias("p"))
    at = lambda n: F.get(F.split("p", ":"), F.lit(n))
    matches = parts.select("c_custkey", at(0).alias("field"), at(1).alias("entry"), at(2).cast("double").alias("confidence"), F.lit(0.0).alias("difference"), F.lit(1).alias("value"))
    factors = rows.select("c_custkey", F.nullif(F.substring_index("x", "|", -1), F.lit("-")).alias("entry")).where("entry is not null")
    found = enrich.choose_fee(matches, "c_custkey", factors).withColumn("confidence", F.col("confidence").cast("string"))
    return counted(rows, found, ["status", "entry", "field", "confidence"])


def _experts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Ana Élida Teste", "529.982.247-25", "engenheira"), ("Bia Exemplo", "111.222.333-44", "médica")], "name string, cpf string, specialty string")


@query(expected([(0, "Ana Élida Teste", "529.982.247-25", "engenheira", "cpf_from_name,specialty"), (1, "Bia Exemplo", "11122233344", "médica", "name_from_cpf,specialty"), (2, "Caio", "", None, "")], "i, name, cpf, specialty, derived", 3))
def completed_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, ["ANA ELIDA TESTE|", "|11122233344", "Caio|"])
    people = rows.select("c_custkey", F.substring_index("x", "|", 1).alias("name"), F.substring_index("x", "|", -1).alias("cpf"))
    found = enrich.complete_experts(people, "c_custkey", "name", "cpf", _experts(spark))
    named = F.when(F.col("name") == "ANA ELIDA TESTE", "Ana Élida Teste").otherwise(F.col("name"))
    return counted(rows, found.select("c_custkey", named.alias("name"), "cpf", "specialty", F.array_join("derived", ",").alias("derived")), ["name", "cpf", "specialty", "derived"])


@query(expected([(0, "true", "cpf", "true", "true"), (1, "true", "name", "false", "false"), (2, "false", None, None, None)], "i, found, match_by, cpf_matches, specialty_matches", 3))
def checked_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, ["x|52998224725|Engenheira", "bia exemplo|000|poeta", "Caio|1|x"])
    at = lambda n: F.get(F.split("x", r"\|"), F.lit(n))
    found = enrich.check_experts(rows.select("c_custkey", at(0).alias("name"), at(1).alias("cpf"), at(2).alias("specialty")), "c_custkey", "name", "cpf", "specialty", _experts(spark))
    none = F.col("match_by").isNull()
    flag = lambda c: F.when(none, F.lit(None)).otherwise(F.col(c).cast("string")).alias(c)
    return counted(rows, found.select("c_custkey", F.col("found").cast("string").alias("found"), "match_by", flag("cpf_matches"), flag("specialty_matches")), ["found", "match_by", "cpf_matches", "specialty_matches"])


@query(f"SELECT l_linestatus, l_returnflag, count(*) AS n, count(*) FILTER (l_returnflag IN ('A', 'R') AND l_linestatus <> 'F') AS cleared, count(*) FILTER (l_returnflag IN ('A', 'R') AND l_linestatus <> 'F') AS empty FROM {LINES} GROUP BY 1, 2")
def strict_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("l_linestatus", "l_returnflag", F.col("l_quantity").cast("string").alias("v"))
    kept = enrich.explicit_amounts(lines, "l_returnflag", "v", "l_linestatus", ["A", "R"], ["F"])
    return kept.groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.count_if("cleared").alias("cleared"), F.count_if(F.col("v") == "").alias("empty"))


_PAGES = """SELECT user_id, page, CASE event_type WHEN 'view' THEN 'DESPACHO' WHEN 'click' THEN 'CERTIDAO' ELSE 'UNKNOWN' END AS kind, value > 60 AS confirmed,
    CASE WHEN value < 10 THEN 'DESPACHO' END AS strong FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page FROM events)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ordered_pages = table(spark, sf_dir, "events")
    from pyspark.sql import Window as W

    page = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    kind = F.when(F.col("event_type") == "view", "DESPACHO").when(F.col("event_type") == "click", "CERTIDAO").otherwise("UNKNOWN")
    return ordered_pages.select("user_id", page.alias("page"), kind.alias("kind"), (F.col("value") > 60).alias("confirmed"), F.when(F.col("value") < 10, "DESPACHO").alias("strong"), events["value"])


@query(f"""
    WITH p AS ({_PAGES}), q AS (SELECT *, coalesce(strong, kind) AS own, coalesce(lag(confirmed) OVER (PARTITION BY user_id ORDER BY page), false) AS behind FROM p)
    SELECT user_id, page, CASE WHEN confirmed OR (behind AND own = 'UNKNOWN') THEN 'DESPACHO' WHEN own = 'DESPACHO' AND NOT behind AND strong IS NULL THEN 'UNKNOWN' ELSE own END AS resolved FROM q""")
def followed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.follow_up(_pages(spark, sf_dir), "user_id", "page", "kind", "confirmed", "strong", "DESPACHO").select("user_id", "page", "resolved")


@query(f"""
    WITH p AS ({_PAGES.replace("value > 60 AS confirmed", "value > 60 AS confirmed, value")}), s AS (SELECT user_id, kind, count(*) AS pages, avg(CASE WHEN value > 0 THEN page * 1000.0 / value ELSE 0 END) AS d, avg(value / 1000) AS o, bool_or(confirmed) AS c, bool_or(strong IS NOT NULL) AS t FROM p GROUP BY 1, 2)
    SELECT user_id, kind, pages, round(pages * 1000.0 + d * 10 - o * 200 + CASE WHEN c THEN 200 ELSE 0 END + CASE WHEN t THEN 50 ELSE 0 END, 3) AS score FROM s""")
def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"confirmed": (F.col("confirmed"), 200.0), "titled": (F.col("strong").isNotNull(), 50.0)}
    found = assemble.segment_scores(_pages(spark, sf_dir), ["user_id", "kind"], F.col("page"), F.col("value"), F.col("value") / 1000, flags)
    return found.select("user_id", "kind", "pages", F.round("score", 3).alias("score"))


@query(f"""
    WITH p AS ({_PAGES}), q AS (SELECT *, coalesce(strong, kind) AS own, coalesce(lag(confirmed) OVER (PARTITION BY user_id ORDER BY page), false) AS behind FROM p),
    r AS (SELECT user_id, page, CASE WHEN confirmed OR (behind AND own = 'UNKNOWN') THEN 'DESPACHO' WHEN own = 'DESPACHO' AND NOT behind AND strong IS NULL THEN 'UNKNOWN' ELSE own END AS k FROM q),
    g AS (SELECT *, sum(CASE WHEN k = prev THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY page) AS run FROM (SELECT *, lag(k, 1, '') OVER (PARTITION BY user_id ORDER BY page) AS prev FROM r)),
    s AS (SELECT user_id, run, k AS kind, min(page) AS first, max(page) AS last FROM g GROUP BY 1, 2, 3),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY last - first DESC, first) AS n FROM (SELECT user_id, first, last, CASE WHEN kind = 'DESPACHO' AND last - first < 1 THEN 'UNKNOWN' ELSE kind END AS kind FROM s))
    SELECT user_id, kind, first, last FROM b WHERE n = 1 AND kind <> 'UNKNOWN'""")
def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to documents: kinds with follow-ups, runs of a kind, too short ones demoted, the longest of each kind."""
    pages = assemble.follow_up(_pages(spark, sf_dir), "user_id", "page", "kind", "confirmed", "strong", "DESPACHO")
    runs = ordered.islands(pages.select("user_id", "resolved", "page"), ["user_id", "resolved"], "page").select("user_id", F.col("resolved").alias("kind"), F.col("run_start").alias("first"), F.col("run_end").alias("last"))
    sized = assemble.short_segments(runs, "kind", F.col("last") - F.col("first") + 1, {"DESPACHO": 2}).drop("error").withColumn("size", F.col("last") - F.col("first"))
    return assemble.best_of(sized.where("kind != 'UNKNOWN'"), ["user_id", "kind"], "size", ["first"]).drop("size")


@query("SELECT o_orderkey, o_custkey % 4 * 1000 + o_orderkey % 2 * 100 + CASE WHEN o_orderstatus = 'F' THEN 10000 ELSE -1000 END - o_orderkey % 3 * 5 - o_orderkey % 7 AS score FROM orders")
def primary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", assemble.primary_score(F.col("o_custkey") % 4, F.col("o_orderkey") % 2, F.col("o_orderstatus") == "F", F.col("o_orderkey") % 3, F.col("o_orderkey") % 7).alias("score"))


@query(f"""
    WITH c AS (SELECT l_orderkey, 'f' || l_linenumber % 2 AS field, l_shipmode AS value, l_discount AS confidence, CASE WHEN l_returnflag = 'A' THEN 'align' WHEN l_returnflag = 'N' THEN 'text' ELSE 'other' END AS method FROM {LINES}),
    r AS (SELECT *, CASE method WHEN 'align' THEN 3 WHEN 'text' THEN 2 ELSE 1 END AS p FROM c WHERE value <> 'RAIL'),
    m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, field ORDER BY p DESC, confidence DESC, value DESC, method DESC) AS k, dense_rank() OVER (PARTITION BY l_orderkey, field ORDER BY lower(value)) AS f FROM r)
    SELECT l_orderkey, field, CASE WHEN max(f) > 1 THEN 'AMBIGUOUS' ELSE max(value) END AS strict_value, max(value) FILTER (k = 1) AS value, max(method) FILTER (k = 1) AS method, max(f)::BIGINT AS forms FROM m GROUP BY 1, 2""")
def resolved_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("l_orderkey", F.concat(F.lit("f"), (F.col("l_linenumber") % 2).cast("string")).alias("field"), F.col("l_shipmode").alias("value"), F.col("l_discount").alias("confidence"), "l_returnflag")
    sources = {m: lines.where(F.col("l_returnflag") == r) for m, r in (("align", "A"), ("text", "N"), ("other", "R"))}
    every = assemble.collect_candidates(sources, "l_orderkey", {"align": 3, "text": 2})
    form, good = F.lower("value"), F.col("value") != "RAIL"
    strict = assemble.resolve_candidates(every, ["l_orderkey", "field"], form, good, strict=True).select("l_orderkey", "field", F.col("value").alias("strict_value"))
    return assemble.resolve_candidates(every, ["l_orderkey", "field"], form, good).select("l_orderkey", "field", "value", "method", "forms").join(strict, ["l_orderkey", "field"])


_FINAL = {"FOB": ["A", "N"], "AIR": ["N"], "MAIL": ["R", "N", "A"]}
_FINAL_RANK = " ".join(f"WHEN l_shipmode = '{f}' AND l_returnflag = '{k}' THEN {i}" for f, ks in _FINAL.items() for i, k in enumerate(ks))


@query(f"""
    SELECT l_orderkey, l_shipmode, v, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_shipmode ORDER BY CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END, p, v, l_returnflag) AS n FROM (
        SELECT l_orderkey, l_shipmode, l_partkey::VARCHAR AS v, l_returnflag, l_linestatus, CASE {_FINAL_RANK} END AS p FROM {LINES}) WHERE p IS NOT NULL) WHERE n = 1""")
def final_record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("l_orderkey", "l_returnflag", "l_shipmode", F.col("l_partkey").cast("string").alias("v"), "l_linestatus")
    return assemble.final_fields(lines, "l_orderkey", "l_returnflag", "l_shipmode", "v", F.col("l_linestatus") == "F", _FINAL)


@query(f"""
    WITH r AS (SELECT l_orderkey AS g, min(l_linenumber) AS first, min(l_linenumber) + 1 AS last FROM {LINES} WHERE l_returnflag = 'N' GROUP BY 1),
    n AS (SELECT r.*, p.l_linenumber AS page, p.l_shipmode = 'AIR' AS h, p.l_shipmode = 'MAIL' AS f FROM r LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_shipmode FROM {LINES}) p ON p.l_orderkey = r.g AND p.l_linenumber BETWEEN first - 1 AND first + 3)
    SELECT g AS l_orderkey, CASE WHEN bool_or(page = first - 1 AND h) THEN first - 1 ELSE first END AS first, coalesce(min(page) FILTER (f AND page >= last), greatest(last, max(page))) AS last FROM n GROUP BY g, first, last""")
def widened_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("l_shipmode") == "AIR").alias("h"), (F.col("l_shipmode") == "MAIL").alias("f"), "l_returnflag")
    ranges = lines.where("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"), (F.min("l_linenumber") + 1).alias("last"))
    return assemble.widen(lines, ranges, "l_orderkey", "l_linenumber", "first", "last", "h", "f", 4)


@query(f"SELECT l_orderkey, l_linestatus, count(*) AS pages, sum(l_quantity)::BIGINT AS words, sum(l_linenumber)::BIGINT AS images, sum(l_partkey % 3)::BIGINT AS annotations, bool_or(l_shipmode = 'AIR') AS has_form, bool_or(l_partkey % 3 > 0) AS has_annotation FROM {LINES} GROUP BY 1, 2")
def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _lines(spark, sf_dir).select("l_orderkey", "l_linestatus", F.col("l_quantity").cast("long").alias("w"), F.col("l_linenumber").cast("long").alias("i"), (F.col("l_shipmode") == "AIR").alias("f"), (F.col("l_partkey") % 3).alias("a"))
    return assemble.document_totals(pages, ["l_orderkey", "l_linestatus"], "w", "i", "f", "a")


@query(f"""
    WITH w AS (SELECT l_orderkey, lower(max(l_shipmode) FILTER (l_linenumber = 1)) AS a, lower(max(l_shipmode) FILTER (l_linenumber = 2)) AS b FROM {LINES} GROUP BY 1), e AS (SELECT l_orderkey FROM w WHERE a = b)
    SELECT (SELECT count(*) FROM orders) AS files, (SELECT sum(o_custkey % 3)::BIGINT FROM orders) AS documents, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS invalid, (SELECT count(*) FROM orders WHERE o_custkey % 3 = 0) AS empty,
        (SELECT count(*) FROM e) AS equal, (SELECT array_to_string(list(l_orderkey ORDER BY l_orderkey)[1:10], ',') FROM e) AS examples""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("ok"), (F.col("o_custkey") % 3).alias("d"))
    fields = _lines(spark, sf_dir).select("l_orderkey", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), F.col("l_shipmode").alias("value"))
    out = assemble.report_totals(files, fields, "l_orderkey", "ok", "d", [("f1", "f2")])
    first = F.get("warnings", F.lit(0))
    return out.select("files", "documents", "invalid", "empty", F.coalesce(first["n"], F.lit(0)).alias("equal"), F.array_join(F.transform(first["examples"], lambda x: x.cast("string")), ",").alias("examples"))


@query(f"SELECT l_shipmode, l_returnflag, count(*) AS count, array_to_string(list(l_orderkey || ':' || l_linenumber ORDER BY l_orderkey, l_linenumber)[1:5], ' ') AS examples FROM (SELECT DISTINCT l_shipmode, l_returnflag, l_orderkey, l_linenumber FROM {LINES}) GROUP BY 1, 2")
def anchor_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("l_shipmode", "l_returnflag", "l_orderkey", "l_linenumber").distinct()
    found = assemble.anchor_concepts(lines, "l_shipmode", "l_returnflag", ["l_orderkey", "l_linenumber"])
    return found.withColumn("examples", F.array_join(F.transform("examples", lambda e: F.concat_ws(":", e["l_orderkey"].cast("string"), e["l_linenumber"].cast("string"))), " "))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'rich' WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS fonts FROM customer")
def overridden_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    own = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.array("c_name")).alias("fonts"))
    rich = c.where("c_custkey % 3 = 0 or c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("rich"))).otherwise(F.array().cast("array<string>")).alias("more"))
    return assemble.with_override(own, ["c_custkey"], "fonts", rich, "more").withColumn("fonts", F.array_join("fonts", ","))


@query("SELECT c_custkey, c_nationkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END, n_regionkey)::BIGINT AS page FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def band_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).cast("long").alias("page"))
    bands = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("page"))
    return assemble.band_default(rows, "c_nationkey", ["page"], bands)


@query("SELECT s_suppkey, m.model FROM supplier JOIN (SELECT n_nationkey, min(c_name) AS model FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) m ON s_nationkey = m.n_nationkey")
def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("kind"), F.col("c_name").alias("model"))
    return assemble.pair_with_model(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("kind")), models, "kind").select("s_suppkey", "model")


@query(f"SELECT l_orderkey, greatest(1, min(l_linenumber) - 1)::INTEGER AS first, max(l_linenumber)::INTEGER AS last FROM {LINES} WHERE l_returnflag <> 'N' GROUP BY 1")
def variable_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "fixed").otherwise("variable").alias("kind"))
    found = assemble.variable_range(assemble.keep_kinds(steps, "kind", "variables"), "l_orderkey", "kind", "l_linenumber", 1)
    return found.select("l_orderkey", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


@query(f"SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last FROM (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM {LINES} WHERE l_returnflag = 'N')) GROUP BY l_orderkey, g")
def variable_slot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("v"))
    return assemble.variable_slots(slots, "l_orderkey", "l_linenumber", "v")


@query("""
    WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'a' END AS v, c_custkey % 3 / 10.0 AS c FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey, 'b' AS v, 0.1 AS c FROM customer WHERE c_custkey % 7 <> 0)
    SELECT c_custkey, coalesce(CASE WHEN a.c_custkey IS NULL THEN b.v WHEN b.c_custkey IS NULL THEN a.v WHEN a.v = '' THEN b.v WHEN a.c >= b.c THEN a.v ELSE b.v END) AS v FROM a FULL JOIN b USING (c_custkey)""")
def surer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    a = c.where(key % 5 != 0).select("c_custkey", F.when(key % 4 == 0, "").otherwise("a").alias("v"), (key % 3 / 10.0).alias("c"))
    b = c.where(key % 7 != 0).select("c_custkey", F.lit("b").alias("v"), F.lit(0.1).alias("c"))
    return assemble.prefer_sure(a, b, ["c_custkey"], "v", "c").select("c_custkey", "v")


@query(expected([(0, "despacho", "order", "main"), (1, "certidao", "cert", "side"), (2, "outros", "outros", "outros")], "i, canon, macro, subcat", 3))
def titled_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, ["DESPACHO  inicial", "Nova Certidão", "x"])
    exact = spark.createDataFrame([("despacho inicial", "despacho", "order", "main")], "title string, canon string, macro string, subcat string")
    found = documents.classify_titles(rows.select("c_custkey", "x"), "x", exact, [("certidao", "certidao", "cert", "side"), ("despacho", "other", "o", "o")])
    return counted(rows, found, ["canon", "macro", "subcat"])


_ALIKE = ["a b c d e|a b x d e", "Vara: 3|Comarca: 3", "Vara: 3|Vara: 4", "um dois tres quatro|um dois tres", "|x", "Perito Ana|perito ana"]


@query(case_sql(["0.22 0.7116 0.7116 0.1111 0.8889", "0.61 0.624 -0.016 0.4 0.5556", "0.61 0.813 1 0.1429 0.8333", "0.75 0.6671 0.6671 0.3684 0.6316", "0 0 0 1 0", "1 0.902 1 0.2 1"]))
def block_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of words, of words and letters, of labelled blocks; line ratio; report similarity."""

    def run(batches):
        for rows in batches:
            out = []
            for x in rows["x"]:
                a, _, b = x.partition("|")
                values = align.word_similarity(a, b), align.similarity(a, b), align.alignment_similarity(a, b), align.line_ratio(a, b), align.report_similarity(a, b)
                out.append(" ".join(f"{v:.4f}".rstrip("0").rstrip(".") for v in values))
            yield pd.DataFrame({"i": rows["i"], "y": out})

    rows = case_rows(spark, sf_dir, _ALIKE).groupBy("i", "x").agg(F.count("*").alias("n"))
    return rows.join(rows.select("i", "x").mapInPandas(run, "i int, y string"), "i").select("i", "y", "n")
