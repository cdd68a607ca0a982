"""Queries over formats, repair, validation, subtypes, tables and artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import checks, documents, ordered, scores, sinks
from quarry.plans.cases import case_rows, cases
from quarry.plans.record_queries import _lines, LINES, counted, expected
from quarry.plans.registry import query
from quarry.sources import tables
from quarry.storage import table

_split = lambda c, n: F.get(F.split(c, r"\|"), F.lit(n))

cases("field_formats", lambda c: checks.valid_format(_split(c, 0), _split(c, 1)), [
    ("PROCESSO_JUDICIAL|0801234-56.2024.8.15.2001", "true"), ("PROCESSO_JUDICIAL|0801234-56.2024.815.2001", "true"), ("PROCESSO_JUDICIAL|0801234.56.2024.8.15.2001", "true"), ("PROCESSO_JUDICIAL|0801234.56.2024.815.2001", "true"),
    ("PROCESSO_JUDICIAL|200.2009.123.456-7", "true"), ("PROCESSO_JUDICIAL|08012345620248152001", "true"), ("PROCESSO_JUDICIAL|0801234", "false"),
    ("PROCESSO_ADMINISTRATIVO|012345-67.2024.8.15", "true"), ("PROCESSO_ADMINISTRATIVO|2024.123.456", "true"), ("PROCESSO_ADMINISTRATIVO|2024123456", "true"), ("PROCESSO_ADMINISTRATIVO|12/03/2024", "false"),
    ("PROCESSO_ADMINISTRATIVO|58000-123", "false"), ("PROCESSO_ADMINISTRATIVO|12/2024", "false"), ("PROCESSO_ADMINISTRATIVO|2024/12", "false"), ("PROCESSO_ADMINISTRATIVO|1823456789", "false"),
    ("VALOR_ARBITRADO_JZ|R$ 1.234,50", "true"), ("VALOR_ARBITRADO_JZ|1234,50", "true"), ("VALOR_ARBITRADO_JZ|1234", "false"), ("ADIANTAMENTO|1234,50", "false"), ("ADIANTAMENTO|30%", "true"), ("PARCELA|1234,50", "true"),
    ("PERCENTUAL|30,5 %", "true"), ("PERCENTUAL|30", "false"), ("DATA_REQUISICAO|5 de abril de 2024", "true"), ("DATA_REQUISICAO|abril", "false"), ("CPF_PERITO|529.982.247-25", "true"), ("CPF_PERITO|1", "false"),
    ("PERITO|Ana L", "true"), ("PERITO|Ana", "false"), ("PROMOVENTE|Ana Exemplo", "true"), ("PROMOVENTE|Ana 1", "false"), ("ESPECIALIDADE|Engenharia", "true"), ("ESPECIALIDADE|Ana Exemplo", "false"),
    ("COMARCA|Campina Grande / PB", "true"), ("COMARCA|3a", "false"), ("VARA|3a Vara", "true"), ("VARA|Lima", "false"), ("OTHER|x", "true"), ("OTHER| ", "false"),
])
_record = lambda c: F.from_json(c, "map<string,string>")
_good = '"PROCESSO_ADMINISTRATIVO":"2024123456"'
cases("validated_records", lambda c: F.to_json(checks.validate_record(F.substring_index(c, "|", 1), _record(F.substring_index(c, "|", -1)))), [
    ('REQUERIMENTO_HONORARIOS|{%s,"DATA_REQUISICAO":"7/2/2024"}' % _good, '{"ok":true,"changed":[]}'),
    ("REQUERIMENTO_HONORARIOS|{%s}" % _good, '{"ok":false,"reason":"MISSING_DATA_REQUISICAO","changed":[]}'),
    ('CERTIDAO_CM|{%s,"DATA_ARBITRADO_FINAL":"7/2/2024"}' % _good, '{"ok":true,"changed":["DATA_AUTORIZACAO_CM"]}'),
    ('CERTIDAO_CM|{%s,"VALOR_ARBITRADO_CM":"x"}' % _good, '{"ok":false,"reason":"INVALID_VALOR_ARBITRADO_CM","changed":[]}'),
    ('REQUERIMENTO_HONORARIOS|{%s,"DATA_REQUISICAO":"7/2/2024","CPF_PERITO":"529.982.247-25","PERITO":"Perita Ana 1"}' % _good, '{"ok":true,"changed":["CPF_PERITO"]}'),
    ('REQUERIMENTO_HONORARIOS|{%s,"DATA_REQUISICAO":"7/2/2024","PROCESSO_JUDICIAL":"12"}' % _good, '{"ok":true,"changed":["PROCESSO_JUDICIAL"]}'),
    ("DESPACHO|{}", '{"ok":false,"reason":"MISSING_PROCESSO_ADMINISTRATIVO","changed":[]}'),
])
cases("catalog_names", lambda c: checks.expert_from_catalog(_split(c, 0), _split(c, 1).cast("double"), F.lit("Ana Catalogo")), [("Ana Exemplo|0.7", "Ana Exemplo"), ("Ana Exemplo|0.5", "Ana Catalogo"), ("perito Ana|0.9", "Ana Catalogo"), ("|0.9", "Ana Catalogo")])
cases("subtypes", lambda c: F.to_json(checks.subtype(_split(c, 0), _split(c, 1), "order", [("council", ["Conselho da Magistratura"]), ("budget", ["georc"])], [("budget", r"reserva de R\$")])), [
    ("order|ao conselho da  magistratura", '{"status":"ok","subtype":"council","reason":"hint"}'), ("order|a reserva de R$ 5", '{"status":"ok","subtype":"budget","reason":"pattern"}'), ("order|x", '{"status":"ok","subtype":"other","reason":"no_hint"}'),
    ("note|georc", '{"status":"skip"}'), ("order|", '{"status":"no_back_text"}'),
])
cases("signals_of_pages", lambda c: F.to_json(checks.page_signals(_split(c, 1), _split(c, 0), {"header": ["Tribunal"], "title": ["certidão"]})), [("TRIBUNAL|CERTIDAO de R$ 5", '{"header":true,"title":true,"money":true}'), ("x|nada", '{"header":false,"title":false,"money":false}')])
cases("footer_days", checks.plain_day, [("Capital, 5 de abril de 2024.", "2024-04-05"), ("em 07/02/2024 às 10h", "2024-02-07"), ("em 5 de Março de 2024", "2024-03-05"), ("x", None)])
cases("anchors_of_blocks", lambda c: checks.anchor_blocks(c, 3, 20, 3), [("Vara:", "true"), ("ab", "false"), ("a b c d", "false"), ("x" * 21, "false"), (None, "false")])
cases("canonical_paths", tables.canonical, [("C:\\A\\b.pdf", "c:/a/b.pdf"), ("./a//./B.pdf", "a/b.pdf"), ("/x/y/../z.pdf", "/x/z.pdf")])


@query(f"""
    WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'a word' ELSE 'one two ' || l_shipmode END AS t, CASE WHEN l_linenumber % 2 = 0 THEN '1W' ELSE 'WWW' END AS p FROM {LINES}),
    c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, p) <= 2 AND CASE WHEN p = '1W' THEN 4 ELSE greatest(3, length(t) - 8) END >= 4 AS v FROM b)
    SELECT l_orderkey, l_linenumber, CASE WHEN t LIKE '%FOB' THEN true WHEN t LIKE '%AIR' THEN false ELSE v END AS variable FROM c""")
def classified_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("l_linenumber") % 2 == 0, "a word").otherwise(F.concat(F.lit("one two "), F.col("l_shipmode")))
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", word.alias("t"))
    return checks.classify_blocks(rows, "l_orderkey", "l_linenumber", "t", 4, 2, F.col("t").endswith("AIR"), F.col("t").endswith("FOB")).drop("t")


@query(f"SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM {LINES} WHERE l_returnflag = 'N' AND l_shipmode IN ('AIR', 'MAIL') GROUP BY 1")
def first_signal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _lines(spark, sf_dir).withColumn("listed", F.col("l_returnflag") == "N")
    signals = F.struct(F.col("l_shipmode").isin("AIR", "MAIL").alias("title"))
    return checks.first_page(pages, "l_orderkey", "l_linenumber", "listed", signals, ["title"])


@query(f"""
    SELECT l_orderkey, s AS start, min(l_linenumber) FILTER (l_shipmode = 'FOB') AS value, min(l_linenumber) FILTER (l_shipmode = 'MAIL') AS day
    FROM {LINES} JOIN (SELECT l_orderkey, min(l_linenumber) AS s FROM {LINES} WHERE l_shipmode = 'AIR' GROUP BY 1) USING (l_orderkey) WHERE l_linenumber >= s GROUP BY 1, 2""")
def decision_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.amount_regions(_lines(spark, sf_dir), "l_orderkey", "l_linenumber", "l_shipmode", "^AIR$", "^FOB$", "^MAIL$")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment ILIKE '%au%' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
def listed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.list_rows(table(spark, sf_dir, "customer"), [F.desc("c_acctbal"), "c_custkey"], "c_mktsegment", "AU", 20, 5).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return tables.one_row(orders, o_orderkey=orders.agg(F.min("o_orderkey")).first()[0]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def child_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity")
    parents = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
    return tables.child_rows(children, parents, ["k"], ["o_orderstatus"]).withColumnRenamed("k", "l_orderkey")


@query("SELECT * FROM (VALUES (0, 1, 'AFRICA'), (1, 3, 'ASIA'), (1, 4, 'EUROPE'), (2, 0, 'x/m.pdf'), (3, 0, './b.pdf')) v(n, k, r_name)")
def expanded_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.expand_inputs(table(spark, sf_dir, "region"), "r_name", [":K1", ":k3-4,@M-ONE", "./b.pdf , asia", "B.pdf"], {"ONE": ["x/m.pdf"]})


@query(expected([(0, None), (1, "no_header"), (2, "empty"), (3, "empty")], "i, problem", 4))
def preflight_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, ["%PDF-1.7", "html", "", None]).withColumn("b", F.col("x").cast("binary"))
    return tables.preflight(rows, "i", "b", b"%PDF-").groupBy("i", "problem").agg(F.count("*").alias("n"))


@query(expected([(0, "true", "Ana", "3"), (1, "true", None, None), (2, "false", None, None), (3, "false", None, None)], "i, valid, name, pages", 4))
def raw_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, ['{"name":"Ana","pages":3,"x":1}', "{}", "not json", None])
    found = tables.from_raw(rows, "c_custkey", "x", "name string, pages int")
    return counted(rows, found.withColumn("valid", F.coalesce("valid", F.lit(False)).cast("string")).withColumn("pages", F.col("pages").cast("string")), ["valid", "name", "pages"])


@query("SELECT v.*, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS n FROM (VALUES (0, '1.1', 'a'), (1, '1.1', 'b'), (1000, '2', 'c')) v(ord, target_id, keyword)")
def alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, ['[{"target_id":"1.1","keywords":["a","b"]},{"target_id":"2","keywords":["c"]}]', "x"])
    return tables.alias_rows(rows, "x").groupBy("ord", "target_id", "keyword").agg(F.count("*").alias("n"))


@query(expected([(0, "VARA", "3", "0.7", "r"), (0, "FEE", "7", None, None)], "i, field, value, confidence, source", 2))
def field_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_rows(spark, sf_dir, ['{"VARA":{"value":"3","confidence":0.7,"source":"r"},"FEE":{"value_raw":"7"}}', "{}"])
    found = tables.field_rows(rows, "c_custkey", "x").withColumn("confidence", F.col("confidence").cast("string"))
    return counted(rows, found, ["field", "value", "confidence", "source"])


@query(f"SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipmode, l_quantity) - 1)::INTEGER AS ord, l_shipmode AS mode, l_quantity AS q FROM {LINES}")
def child_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_shipmode").alias("mode"), F.col("l_quantity").alias("q")))).alias("c"))
    return sinks.child_records(lines, ["l_orderkey"], "c", ["mode", "q"])


@query("SELECT 1 AS step, 'read' AS name, 'ok' AS status, (SELECT count(*) FROM orders)::BIGINT AS rows UNION ALL SELECT 2, 'keep', 'ok', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')::BIGINT UNION ALL SELECT 3, 'late', 'skipped', NULL")
def run_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("read", lambda _: table(spark, sf_dir, "orders")), ("keep", lambda df: df.where("o_orderstatus = 'F'")), ("late", lambda df: df)]
    return sinks.run_steps(spark, steps, 1, 2)[1].select("step", "name", "status", "rows")


@query("SELECT o_custkey, count(*) AS pages, round(avg(o_totalprice), 4) AS density, sum(o_orderkey % 50)::BIGINT AS words FROM orders GROUP BY 1")
def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", (F.col("o_orderkey") % 50).alias("words"))
    return scores.page_averages(pages, ["o_custkey"], {"density": F.col("o_totalprice")}, {"words": F.col("words")})


cases("similarity_texts", documents.similarity_text, [("<Vara>", "vara"), ("[ANC_PROCESSO_JUDICIAL]", "processo judicial"), ("Vara 12  da Capital", "vara ## da capital"), ("Perito", "perito"), ("ANC x", "anc x"), (None, "")])
cases("record_issue_lists", lambda c: F.array_join(documents.record_issues(F.from_json(c, "map<string,string>"), r"\b(banco|tribunal)\b"), ","), [
    ('{"CPF_PERITO":"123"}', "CPF_PERITO:cpf_invalid"), ('{"CPF_PERITO":"529.982.247-25","PERITO":"Banco X"}', "PERITO:institutional_in_name"), ('{"PROMOVENTE":"TRIBUNAL","PROMOVIDO":"Ana"}', "PROMOVENTE:institutional_in_party"), ("{}", ""),
])


@query(f"""
    WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber AS p FROM {LINES} WHERE l_shipmode IN ('AIR', 'FOB')), n AS (SELECT *, lead(p) OVER (PARTITION BY l_orderkey ORDER BY p) = p + 1 AS x FROM h)
    SELECT l_orderkey, count(*) AS hits, array_to_string(list(p ORDER BY p), ',') AS pages, coalesce(min(p) FILTER (x), min(p))::INTEGER AS first, coalesce(min(p) FILTER (x) + 1, min(p))::INTEGER AS last FROM n GROUP BY 1""")
def found_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.find_pages(_lines(spark, sf_dir), "l_orderkey", "l_linenumber", "l_shipmode", "^(AIR|FOB)$")
    return found.select("l_orderkey", "hits", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


@query(f"SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_shipmode WHEN 'AIR' THEN 2 ELSE 1 END DESC, l_quantity DESC, l_linenumber) AS n FROM {LINES} WHERE l_shipmode <> 'RAIL') WHERE n = 1")
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("l_shipmode") == "AIR", 2).when(F.col("l_shipmode") == "RAIL", 0).otherwise(1)
    return documents.select_page(_lines(spark, sf_dir), "l_orderkey", "l_linenumber", score, "l_quantity").select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_shipmode, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_shipmode ORDER BY l_quantity DESC, l_linenumber) AS n FROM {LINES} WHERE l_shipmode <> 'RAIL') WHERE n = 1")
def best_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("l_shipmode", F.when(F.col("l_shipmode") == "RAIL", "UNKNOWN").otherwise(F.col("l_shipmode")))
    return documents.best_per_kind(lines, "l_orderkey", "l_shipmode", "l_quantity", "l_linenumber").select("l_orderkey", "l_shipmode", "l_linenumber")


_OPS = "BT|,Tm|10,Tj|,Td|0,Tj|,Td|-5,Tj|,T*|,Tm|20,Td|1,Tm|40,ET|"


@query("SELECT v.ord, v.block, (SELECT count(*) FROM customer) AS n FROM (VALUES (0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 3), (8, 3), (9, 3), (10, 4), (11, 5)) v(ord, block)")
def position_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = case_rows(spark, sf_dir, [_OPS]).select("c_custkey", F.posexplode(F.split("x", ",")).alias("ord", "o")).select("c_custkey", "ord", F.substring_index("o", "|", 1).alias("op"), F.substring_index("o", "|", -1).try_cast("double").alias("y"))
    return ordered.blocks_by_position(ordered.operators_only(ops, "op", ["BT", "ET", "Tm", "Td", "Tj", "T*"]), "c_custkey", "ord", "op", "y", 2.0).groupBy("ord", "block").agg(F.count("*").alias("n"))


@query(f"""
    WITH s AS (SELECT l_orderkey, l_partkey AS x0, l_partkey + l_quantity AS x1, chr(65 + l_linenumber::INTEGER) AS t FROM {LINES} QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey) = 1),
    g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY l_orderkey ORDER BY x0) AS gap FROM s),
    c AS (SELECT l_orderkey, greatest(list_extract(list_sort(list(gap)), (floor(0.9 * (count(*) - 1)) + 1)::INTEGER), 0) AS cut FROM g WHERE gap IS NOT NULL GROUP BY 1)
    SELECT l_orderkey, string_agg(CASE WHEN gap > cut THEN ' ' ELSE '' END || t, '' ORDER BY x0) AS text FROM g LEFT JOIN c USING (l_orderkey) GROUP BY 1""")
def quantile_spaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    pieces = _lines(spark, sf_dir).withColumn("k", F.count("*").over(W.partitionBy("l_orderkey", "l_partkey"))).where("k = 1")
    pieces = pieces.select("l_orderkey", F.col("l_partkey").alias("x0"), (F.col("l_partkey") + F.col("l_quantity")).alias("x1"), F.char(65 + F.col("l_linenumber")).alias("t"))
    return ordered.spaced_by_quantile(pieces, ["l_orderkey"], "x0", "x1", "t")
