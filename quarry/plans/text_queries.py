"""Queries over text functions and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as t
from quarry.functions import values as v
from quarry.operators import align, extract, similarity
from quarry.plans.registry import query
from quarry.storage import table

TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_COUNTED = extract.GENERAL


@query(
    "SELECT source, label, count(*) FILTER (n > 0) AS documents, sum(n)::BIGINT AS hits FROM ("
    + " UNION ALL ".join(f"SELECT source, '{k}' AS label, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for k, p in _COUNTED.items())
    + ") GROUP BY ALL"
)
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = F.array(*(F.struct(F.lit(k).alias("label"), F.when(F.contains(F.col("text"), F.lit(extract.NEEDS.get(k, ""))), F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).when(F.col("text").isNotNull(), 0).alias("n")) for k, p in _COUNTED.items()))
    rows = docs.select("source", F.explode(counts).alias("c"))
    return rows.groupBy("source", F.col("c.label").alias("label")).agg(F.count_if(F.col("c.n") > 0).alias("documents"), F.sum("c.n").alias("hits"))


@query()
def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(extract.entities(F.col("text"))).alias("e")).select("doc_id", "e.label", "e.start", "e.end", "e.text")


@query(rf"""
    WITH w AS (SELECT x, count(*) AS k FROM (SELECT unnest({TOKENS}) AS x FROM documents) GROUP BY 1),
    r AS (SELECT *, ends_with(x, ':') AS colon, CASE WHEN ends_with(x, ':') AND length(x) > 1 THEN left(x, -1) ELSE x END AS raw FROM w),
    c AS (SELECT *, regexp_replace(raw, '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g') AS core FROM r),
    d AS (SELECT *, CASE WHEN length(core) = 1 THEN '1' ELSE '2' END AS size, length(regexp_replace(core, '[^\p{{Nd}}]', '', 'g')) AS n,
        regexp_matches(core, '\p{{L}}') AS letter, regexp_matches(core, '\p{{Nd}}') AS digit, regexp_matches(core, '\p{{Lu}}') AS up, regexp_matches(core, '\p{{Ll}}') AS low,
        lower(raw) IN ('nº', 'n°', 'n.') AS sign, regexp_extract(raw, '^(\d{{1,2}})[/-]', 1) AS dd, regexp_extract(raw, '^\d{{1,2}}[/-](\d{{1,2}})[/-]', 1) AS mm,
        regexp_extract(raw, '^(?:\d{{1,2}}/\d{{1,2}}/|\d{{1,2}}-\d{{1,2}}-)(\d{{4}}|\d{{2}})$', 1) AS yy FROM c),
    e AS (SELECT *, coalesce(try_cast(CASE WHEN yy <> '' THEN (CASE WHEN length(yy) = 4 THEN '' WHEN yy <= '49' THEN '20' ELSE '19' END) || yy || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0')
        WHEN regexp_matches(raw, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN raw END AS DATE) IS NOT NULL, false) AS dated FROM d)
    SELECT CASE WHEN contains(raw, '@') AND contains(raw, '.') THEN 'E' WHEN lower(raw) LIKE 'r$%' THEN 'V' WHEN core = '' AND NOT sign THEN 'S' ELSE
        CASE WHEN sign THEN 'R2' WHEN regexp_matches(core, '^\p{{Nd}}+[ªaA]$') THEN 'N' || size || 'a' WHEN regexp_matches(core, '^\p{{Nd}}+[ºoO]$') THEN 'N' || size || 'o'
        WHEN n = 11 THEN 'F' || size WHEN n = 14 THEN 'J' || size WHEN n IN (16, 20) THEN 'Q' || size
        WHEN contains(raw, ',') AND regexp_matches(raw, '[0-9]') THEN 'V' || size WHEN dated THEN 'A' || size
        WHEN lower(core) IN ({", ".join(f"'{p}'" for p in t.PARTICLES)}) THEN 'P' || size WHEN digit AND NOT letter THEN 'N' || size
        WHEN letter AND NOT digit THEN (CASE WHEN up AND NOT low THEN 'U' WHEN low AND NOT up THEN 'L' WHEN regexp_matches(core, '^[^\p{{L}}]*\p{{Lu}}[^\p{{Lu}}]*$') THEN 'T' ELSE 'M' END) || size
        WHEN letter THEN 'M' || size ELSE 'S' || size END || CASE WHEN colon THEN ':' ELSE '' END END AS code, sum(k)::BIGINT AS n FROM e GROUP BY 1""")
def typed_token_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(t.tokens(F.col("text"))).alias("x")).groupBy("x").agg(F.count("*").alias("k"))
    return words.groupBy(t.token_type(F.col("x")).alias("code")).agg(F.sum("k").alias("n"))


@query(rf"""
    SELECT conv_id, turn, longest, count(*) OVER (PARTITION BY conv_id, pattern) <= 1 AS rare FROM (
        SELECT conv_id, turn, array_to_string(list_transform({TOKENS}, lambda x: CASE WHEN x = ':' THEN ':' WHEN length(x) = 1 THEN '1' ELSE 'W' END), '') AS pattern,
               coalesce(list_max(list_transform({TOKENS}, lambda x: length(x))), 0) AS longest FROM conversations)""")
def block_pattern_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.block_pattern(F.col("text")).alias("pattern"), t.longest_token(F.col("text")).cast("long").alias("longest"))
    return rows.select("conv_id", "turn", "longest", (F.count("*").over(W.partitionBy("conv_id", "pattern")) <= 1).alias("rare"))


@query(rf"SELECT doc_id, round(CASE WHEN len({TOKENS}) > 0 THEN len(list_filter({TOKENS}, lambda x: regexp_matches(x, '^[\p{{L}}\p{{N}}]$'))) / len({TOKENS}) ELSE 0 END, 6) AS ratio FROM documents")
def word_spacing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(t.odd_spacing_ratio(F.col("text")), 6).alias("ratio"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.text_digest(F.col("text")).alias("digest"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS anchor FROM documents")
def anchor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.anchor_text(F.col("text"))).alias("anchor"))


@query(r"SELECT md5(trim(regexp_replace(regexp_replace(lower(text), '[0-9]', '#', 'g'), '\s+', ' ', 'g'))) AS shape, count(*) AS n FROM documents GROUP BY 1")
def similarity_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5(t.normalize_for_similarity(F.col("text"))).alias("shape")).agg(F.count("*").alias("n"))


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT doc_id, md5(array_to_string(({_LINES})[1:6], '|')) AS top, md5(array_to_string(({_LINES})[greatest(1, len({_LINES}) - 9):], '|')) AS bottom FROM documents")
def top_bottom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(t.top_lines(text, 6), "|")).alias("top"), F.md5(F.array_join(t.bottom_lines(text, 10), "|")).alias("bottom"))


@query("SELECT doc_id, len(string_split(text, 'the')) - 1 AS n, regexp_replace(text, '[^0-9]', '', 'g') AS digits, length(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS dense FROM documents")
def counts_and_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.count_of(text, "the").cast("long").alias("n"), t.digits(text).alias("digits"), F.length(t.compact(text)).cast("long").alias("dense"))


@query("SELECT o_orderpriority, count(*) AS n, sum(CAST(round(o_totalprice, 2) AS DECIMAL(18,2)))::DOUBLE AS total, 0::BIGINT AS wrong FROM orders GROUP BY 1")
def money_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round("o_totalprice", 2).cast(v.MONEY)
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", price.alias("price"), v.parse_money(v.format_money(price)).alias("parsed"))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("parsed").cast("double").alias("total"), F.count_if(~F.col("price").eqNullSafe(F.col("parsed"))).alias("wrong"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate BETWEEN DATE '1994-06-01' AND DATE '1999-06-02' AS recent FROM orders")
def date_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = F.array(*map(F.lit, v.MONTHS))
    day = F.col("o_orderdate").cast("date")
    spelt = F.concat_ws(" de ", F.dayofmonth(day).cast("string"), F.get(months, F.month(day) - 1), F.year(day).cast("string"))
    forms = [F.date_format(day, f) for f in ("dd/MM/yyyy", "d-M-yyyy", "yyyy-MM-dd")] + [spelt]
    shown = F.get(F.array(*forms), (F.col("o_orderkey") % 4).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", v.parse_date(shown).alias("day"))
    return rows.select("o_orderkey", F.col("day").cast("string").alias("day"), v.is_recent(F.col("day"), F.lit("1999-06-01").cast("date")).alias("recent"))


@query("SELECT kind, count(*) AS n, count(*) FILTER (ok) AS ok FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'cpf' WHEN 1 THEN 'money' ELSE 'date' END AS kind, c_custkey % 5 <> 0 AS ok FROM customer) GROUP BY 1")
def id_format_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lpad(F.col("c_custkey").cast("string"), 11, "0")
    cpf = F.concat(F.substring(key, 1, 3), F.lit("."), F.substring(key, 4, 3), F.lit("."), F.substring(key, 7, 3), F.lit("-"), F.substring(key, 10, 2))
    kind = F.when(F.col("c_custkey") % 3 == 0, "cpf").when(F.col("c_custkey") % 3 == 1, "money").otherwise("date")
    good = F.when(kind == "cpf", cpf).when(kind == "money", v.format_money(F.col("c_custkey"))).otherwise(F.lit("01/02/2024"))
    rows = table(spark, sf_dir, "customer").select(kind.alias("kind"), F.when(F.col("c_custkey") % 5 == 0, F.concat(good, F.lit("x"))).otherwise(good).alias("value"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(v.has_shape(F.col("kind"), F.col("value"))).alias("ok"))


@query("""
    WITH m AS (SELECT p_partkey, p_retailprice AS x, (p_size % 20 + 1) * 5.0 AS pct, p_size % 5 + 1 AS n FROM part), u AS (
        SELECT 'raw' AS derivation, round(x, 2) AS y FROM m UNION ALL SELECT 'percent', round(x * 100 / pct, 2) FROM m
        UNION ALL SELECT 'percent_parts', round(x * 100 / pct * n, 2) FROM m UNION ALL SELECT 'times', round(x * n, 2) FROM m
        UNION ALL SELECT 'over_' || k, round(x / k, 2) FROM m, range(2, 21) r(k))
    SELECT derivation, count(*) AS n, round(sum(y) / 7, 0) AS total FROM u GROUP BY 1""")
def value_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = v.value_candidates(F.col("p_retailprice"), (F.col("p_size") % 20 + 1) * 5.0, F.col("p_size") % 5 + 1)
    rows = table(spark, sf_dir, "part").select(F.explode(made).alias("c"))
    return rows.groupBy(F.col("c.derivation").alias("derivation")).agg(F.count("*").alias("n"), F.round(F.sum("c.value") / 7, 0).alias("total"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k long")["k"]).alias("k"))


@query("""
    WITH t AS (SELECT item_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS text FROM benchmark)
    SELECT a.item_id, round(0.7 * (1 - levenshtein(a.text, b.text) / m) + 0.3 * (1 - abs(length(a.text) - length(b.text)) / m), 6) AS edit,
           round(least(length(a.text), length(b.text)) / m, 6) AS ratio
    FROM t a JOIN t b ON b.item_id = a.item_id + 1, LATERAL (SELECT greatest(length(a.text), length(b.text))::DOUBLE AS m)""")
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark").select("item_id", t.anchor_text(F.col("text")).alias("text"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", F.round(similarity.edit_similarity(F.col("text"), F.col("other")), 6).alias("edit"), F.round(similarity.length_ratio(F.col("text"), F.col("other")), 6).alias("ratio"))


@query(rf"""
    WITH c AS (SELECT item_id, x AS term, count(*) AS tf FROM (SELECT item_id, unnest({TOKENS.replace('text', 'lower(text)', 1)}) AS x FROM benchmark) GROUP BY ALL),
    w AS (SELECT c.item_id, c.term, tf / max(tf) OVER (PARTITION BY c.item_id) * (ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) OVER (PARTITION BY c.term) + 1)) + 1) AS w FROM c),
    n AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM w)
    SELECT a.item_id AS a, b.item_id AS b, round(sum(a.w * b.w), 6) AS cosine FROM n a JOIN n b ON a.term = b.term AND a.item_id < b.item_id GROUP BY 1, 2""")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = similarity.term_weights(table(spark, sf_dir, "benchmark"), "item_id", t.tokens(F.lower("text")))
    pairs = similarity.cosine_pairs(weights.withColumnRenamed("item_id", "a"), "a", weights.withColumnRenamed("item_id", "b"), "b")
    return pairs.where("a < b").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(rf"""
    WITH x AS (SELECT doc_id, md5(x) AS m FROM (SELECT doc_id, unnest({TOKENS}) AS x FROM documents)),
    h AS (SELECT doc_id, ('0x' || m[15:16] || m[13:14] || m[11:12] || m[9:10] || m[7:8] || m[5:6] || m[3:4] || m[1:2])::UBIGINT AS h FROM x),
    b AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, range(0, 64) r(i) GROUP BY ALL)
    SELECT doc_id, lpad(lower(to_hex(sum(CASE WHEN v >= 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0 END)::UBIGINT)), 16, '0') AS simhash FROM b GROUP BY 1""")
def token_simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = similarity.token_simhash(table(spark, sf_dir, "documents"), "doc_id", t.tokens(F.col("text")))
    return hashed.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"))


@query()
def block_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each turn of a conversation against those of the next; ``turn`` is the earlier one's."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    later = turns.withColumn("turn", F.col("turn") - 1).where("turn >= 0")
    # A last turn has been the later one already; a conversation's only turn stands alone.
    earlier = turns.where("turn = 0").unionByName(turns.where("turn > 0").join(later, ["conv_id", "turn"], "left_semi"))
    sides = earlier.withColumn("side", F.lit("a")).unionByName(later.withColumn("side", F.lit("b")))
    lines = sides.select(F.concat_ws(" ", "turn", "conv_id").alias("pair"), "side", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    aligned, key = align.align_documents(lines, "pair", "side", "n", "line"), F.split("pair", " ", 2)
    kinds = dict(turns.dtypes)
    return aligned.select(key[1].cast(kinds["conv_id"]).alias("conv_id"), key[0].cast(kinds["turn"]).alias("turn"), *(c for c in aligned.columns if c != "pair"))


@query()
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return align.token_diff(a.join(b, "item_id"), "item_id", "text", "other").withColumnRenamed("key", "item_id")


@query(r"""
    SELECT doc_id, field, value FROM (
        SELECT doc_id, 'email' AS field, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS value FROM documents
        UNION ALL SELECT doc_id, 'licence', coalesce(nullif(regexp_extract(text, '(?i)licensed under the (\w+)', 1), ''), nullif(regexp_extract(text, '(?i)released under the (\w+)', 1), '')) FROM documents
        UNION ALL SELECT doc_id, 'long_number', regexp_extract(text, '\d{10,}') FROM documents) WHERE value <> ''""")
def rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"email": [(extract.MAIL, 0)], "licence": [(r"(?i)licensed under the (\w+)", 1), (r"(?i)released under the (\w+)", 1)], "long_number": [(r"\d{10,}", 0)]}
    return extract.extract_fields(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), rules)


@query(r"SELECT p_partkey, lower(p_name) LIKE 's%' AND length(p_name) >= 8 AS ruled, p_type ILIKE '%o%y' AS wild, lower(p_name) LIKE '%red widget%' OR replace(lower(p_name), ' ', '') LIKE '%redwidget%' AS loose FROM part")
def rule_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", extract.matches_rule(name, starts="S", least=8).alias("ruled"), t.wildcard(F.col("p_type"), "*o*y").alias("wild"), t.contains_loosely(name, "Red Widget").alias("loose"))
