"""Queries over joins, set operations and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import joins
from quarry.plans.registry import query
from quarry.storage import table


@query("""
    SELECT o_orderkey, n_name AS fee, round(abs(v - o_totalprice), 2) AS off FROM (
        SELECT o_orderkey, o_totalprice, n_name, v, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(v - o_totalprice), n_nationkey) AS r
        FROM orders, (SELECT n_nationkey, n_name, 1000.0 * (n_nationkey + 1) * (n_nationkey + 1) AS v FROM nation)
        WHERE abs(v - o_totalprice) <= o_totalprice * 0.15) WHERE r = 1
    UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE NOT EXISTS (
        SELECT 1 FROM nation WHERE abs(1000.0 * (n_nationkey + 1) * (n_nationkey + 1) - o_totalprice) <= o_totalprice * 0.15)""")
def nearest_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    fees = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("fee"), (1000.0 * (F.col("n_nationkey") + 1) * (F.col("n_nationkey") + 1)).alias("amount"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    near = joins.nearest_value(rows, "o_orderkey", "o_totalprice", fees, "amount", "ord", ["fee", "amount"])
    return near.select("o_orderkey", "fee", F.round(F.abs(F.col("amount") - F.col("o_totalprice")), 2).alias("off"))


@query("""
    WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::VARCHAR END AS id, CASE WHEN c_custkey % 3 = 1 THEN 'NATION_' || c_nationkey END AS name, 'R' || c_nationkey % 7 AS region FROM customer),
    n AS (SELECT n_name AS value, n_nationkey::VARCHAR AS id, n_name AS name, 'R' || n_regionkey AS region FROM nation),
    g AS (SELECT region, min(value) AS value, count(DISTINCT value) AS k FROM n GROUP BY 1)
    SELECT c_custkey, coalesce(a.value, b.value, g.value) AS value,
        CASE WHEN a.value IS NOT NULL THEN 'id' WHEN b.value IS NOT NULL THEN 'name' WHEN g.value IS NOT NULL THEN 'region' END AS tier,
        CASE WHEN a.value IS NOT NULL THEN 0.9 WHEN b.value IS NOT NULL THEN 0.75 WHEN g.k > 1 THEN 0.55 WHEN g.k = 1 THEN 0.7 END::DOUBLE AS confidence
    FROM r LEFT JOIN n a ON r.id = a.id LEFT JOIN n b ON r.name = b.name LEFT JOIN g ON r.region = g.region""")
def tiered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    tiers = [
        ("id", F.when(key % 3 == 0, nation), F.col("n_nationkey").cast("string"), 0.9, None),
        ("name", F.when(key % 3 == 1, F.concat(F.lit("NATION_"), nation)), F.col("n_name"), 0.75, 0.6),
        ("region", F.concat(F.lit("R"), (F.col("c_nationkey") % 7).cast("string")), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), 0.7, 0.55),
    ]
    return joins.tiered_lookup(rows, "c_custkey", table(spark, sf_dir, "nation"), tiers, F.col("n_name")).drop("c_nationkey")


_KEYWORDS = [(1, "red", "colour"), (2, "ring", "shape"), (3, "small", "size"), (4, "widget", "kind"), (5, "e", "other")]


@query(f"""
    SELECT p_partkey, target, keyword FROM (SELECT p_partkey, target, keyword, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) AS r
    FROM part JOIN (VALUES {', '.join(map(str, _KEYWORDS))}) k(ord, keyword, target) ON contains(lower(p_name), keyword)) WHERE r = 1""")
def keyword_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = spark.createDataFrame(_KEYWORDS, "ord int, keyword string, target string")
    return joins.contains_match(table(spark, sf_dir, "part"), "p_partkey", F.lower("p_name"), keywords)


@query("SELECT n_nationkey, count(*) AS n, sum(l_partkey)::BIGINT AS keys FROM lineitem JOIN nation ON l_partkey BETWEEN n_nationkey * 40 AND n_nationkey * 40 + 60 AND l_suppkey % 5 = n_regionkey GROUP BY 1")
def range_join_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("g"), "l_partkey")
    ranges = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), "n_nationkey", (F.col("n_nationkey") * 40).alias("first"), (F.col("n_nationkey") * 40 + 60).alias("last"))
    met = joins.in_ranges(points, "l_partkey", ranges, "first", "last", ["g"], 64)
    return met.groupBy("n_nationkey").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("keys"))


@query("SELECT g, page FROM (SELECT DISTINCT o_custkey % 5 AS g, o_orderkey AS page FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = g AND page BETWEEN n_nationkey * 100 AND n_nationkey * 100 + 450)")
def uncovered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("g"), F.col("o_orderkey").alias("page")).distinct()
    ranges = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), (F.col("n_nationkey") * 100).alias("first"), (F.col("n_nationkey") * 100 + 450).alias("last"))
    return joins.outside_ranges(pages, "page", ranges, "first", "last", ["g"], 500)


@query("""
    SELECT g, id, block, overlap FROM (
        SELECT c_custkey % 5 AS g, c_custkey AS id, n_nationkey AS block, least(c_custkey + 25, n_nationkey * 50 + 70) - greatest(c_custkey, n_nationkey * 50) + 1 AS overlap,
            row_number() OVER (PARTITION BY c_custkey ORDER BY least(c_custkey + 25, n_nationkey * 50 + 70) - greatest(c_custkey, n_nationkey * 50) DESC, n_nationkey) AS r
        FROM customer JOIN nation ON n_regionkey = c_custkey % 5 AND c_custkey <= n_nationkey * 50 + 70 AND c_custkey + 25 >= n_nationkey * 50) WHERE r = 1""")
def best_overlap_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).alias("g"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("a"), (F.col("c_custkey") + 25).alias("z"))
    blocks = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("block"), (F.col("n_nationkey") * 50).alias("first"), (F.col("n_nationkey") * 50 + 70).alias("last"))
    return joins.best_overlap(rows, "id", "a", "z", blocks, "first", "last", "block", ["g"], 64)


@query("""
    WITH s AS (SELECT l_partkey, l_suppkey, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS b FROM s)
    SELECT l_partkey, l_suppkey, q FROM r WHERE a = 1 AND b = 1""")
def mutual_best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    return joins.mutual_best(sums, "l_partkey", "l_suppkey", "q")


@query("""
    SELECT c_mktsegment, l_returnflag, count(*) AS n, sum(l_quantity)::BIGINT AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1, 2""")
def child_table_join3(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return met.groupBy("c_mktsegment", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


def _updates(orders: DataFrame) -> DataFrame:
    changed = orders.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("X")).withColumn("o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
    late = orders.where("o_orderkey % 7 = 1").withColumn("o_orderstatus", F.lit("Y")).withColumn("o_orderdate", F.col("o_orderdate") - F.expr("INTERVAL 1 DAY"))
    fresh = orders.where("o_orderkey % 7 = 2").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return changed.unionByName(late).unionByName(fresh)


@query("""
    SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderkey, strftime(o_orderdate + CASE WHEN o_orderkey % 7 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END, '%Y-%m-%d') AS day FROM orders
    UNION ALL SELECT o_orderstatus, -o_orderkey - 1, strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderkey % 7 = 2""")
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    merged = joins.upsert(orders, _updates(orders), ["o_orderkey"], "o_orderdate")
    return merged.select("o_orderstatus", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT -o_orderkey - 1, o_orderstatus FROM orders WHERE o_orderkey % 7 = 2")
def insert_absent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return joins.insert_absent(orders, _updates(orders), ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("""
    SELECT c_custkey, 'segment' AS field, 'changed' AS change, c_mktsegment AS old, 'NEW' AS new FROM customer WHERE c_custkey % 10 = 3 AND c_mktsegment <> 'NEW'
    UNION ALL SELECT c_custkey, 'nation', 'removed', c_nationkey::VARCHAR, NULL FROM customer WHERE c_custkey % 10 = 4
    UNION ALL SELECT c_custkey, 'note', 'added', NULL, 'n' FROM customer WHERE c_custkey % 10 = 5""")
def before_after_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, kind = table(spark, sf_dir, "customer"), F.col("c_custkey") % 10
    field = lambda name, value: F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"))
    before = customers.select("c_custkey", F.explode(F.array(field("segment", F.col("c_mktsegment")), field("nation", F.col("c_nationkey")))).alias("f")).select("c_custkey", "f.*")
    after = before.where(~((kind == 4) & (F.col("field") == "nation"))).withColumn("value", F.when((kind == 3) & (F.col("field") == "segment"), "NEW").otherwise(F.col("value")))
    after = after.unionByName(customers.where(kind == 5).select("c_custkey", F.lit("note").alias("field"), F.lit("n").alias("value")))
    return joins.changed_fields(before, after, ["c_custkey"], "field", "value")


@query("""
    WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM conversations)
    SELECT conv_id, pos::INTEGER AS pos, CASE WHEN min(line) = max(line) AND count(DISTINCT turn) = (SELECT count(DISTINCT turn) FROM conversations c WHERE c.conv_id = l.conv_id) THEN 'fixed' ELSE 'variable' END AS kind
    FROM l GROUP BY 1, 2""")
def fixed_variable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return joins.positional_compare(lines, "conv_id", "pos", "line", "turn")


@query("""
    SELECT 'both' AS kind, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'orders', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'customers', count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)""")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.join(b, "k", "left_anti").distinct(), "orders")).unionByName(count(b.join(a, "k", "left_anti").distinct(), "customers"))
