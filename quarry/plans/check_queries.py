"""Queries over validation and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import align, validate
from quarry.plans.registry import query
from quarry.storage import table


@query("""
    SELECT l_orderkey, array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(list(DISTINCT l_returnflag), x)), ',') AS missing FROM lineitem GROUP BY 1""")
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("p"))
    return present.select("l_orderkey", F.array_join(validate.missing_fields(F.col("p"), ["A", "N", "R"]), ",").alias("missing"))


_MATRIX = [("A", "F"), ("N", "O"), ("R", "F"), ("R", "O")]


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE (l_returnflag, l_linestatus) IN ({', '.join(map(str, _MATRIX))}) GROUP BY 1, 2")
def allow_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus")
    return validate.allowed_fields(lines, "l_returnflag", "l_linestatus", _MATRIX).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""
    SELECT reason, count(*) AS n FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN 'LABEL_LEAK' WHEN 1 THEN 'NUMBER_IN_OTHER_FIELD' WHEN 2 THEN 'NAME_IN_OTHER_FIELD' WHEN 3 THEN 'BAD_FORMAT' END AS reason FROM customer) GROUP BY 1""")
def cross_field_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") % 5
    number = F.concat(F.lpad(F.col("c_custkey").cast("string"), 9, "8"), F.lit("-11"))
    value = F.when(key == 0, F.lit("Vara: first")).when(key == 1, F.concat(F.lit("no. "), F.regexp_replace(number, "-", "."))).when(key == 2, F.lit("paid to  JOSÉ  da Silva")).when(key == 3, F.lit("2024")).otherwise("01/02/2024")
    field = F.when(key.isin(3, 4), "date").otherwise("court")
    rows = table(spark, sf_dir, "customer").select(validate.cross_field_reason(value, field, F.lit("José da Silva"), number, ["Vara", "Comarca"]).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderstatus, reason, count(*) AS n FROM (SELECT o_orderstatus, CASE
        WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'MISSING_DATE' WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 AND o_custkey % 2 = 0 THEN 'MISSING_FEE_OR_VALUE'
        WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN 'MISSING_VALUE' END AS reason FROM orders) GROUP BY 1, 2""")
def document_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    fields = F.create_map(F.lit("date"), F.when(key % 3 == 0, "-").otherwise("d"), F.lit("fee"), F.when(key % 4 == 0, " ").otherwise("f"), F.lit("value"), F.when(cust % 2 != 0, "v"))
    needs = {"F": [["date"], ["fee", "value"]], "O": [["value"]]}
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", validate.document_reason(F.col("o_orderstatus"), fields, needs).alias("reason"))
    return rows.groupBy("o_orderstatus", "reason").agg(F.count("*").alias("n"))


@query("""
    SELECT user_id, CASE WHEN value / 100 >= 0.9 THEN 'header' WHEN value / 100 >= 0.75 THEN 'title' WHEN value / 100 <= 0.1 THEN 'footer' ELSE 'body' END AS band,
        sha256(string_agg(event_type, ' ' ORDER BY event_id)) AS sha256 FROM events GROUP BY 1, 2""")
def page_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("value") / 100).alias("y"))
    return validate.band_texts(words, ["user_id"], "y", ["event_id"], "event_type").drop("text")


@query("""
    SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.v <> '' THEN a.v ELSE coalesce(b.v, a.v) END AS v
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'front' ELSE '' END AS v FROM customer WHERE c_custkey % 5 <> 0) a
    FULL JOIN (SELECT c_custkey, 'back' AS v FROM customer WHERE c_custkey % 3 <> 0) b ON a.c_custkey = b.c_custkey""")
def band_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    front = customers.where(key % 5 != 0).withColumn("v", F.when(key % 2 == 0, "front").otherwise(""))
    return validate.merge_fields(front, customers.where(key % 3 != 0).withColumn("v", F.lit("back")), ["c_custkey"], "v")


@query()
def weighted_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, the chain of lines whose part and supplier numbers both rise, of greatest quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return align.chains(lines, "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
