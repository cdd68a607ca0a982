"""Readers of reference tables and rules, and a check of what can be read at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """First line as header, quotes doubled inside quotes, one record a line, all strings."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False, inferSchema=False)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole-file JSON under a given schema; unknown keys are left out, bad files give nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def rules_frame(spark: SparkSession, rules: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """Rules as rows (field, ord, pattern, group)."""
    rows = [(field, i, p, g) for field, found in rules.items() for i, (p, g) in enumerate(found)]
    return spark.createDataFrame(rows, "field string, ord int, pattern string, group int")


def read_files(spark: SparkSession, paths: list[str] | str, magic: bytes = b"") -> DataFrame:
    """(path, length, valid, content): files whose first bytes are ``magic`` are valid. Each path counts once."""
    df = spark.read.format("binaryFile").load(paths).select("path", "length", "content")
    valid = F.substring("content", 1, len(magic)) == F.lit(bytearray(magic)) if magic else F.lit(True)
    return df.withColumn("valid", valid).dropDuplicates(["path"])


def pick_inputs(files: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """The ``first`` to ``last`` of the paths in order, case ignored; counted from 1."""
    ordered = files.orderBy(F.lower(path), path)
    return ordered.offset(first - 1).limit(last - first + 1)


def flatten_bookmarks(docs: DataFrame, key: str, tree: str, depth: int) -> DataFrame:
    """(key, title, page, level) of a nested bookmark tree of a given depth: children is an array of the next level."""
    level = docs.select(key, F.explode_outer(tree).alias("n")).where("n is not null")
    out = level.select(key, F.col("n.title").alias("title"), F.col("n.page").alias("page"), F.lit(1).alias("level"))
    for i in range(2, depth + 1):
        level = level.select(key, F.explode("n.children").alias("n"))
        out = out.unionByName(level.select(key, F.col("n.title").alias("title"), F.col("n.page").alias("page"), F.lit(i).alias("level")))
    return out
