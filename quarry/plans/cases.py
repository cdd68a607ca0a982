"""Queries that hold a function against expected values: every customer asks one of the cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.storage import table


def case_rows(spark: SparkSession, sf_dir: str, inputs: list[str | None]) -> DataFrame:
    """(c_custkey, i, x) for every customer: case ``i`` is the key modulo the number of cases."""
    i = (F.col("c_custkey") % len(inputs)).cast("int")
    return table(spark, sf_dir, "customer").select("c_custkey", i.alias("i"), F.get(F.array(*(F.lit(x).cast("string") for x in inputs)), i).alias("x"))


def quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def case_sql(expected: list[str | None]) -> str:
    rows = ", ".join(f"({i}, {quoted(y)})" for i, y in enumerate(expected))
    return f"SELECT v.i, v.y, count(*) AS n FROM customer c JOIN (VALUES {rows}) v(i, y) ON c.c_custkey % {len(expected)} = v.i GROUP BY 1, 2"


def cases(name: str, function: Callable[[Column], Column], pairs: list[tuple[str | None, str | None]]) -> None:
    """Registers a query (i, y, n): what the function makes of each case, as text, and how many customers asked it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = case_rows(spark, sf_dir, [x for x, _ in pairs])
        return rows.select("i", function(F.col("x")).cast("string").alias("y")).groupBy("i", "y").agg(F.count("*").alias("n"))

    run.__name__ = name
    query(case_sql([y for _, y in pairs]))(run)
