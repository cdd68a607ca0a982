"""Tables of processed files: over JDBC or as Parquet, with the scans, point reads and rebuilt analyses that reports need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, url: str, name: str, properties: dict[str, str] | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table by JDBC; filters and columns are pushed to it. ``split`` (column, low, high, parts) reads it in parts."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**(properties or {}))
    if split:
        column, low, high, parts = split
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def list_rows(rows: DataFrame, order: list, source: str, like: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in order, of sources that hold a word (case ignored), from an offset on; the limit is the listing's own."""
    if like is not None:
        escaped = like.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        rows = rows.where(F.col(source).ilike(f"%{escaped}%"))
    rows = rows.orderBy(*order).offset(offset)
    return rows if limit is None else rows.limit(limit)


def one_row(rows: DataFrame, **keys) -> DataFrame:
    """The row with the given keys: one, or none."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.limit(1)


def child_rows(children: DataFrame, parents: DataFrame, on: list[str], columns: list[str], order: list[str] | None = None) -> DataFrame:
    """Children with some columns of their parents; those without a parent go."""
    joined = children.join(parents.select(*on, *columns), on)
    return joined.orderBy(*order) if order else joined


def expand_inputs(files: DataFrame, path: str, asked: list[str], models: dict[str, list[str]] | None = None) -> DataFrame:
    """(ord, path) of inputs by path, by index or by a model's alias, each once, in the order they are asked for.

    ":K3" and ":K3-5" are the files at these places in order, case ignored; "@M-NAME" are a
    model's paths; other inputs are paths themselves, and "a,b" are both.
    """
    import re

    ordered = files.select(path).distinct()
    listed = ordered.select(path, (F.row_number().over(_by_path(path))).alias("k"))
    out = None
    for n, text in enumerate(x.strip() for item in asked for x in item.split(",") if x.strip()):
        if found := re.fullmatch(r":K(\d+)(?:-(\d+))?", text, re.I):
            part = listed.where(F.col("k").between(int(found[1]), int(found[2] or found[1]))).select(F.lit(n).alias("n"), "k", path)
        else:
            names = (models or {}).get(text[3:].upper(), []) if text.upper().startswith("@M-") else [text]
            rows = [(n, i, name) for i, name in enumerate(names)]
            part = files.sparkSession.createDataFrame(rows, f"n int, k int, {path} string")
        out = part if out is None else out.unionByName(part)
    first = out.withColumn("key", canonical(F.col(path))).groupBy("key").agg(F.min(F.struct("n", "k", path)).alias("m"))
    return first.select("m.n", "m.k", f"m.{path}")


def _by_path(path: str):
    from pyspark.sql import Window as W

    return W.orderBy(F.lower(path), path)  # a list of input files, one place for each


def canonical(path):
    """What two names of one file have in common: slashes of one kind, no ./ and no doubled ones, case ignored."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"/(\./)+", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"/+", "/"), r"^\./", "")
    return F.lower(F.regexp_replace(p, r"[^/]+/\.\./", ""))


def preflight(files: DataFrame, path: str, content: str, magic: bytes) -> DataFrame:
    """files with ``problem``: empty, no_header (the first bytes are others), or null if a file can be read on."""
    head = F.substring(F.col(content), 1, len(magic))
    problem = F.when(F.coalesce(F.length(F.col(content)), F.lit(0)) == 0, "empty").when(head != F.lit(bytearray(magic)), "no_header")
    return files.withColumn("problem", problem)


def from_raw(rows: DataFrame, key: str, raw: str, schema: str | T.StructType) -> DataFrame:
    """(key, valid, analysis columns) of raw JSON; a text that is no object of the schema is not valid and gives nulls."""
    told = rows.select(key, F.from_json(F.col(raw), schema).alias("a"), F.get_json_object(F.col(raw), "$").isNotNull().alias("valid"))
    return told.select(key, "valid", "a.*")


#: Schemas of JSON artefacts.
SPANS = "struct<text:string,spans:array<struct<label:string,start:int,end:int,text:string>>>"
ALIASES = "array<struct<target_id:string,keywords:array<string>>>"
FIELDS = "map<string,struct<value:string,value_raw:string,confidence:double,source:string>>"
RANGES = "struct<front_a:struct<value_full:string,start_op:int,end_op:int>,front_b:struct<value_full:string,start_op:int,end_op:int>,back_a:struct<value_full:string,start_op:int,end_op:int>,back_b:struct<value_full:string,start_op:int,end_op:int>>"


def alias_rows(rows: DataFrame, raw: str) -> DataFrame:
    """(ord, target_id, keyword) of alias lists, in their order."""
    lists = rows.select(F.posexplode(F.from_json(raw, ALIASES)).alias("i", "a")).select("i", "a.target_id", F.posexplode("a.keywords").alias("j", "keyword"))
    return lists.select((F.col("i") * 1000 + F.col("j")).alias("ord"), "target_id", "keyword")


def field_rows(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, field, value, confidence, source) of mapped fields in JSON."""
    fields = rows.select(key, F.explode(F.from_json(raw, FIELDS)).alias("field", "f"))
    return fields.select(key, "field", F.coalesce("f.value", "f.value_raw").alias("value"), "f.confidence", "f.source")
