"""Idempotent writes to tables of Parquet files, and JSON artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import insert_absent, upsert


def _files(df: DataFrame, path: str):
    """The file system of a path, and a function from a suffix to the path beside it."""
    spark = df.sparkSession
    at = lambda suffix="": spark._jvm.org.apache.hadoop.fs.Path(path + suffix)
    return at().getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(df: DataFrame, path: str) -> bool:
    """Whether there is a table, once a swap that was cut short is brought to its end."""
    system, at = _files(df, path)
    if system.exists(at()):
        return True
    # Without the table: the new one if it was written whole and the old one had been moved, else the old one.
    for suffix in (".next", ".old"):
        if system.exists(at(".old")) and (suffix == ".old" or system.exists(at(".next/_SUCCESS"))):
            return bool(system.rename(at(suffix), at()))
    return False


def _swap(df: DataFrame, path: str) -> None:
    """Writes beside the table, moves the old files away and the new ones in.

    A crash loses nothing: the old or the new files are whole, and the next write goes on from
    them. Between the two moves a reader finds no table; it never sees half of one.
    """
    system, at = _files(df, path)
    df.write.mode("overwrite").parquet(f"{path}.next")
    system.delete(at(".old"), True)
    if system.exists(at()) and not system.rename(at(), at(".old")):
        raise OSError(f"{path}: the old files could not be moved away")
    if not system.rename(at(".next"), at()):
        raise OSError(f"{path}: the new files could not take the old one's place")
    system.delete(at(".old"), True)


def merge_into(df: DataFrame, path: str, key: list[str], order: str) -> None:
    """Upserts by key; the latest row by ``order`` wins."""
    _swap(upsert(df.sparkSession.read.parquet(path), df, key, order) if _exists(df, path) else upsert(df.limit(0), df, key, order), path)


def append_absent(df: DataFrame, path: str, key: list[str]) -> None:
    """Adds rows whose key is not there yet."""
    new = df.dropDuplicates(key)
    _swap(insert_absent(df.sparkSession.read.parquet(path), new, key) if _exists(df, path) else new, path)


def replace_children(df: DataFrame, path: str, parent: str) -> None:
    """Replaces the rows of the parents that occur in ``df`` and leaves the others' partitions alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, NUL characters out."""
    clean = [F.regexp_replace(c, r"\x00", "").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(F.to_json(F.struct(*clean)).alias("value")).write.mode("overwrite").text(path)


def child_records(rows: DataFrame, keys: list[str], children: str, columns: list[str]) -> DataFrame:
    """One row a child of an array of structs: keys, place from 0, and the child's columns; parents without children give none."""
    return rows.select(*keys, F.posexplode(children).alias("ord", "_c")).select(*keys, "ord", *(F.col(f"_c.{c}").alias(c) for c in columns))


def replace_all_children(df: DataFrame, path: str, parent: str, parents: DataFrame) -> None:
    """Replaces the children of all ``parents``, also of those that have none any more, and leaves the others' alone."""
    kept = None
    if _exists(df, path):
        kept = df.sparkSession.read.parquet(path).join(parents.select(parent).distinct(), parent, "left_anti").select(*df.columns)
    _swap(df if kept is None else kept.unionByName(df), path)


def run_manifest(spark, steps: list[dict], path: str | None = None) -> DataFrame:
    """(step, name, status, rows, seconds, error) of a run's steps, in order; also written as JSON if there is a path."""
    rows = [(i, s["name"], s.get("status", "ok"), s.get("rows"), s.get("seconds"), s.get("error")) for i, s in enumerate(steps, 1)]
    out = spark.createDataFrame(rows, "step int, name string, status string, rows long, seconds double, error string")
    if path:
        out.coalesce(1).write.mode("overwrite").json(path)
    return out


def run_steps(spark, steps: list, first: int = 1, last: int | None = None, path: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Runs named steps (name, function of the frame before), from the first to the last asked for, and keeps a manifest.

    A step that fails ends the run; the manifest says where and why.
    """
    import time

    frame, told = None, []
    for number, (name, step) in enumerate(steps, 1):
        if number < first or number > (last or len(steps)):
            told.append({"name": name, "status": "skipped"})
            continue
        began = time.time()
        try:
            frame = step(frame)
            told.append({"name": name, "rows": None if frame is None else frame.count(), "seconds": round(time.time() - began, 3)})
        except Exception as e:
            told.append({"name": name, "status": "fail", "seconds": round(time.time() - began, 3), "error": str(e).split("\n")[0][:300]})
            break
    return frame, run_manifest(spark, told, path)


def write_rules(rules: dict, path: str) -> None:
    """A small rule file: YAML by its ending, else JSON."""
    import json

    with open(path, "w", encoding="utf-8") as out:
        if path.endswith((".yml", ".yaml")):
            import yaml

            yaml.safe_dump(rules, out, allow_unicode=True, sort_keys=False)
        else:
            json.dump(rules, out, ensure_ascii=False, indent=1)


def text_table(df: DataFrame, most: int = 50) -> str:
    """The first rows as an aligned text table; the cap is the display's own."""
    rows = [df.columns, *([("" if x is None else str(x)) for x in r] for r in df.limit(most).collect())]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in rows)
