"""Tables in, intermediate tables out, and joins that survive hot keys.

Intermediates are written to the shared folder named by ``spark.checkpoint.dir``
as Parquet: that cuts lineage, survives the loss of any executor, and keeps
exchanges on either side splittable by adaptive execution.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint directory.

    Only a local[...] master without one gets a temporary folder; elsewhere a
    machine's own folder would lose files, so a missing setting is an error.
    """
    context = spark.sparkContext
    if found := context.getCheckpointDir():
        return found
    if named := context.getConf().get("spark.checkpoint.dir"):
        context.setCheckpointDir(named)
    elif context.master.startswith("local") and "cluster" not in context.master:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return context.getCheckpointDir()


#: With it, the shuffle files of a write go when it ends, and not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet intermediates of one operator call; ``drop`` frees one early."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}", {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns a DataFrame that reads it back."""
        path = f"{self.root}/{name}"
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes intermediates that nothing unfinished reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group, without gathering a hot group in one task.

    ``groups`` has one row per ``key`` and must be read from a table (``Scratch.keep``): then
    both sides are shuffled for this join alone, and adaptive execution cuts the partition of
    a hot key into slices and sends the one group row to each.
    """
    return rows.join(groups, key, how)


#: Words of 64 bits in a key filter: a fixed 1 MB, whatever the number of keys.
FILTER_WORDS = 1 << 17


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """One row with a bit set of fixed size (``bits`` array<long>) over the hashes of a column.

    See ``may_be_in``: it never misses a key, so a join behind it stays whole; with very
    many keys it just lets more rows through.
    """
    place = F.pmod(F.xxhash64(column), F.lit(FILTER_WORDS * 64))
    words = keys.select((place / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("b"))
    # The grid makes the set dense. It holds FILTER_WORDS rows, as the one array does.
    grid = keys.sparkSession.range(FILTER_WORDS).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    dense = words.unionByName(grid).groupBy("w").agg(F.bit_or("b").alias("b"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))


def may_be_in(filter_row: DataFrame, column: Column) -> Column:
    """False only where the column's value is certainly not among the filter's keys."""
    place = F.pmod(F.xxhash64(column), F.lit(FILTER_WORDS * 64))
    word = F.get(filter_row.scalar(), (place / 64).cast("int"))
    return F.call_function("shiftrightunsigned", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def without(rows: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """``rows`` whose key is not among ``gone``; only rows that may be are shuffled. Null matches null."""
    may = may_be_in(key_filter(gone, gone_key), rows[key])
    listed = gone.select(F.col(gone_key).alias("_gone")).distinct()
    checked = rows.where(may).join(listed, rows[key].eqNullSafe(F.col("_gone")), "left_anti")
    return rows.where(~may).unionByName(checked)
