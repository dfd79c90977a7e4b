"""Shared plumbing: scratch tables, Arrow batch limits, text columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python stay below both limits, so that a batch of very long texts fits a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def limit_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of the Python stages planned from now on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none, a folder of this machine, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables written to the shared folder and read back.

    A table cuts the lineage as a checkpoint does, is computed once, and outlives a lost executor. The folder goes with
    the session, as results may be read from it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that a lookup sends to all tasks, at most.
HOT_KEYS = 20_000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` with the columns of ``table``, in which each key stands once; nulls where it doesn't.

    ``weight`` is a column of the table: how many rows hold the key. A key that at least one in HOT_KEYS of the counted
    rows holds is joined in place, and there are HOT_KEYS of these at most, however large the table; their rows then
    go through the shuffled join of all other keys scattered over its tasks. Keys are never null.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) * HOT_KEYS >= total)
    values = [c for c in table.columns if c not in keys]
    near = hot.select(*keys, *(F.col(c).alias(f"_hot_{c}") for c in values), F.lit(True).alias("_hot"))
    rest = table.where(F.col(weight) * HOT_KEYS < total).withColumn("_scatter", F.lit(0).cast("long"))
    placed = rows.join(F.broadcast(near), keys, "left").withColumn("_scatter", F.when(F.col("_hot"), 1 + F.monotonically_increasing_id()).otherwise(F.lit(0)).cast("long"))
    joined = placed.join(rest, [*keys, "_scatter"], "left")
    return joined.select(*rows.columns, *(F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
