"""Helpers shared by the operators: intermediate tables, numbering, input clean-up."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Java form of the word rule: runs of anything but space and \x09-\x0D
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared checkpoint folder and read it back: cuts
    the lineage, survives lost executors, and fixes what later jobs see."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shared:
    """A broadcast object, shipped like the functions that use it: its class travels by
    value, so workers need no copy of this package. Unpickled once per task."""

    def __init__(self, spark: SparkSession, value):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.loaded = None

    @property
    def value(self):
        if self.loaded is None:
            self.loaded = cloudpickle.loads(self.data.value)
        return self.loaded


def lean(function):
    """A ``mapInArrow`` function that gives memory back when its partition ends. Spark keeps
    Python workers between stages, and what they have freed stays theirs unless trimmed, so
    idle workers would take room beside the executor's heap."""
    def run(batches):
        yield from function(batches)
        trim()
    return run


def trim() -> None:
    """Return freed memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # another C library
        pass


def fold(column) -> F.Column:
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, LOWER)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add ``name``: the 1-based position in the global order, without a window over all
    rows. Rows are range-partitioned and written once, then numbered inside each
    partition, plus the row counts of the partitions before (one row per partition)."""
    parts = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return (local.join(before, "_part")
            .withColumn(name, (F.col("_local") + F.col("_before")).cast("long"))
            .drop("_part", "_local", "_before"))
