"""Scans and sinks: Parquet, ORC and headered CSV, all distributed.

Every sink writes from the executors (``df.write``); nothing is pulled through the
driver. CSV is read back with an explicit schema so keys keep their type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """Scan a table; filters and projections applied later reach the scan."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, table: str | None = None) -> None:
    """Write ``df`` as Parquet, ORC or headered CSV; optionally register it as an
    external table (``saveAsTable`` with an explicit path)."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {FORMATS}")
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if table:
        writer.option("path", path).saveAsTable(table)
    else:
        writer.save(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered CSV export, one file per partition, written by the executors."""
    write_table(df, path, "csv", mode)


def read_cohort_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV read as text and cast by column **name**: the order of columns in
    the file does not matter, further columns are dropped, and a missing one is an error.
    Text that does not fit its type becomes NULL; ``bad_cohort_rows`` counts those."""
    text = _cohort_text(spark, path, schema)
    return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def bad_cohort_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row: rows of the file, rows without an id, and for each column the values that
    do not fit its type (such a customer would vanish from an inner join unreported)."""
    text = _cohort_text(spark, path, schema)
    key = schema.fields[0].name
    bad = [F.count_if(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull()).alias(f"bad_{f.name}")
           for f in schema.fields]
    return text.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(F.col(f"`{key}`").try_cast(schema.fields[0].dataType).isNull()).alias("n_without_id"), *bad)


def _cohort_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(*[F.col(f"`{f.name}`") for f in schema.fields])
