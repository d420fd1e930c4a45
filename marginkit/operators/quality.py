"""Data-quality audits (A11-A14): one pass per table, never one action per metric.

The source prints a row count and a distinct-customer count after almost every
step, each an action that re-runs the whole lineage. Here one aggregation yields
all metrics of a table, and several tables can be profiled in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

STATISTICS = ("count", "mean", "stddev", "min", "p25", "p50", "p75", "max")
STAT_DIGITS = 6


def profile_flags(df: DataFrame, stages: dict[str, tuple[Column, Column]], rejected: Column | None = None,
                  of_customers: dict[str, tuple[str, DataFrame]] | None = None) -> DataFrame:
    """A12 for several stages of one flow in a single scan.

    ``stages`` maps a stage name to (membership condition, margin column); ``rejected``
    marks rows whose model year could not be read as a number. Rows
    are first reduced per customer (partial aggregation absorbs a hot customer),
    then summed: distinct customers are the customers with a non-zero count, so
    no ``countDistinct`` (and no row expansion per stage) is needed.

    ``of_customers`` maps a further stage to (an earlier stage, a table): the rows of that
    stage whose customer is in the table. Both sides are reduced to one row per customer
    before they are joined, so no customer is too hot for a join task.
    """
    per_customer = []
    bad = F.lit(False) if rejected is None else rejected
    for i, (cond, margin) in enumerate(stages.values()):
        per_customer += [F.count_if(cond).alias(f"r{i}"),
                         F.count_if(cond & margin.isNull()).alias(f"n{i}"),
                         F.count_if(cond & (margin == 0)).alias(f"z{i}"),
                         F.count_if(cond & bad).alias(f"b{i}")]
    pc = df.groupBy(S.CUSTOMER).agg(*per_customer)
    names = list(stages)
    for name, (of, customers) in (of_customers or {}).items():
        i, k = names.index(of), len(names)
        there = customers.select(S.CUSTOMER).distinct().withColumn("_there", F.lit(True))
        pc = pc.join(there, S.CUSTOMER, "left").select(
            *pc.columns, *[F.when(F.col("_there"), F.col(f"{x}{i}")).otherwise(F.lit(0)).alias(f"{x}{k}") for x in "rnzb"])
        names.append(name)
    known = F.col(S.CUSTOMER).isNotNull()
    totals = []
    for i in range(len(names)):
        totals += [F.sum(f"r{i}").alias(f"r{i}"), F.count_if(known & (F.col(f"r{i}") > 0)).alias(f"c{i}"),
                   F.sum(f"n{i}").alias(f"n{i}"), F.sum(f"z{i}").alias(f"z{i}"),
                   F.sum(f"b{i}").alias(f"b{i}")]
    wide = pc.agg(*totals)
    rows = [F.struct(F.lit(name).alias("stage"), F.coalesce(F.col(f"r{i}"), F.lit(0)).cast("long").alias("n_rows"),
                     F.col(f"c{i}").cast("long").alias("n_customers"),
                     F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("long").alias("n_null_margin"),
                     F.coalesce(F.col(f"z{i}"), F.lit(0)).cast("long").alias("n_zero_margin"),
                     F.coalesce(F.col(f"b{i}"), F.lit(0)).cast("long").alias("n_rejected_year"))
            for i, name in enumerate(names)]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) for each listed column, from one shuffle:
    the columns are unpivoted and counted together (partial aggregation)."""
    stack = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {stack}) as (column, value)")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def summary_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, stddev, min, quartiles and max per column, as (column, statistic,
    value) rows, like ``DataFrame.summary``. ``value`` is text: numbers are rounded to
    ``STAT_DIGITS`` and written with that many decimals. A text column has count, min and
    max (by code point) and NULL for the rest. Quartiles are ``percentile_approx`` (an
    element of the column). One aggregation for all columns."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    aggs = []
    for c in columns:
        if c in text:
            aggs += [F.count(c).alias(f"{c}__count"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
            continue
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__stddev"), F.min(x).alias(f"{c}__min"),
                 F.percentile_approx(x, [0.25, 0.5, 0.75]).alias(f"{c}__q"), F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    parts = []
    for c in columns:
        for stat in STATISTICS:
            if stat == "count":
                value = F.col(f"{c}__count").cast("string")
            elif c in text:
                value = F.col(f"{c}__{stat}") if stat in ("min", "max") else F.lit(None).cast("string")
            else:
                number = (F.col(f"{c}__q")[{"p25": 0, "p50": 1, "p75": 2}[stat]] if stat.startswith("p")
                          else F.col(f"{c}__{stat}"))
                value = F.round(number, STAT_DIGITS).cast(f"decimal(38,{STAT_DIGITS})").cast("string")
            parts.append(F.struct(F.lit(c).alias("column"), F.lit(stat).alias("statistic"), value.alias("value")))
    return wide.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
