"""Zero-margin imputation with group medians.

Plan: the medians are one ``percentile_approx`` aggregate per (model, year). It is
a partial (map-side) aggregate, so a model-year holding a third of all rows is
reduced to one sketch per map task before the shuffle. The median table is then
size-checked and broadcast. The extract is read twice: once by the job that fits and
stores the medians (it runs while the plan is being built), once by the rows: every
row with a known or zero margin probes the medians, zero rows take the median (or
vanish when their group has none), non-zero rows pass through. The source's "non-zero
rows UNION ALL (zero rows JOIN medians)" scans it three times. The big side is never
shuffled on the (possibly hot) model-year key. Whether a margin is zero is tested on
the stored value, before it is rounded to cents.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..session import scratch_path
from .clean import clean_ownership, nonzero_records, retail_only
from .joins import DEFAULT_BROADCAST_ROWS, join_checked

MEDIAN_KEYS = (S.MODEL, S.YEAR)


def group_median(df: DataFrame, keys=MEDIAN_KEYS, column: str = S.MARGIN,
                 accuracy: int = 10000) -> DataFrame:
    """A1: approximate median per group; the result is an element of the group
    (the lower median for an even count)."""
    return df.groupBy(*keys).agg(
        F.percentile_approx(column, 0.5, accuracy).alias(column))


CELL_BITS = 12      # a group's histogram has 4096 cells at most per factor of its value range


def group_median_exact(df: DataFrame, keys=MEDIAN_KEYS, column: str = S.MARGIN) -> DataFrame:
    """A1, exact at any size: the lower median of each group, as ``group_median`` gives it
    for groups of few values. Decimals up to 18 digits and whole numbers.

    Rows are first counted by (group, value), so copies collapse per task and no key holds a
    whole group. Then the cell that holds the middle row is found per group from a histogram of
    that table, and looked at ever closer: a round aggregates by (group, cell), and the
    next one keeps only the rows of the chosen cells. A group's running sum covers at most its
    cells, never its rows. Groups without a value have a NULL median; NULL keys are a group.
    """
    kind = df.schema[column].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if not whole and not (isinstance(kind, T.DecimalType) and kind.precision <= 18):
        raise TypeError(f"an exact median needs whole numbers or decimals up to 18 digits, not {kind.simpleString()}")
    scale = 0 if whole else kind.scale
    spark, names = df.sparkSession, [f"_g{i}" for i in range(len(keys))]

    def stored(table: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        table.write.parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    value = F.col(column) if whole else F.col(column) * F.lit(10 ** scale)
    counts = (df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], value.cast("long").alias("_v"))
              .groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_n")))
    counts = stored(counts, "median-counts")
    known = F.col("_v").isNotNull()
    groups = stored(counts.groupBy(*names).agg(F.coalesce(F.sum(F.when(known, F.col("_n"))), F.lit(0)).alias("_total")), "median-groups")
    far = counts.agg(F.max(F.greatest(F.col("_v"), -(F.col("_v") + 1))).alias("far")).first()["far"]
    left, shift = counts.where(known), max(0, int(far or 0).bit_length() + 1)
    state = groups.where("_total > 0").select(*names, F.floor((F.col("_total") + 1) / 2).cast("long").alias("_rank"))
    while True:
        shift = max(0, shift - CELL_BITS)
        cells = left.groupBy(*names, F.shiftright("_v", shift).alias("_cell")).agg(F.sum("_n").alias("_n"))
        cells = _same(cells, state, names)
        upto = F.sum("_n").over(Window.partitionBy(*names).orderBy("_cell"))
        found = cells.withColumn("_before", upto - F.col("_n")).where((F.col("_before") < F.col("_rank")) & (F.col("_before") + F.col("_n") >= F.col("_rank")))
        state = stored(found.select(*names, "_cell", (F.col("_rank") - F.col("_before")).alias("_rank")), "median-cells")
        if not shift:
            break
        left = _same(left.withColumn("_cell", F.shiftright("_v", shift)), state.drop("_rank"), [*names, "_cell"]).drop("_cell")
        state = state.drop("_cell")
    median = F.col("_cell") if whole else F.col("_cell").cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-scale))
    out = _same(groups, state, names, "left")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], median.cast(kind).alias(column))


def _same(rows: DataFrame, table: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, NULL equal to NULL."""
    other = table.withColumnsRenamed({n: f"{n}_" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    return rows.join(other, on, how).drop(*[f"{n}_" for n in names])


def impute_zero_margin(extract: DataFrame, retail: bool = False, keys=MEDIAN_KEYS,
                       medians_from: DataFrame | None = None,
                       max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                       medians: DataFrame | None = None) -> DataFrame:
    """Replace zero margins with the median of the non-zero margins of the same
    (model, acquisition year); zero rows without such a group are dropped, rows
    with a NULL margin are in neither set and dropped too.

    ``medians_from`` lets the medians be fitted on other rows (e.g. the training
    side of a split, an extract of the same shape); by default they come from
    the non-zero rows of ``extract`` itself. ``medians`` passes a table already fitted by
    ``group_median`` or ``group_median_exact`` instead.
    """
    source = retail_only(extract) if retail else extract
    rows = clean_ownership(source.where(F.col(S.MARGIN).isNotNull()), keep_zero_flag=True)
    if medians is None:
        fit_on = nonzero_records(medians_from, retail) if medians_from is not None else rows.where(~F.col("_zero"))
        medians = group_median(fit_on, keys)
    joined = join_checked(rows, medians.withColumnRenamed(S.MARGIN, "_median"), list(keys), "left", max_broadcast_rows)
    zero = F.col("_zero")
    return (joined.where(~zero | F.col("_median").isNotNull())
            .withColumn(S.MARGIN, F.when(zero, F.col("_median")).otherwise(F.col(S.MARGIN)))
            .select(*[c for c in rows.columns if c != "_zero"]))
