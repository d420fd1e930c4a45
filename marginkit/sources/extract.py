"""Extracts (S1-S3): filter + projection over the purchase table.

Every predicate is a plain comparison on a source column, so Catalyst pushes it
into the Parquet scan (``PushedFilters``) and only the projected columns are read
(``ReadSchema``). Dates are compared with ``date`` literals, never strings.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

SNAPSHOT_DAY = "snapshot_day"


def _predicate(spec: S.ExtractSpec) -> Column:
    cond = (F.col(S.CUSTOMER).isNotNull() & F.col(S.VIN).isNotNull()
            & (F.col(S.COUNTRY) == spec.country) & (F.col(S.MAKE) == spec.make))
    if spec.start is not None:
        cond &= F.col(S.DATE) >= F.lit(spec.start)
    if spec.end is not None:
        cond &= F.col(S.DATE) <= F.lit(spec.end)
    if spec.require_household:
        cond &= F.col(S.HOUSEHOLD).isNotNull()
    if spec.require_margin:
        cond &= F.col(S.MARGIN).isNotNull()
    if spec.nonzero_margin:
        cond &= F.col(S.MARGIN) != 0
    if spec.require_model:
        cond &= F.col(S.MODEL).isNotNull()
    if spec.retail_only:
        cond &= F.col(S.CUSTOMER_TYPE) == S.RETAIL_CODE
    return cond


def extract_ownership(df: DataFrame, spec: S.ExtractSpec) -> DataFrame:
    """Purchases of one country/make in a date window, keys non-null."""
    return df.where(_predicate(spec)).select(*S.PURCHASE_COLUMNS, *spec.extra_columns)


def extract_snapshot(df: DataFrame, as_of: dt.date, spec: S.ExtractSpec) -> DataFrame:
    """The same extract over the snapshot taken on ``as_of``.

    The day test is written as a half-open timestamp range so it is pushed to the
    scan (and prunes partitions when the history table is partitioned by day). Both
    bounds are dates cast to timestamps, that is midnight in the session's time zone,
    as ``to_date`` would see it; the driver's own zone plays no part.
    """
    midnight = lambda day: F.lit(day).cast("timestamp")
    day = (F.col(S.SNAPSHOT_TS) >= midnight(as_of)) & (F.col(S.SNAPSHOT_TS) < midnight(as_of + dt.timedelta(days=1)))
    if SNAPSHOT_DAY in df.columns:
        # Table written by write_history: prune partitions. The day column was
        # derived in the writer's time zone, so allow one day either side; the
        # exact timestamp range above still selects the snapshot.
        one = dt.timedelta(days=1)
        day = F.col(SNAPSHOT_DAY).between(F.lit(as_of - one), F.lit(as_of + one)) & day
    return extract_ownership(df.where(day), spec)


def extract_outcome(df: DataFrame, start: dt.date, spec: S.ExtractSpec) -> DataFrame:
    """S3: purchases on or after ``start`` with a known, non-zero margin."""
    return extract_ownership(df, spec.with_(start=start, end=None, require_margin=True,
                                            nonzero_margin=True))


def write_history(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the snapshotted purchase table partitioned by snapshot day, so
    ``extract_snapshot`` reads one directory instead of every snapshot."""
    (df.withColumn(SNAPSHOT_DAY, F.to_date(F.col(S.SNAPSHOT_TS)))
       .write.mode(mode).partitionBy(SNAPSHOT_DAY).parquet(path))
