"""Projections and row filters (P1, F4-F7, F12, F13). All narrow: no shuffle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import as_margin, clean_int


def clean_ownership(df: DataFrame, margin_as: str = S.MARGIN, keep_zero_flag: bool = False,
                    extra: list | None = None) -> DataFrame:
    """Trim padded text, model year to int, margin to decimal(18,2).

    ``keep_zero_flag`` adds ``_zero``: whether the margin *as stored* is 0 (unknown). A
    small non-zero margin may round to 0.00 and is still known. ``extra`` columns are
    computed on the input."""
    flag = [(F.col(S.MARGIN) == 0).alias("_zero")] if keep_zero_flag else []
    return df.select(
        S.VIN, S.CUSTOMER, S.CYCLE,
        F.trim(F.col(S.MODEL)).alias(S.MODEL),
        clean_int(F.col(S.MODEL_YEAR)).alias(S.MODEL_YEAR),
        S.DATE, S.YEAR, S.AGE, S.LEASE,
        F.trim(F.col(S.PLATFORM)).alias(S.PLATFORM),
        F.trim(F.col(S.LIFESTAGE)).alias(S.LIFESTAGE),
        as_margin(F.col(S.MARGIN)).alias(margin_as), *flag, *(extra or []),
    )


def retail_only(df: DataFrame) -> DataFrame:
    """individual (retail) buyers only."""
    return df.where(F.col(S.CUSTOMER_TYPE) == S.RETAIL_CODE)


def nonzero_records(df: DataFrame, retail: bool = False) -> DataFrame:
    """F5 + P1: cleaned rows with a known margin (``!= 0`` also drops NULL)."""
    if retail:
        df = retail_only(df)
    return clean_ownership(df.where(F.col(S.MARGIN) != 0))


def zero_records(df: DataFrame, retail: bool = False) -> DataFrame:
    """F6 + P1: cleaned rows whose margin is 0 (unknown); the margin column is
    renamed so it can be replaced by a group median."""
    if retail:
        df = retail_only(df)
    return clean_ownership(df.where(F.col(S.MARGIN) == 0), margin_as="contribution_margin_0")


def time_cut(df: DataFrame, cut: dt.date, side: str) -> DataFrame:
    """``'train'`` keeps purchases on or before ``cut``, ``'test'`` after it,
    ``'outcome'`` on or after it."""
    d = F.col(S.DATE)
    cond = {"train": d <= F.lit(cut), "test": d > F.lit(cut), "outcome": d >= F.lit(cut)}[side]
    return df.where(cond)


def null_rows(df: DataFrame, column: str) -> DataFrame:
    """rows where ``column`` is NULL."""
    return df.where(F.col(column).isNull())


def zero_rows(df: DataFrame, column: str) -> DataFrame:
    """rows where ``column`` is 0."""
    return df.where(F.col(column) == 0)
