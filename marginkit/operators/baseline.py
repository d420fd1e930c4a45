"""Incumbent baseline model and match-back to outcomes.

The baseline predicts a customer's next margin as the mean of their known
(non-zero) past margins, and a fallback mean for customers without one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import exact_mean
from .joins import DEFAULT_BROADCAST_ROWS, join_checked


def _known(c: str = S.MARGIN) -> Column:
    """The margin where it is known (non-zero); NULL otherwise."""
    return F.when(F.col(c) != 0, F.col(c))


def baseline_margin(extract: DataFrame) -> DataFrame:
    """A10 + A2 + J7: every retail customer with the mean of their known margins
    (NULL if none). One aggregation replaces distinct + grouped mean + left join:
    the customer appears whether or not a margin is known."""
    retail = extract.where(F.col(S.CUSTOMER_TYPE) == S.RETAIL_CODE)
    return retail.groupBy(S.CUSTOMER).agg(
        exact_mean(F.sum(_known()), F.count(_known())).alias("avg_cm"))


def recent_mean(extract: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """A9 + X13: mean known retail margin of purchases in [start, end], one row.

    Summed as a decimal then divided, so the value does not depend on the order
    partial sums are combined in.
    """
    in_window = (F.col(S.DATE) >= F.lit(start)) & (F.col(S.DATE) <= F.lit(end))
    m = F.when(in_window, F.col(S.MARGIN))
    rows = extract.where((F.col(S.MARGIN) != 0) & (F.col(S.CUSTOMER_TYPE) == S.RETAIL_CODE))
    return rows.agg(exact_mean(F.sum(m), F.count(m)).alias("cm_365"))


def baseline_imputed(base: DataFrame, fallback, keep_raw: bool = False) -> DataFrame:
    """Fill customers without a known margin with ``fallback``: a number
    (the source's hard-coded constant) or a one-row DataFrame such as
    ``recent_mean`` (applied as a scalar subquery, not a join). ``keep_raw`` also keeps
    the customer's own mean."""
    if isinstance(fallback, DataFrame):
        fill = fallback.scalar()
    else:
        fill = F.lit(float(fallback))
    raw = ["avg_cm"] if keep_raw else []
    return base.select(S.CUSTOMER, *raw, F.coalesce(F.col("avg_cm"), fill.cast("double")).alias("avg_cm_imputed"))


def match_back(left: DataFrame, outcome_first: DataFrame, columns: list[str] | None = None,
               rows: bool = False) -> DataFrame:
    """Rows of customers who bought again, with the outcome margin attached.

    ``outcome_first`` has one row per customer. When both sides are per customer
    there is no skew. When ``left`` is row-level (``rows=True``: a whole
    history, where one customer may hold a third of the rows) the outcome side is
    materialized and counted first (``join_checked``): it is broadcast under the
    bound, and above it both join inputs are plain shuffle stages, which is what
    AQE needs to split the hot customer's partition (an aggregate on top of
    one side's shuffle would keep AQE from splitting).
    """
    outcome = outcome_first.select(S.CUSTOMER, "Latest_CM")
    if rows:
        joined = join_checked(left, outcome, S.CUSTOMER, "inner", max_rows=MATCH_BACK_BROADCAST_ROWS)
    else:
        joined = left.join(outcome, S.CUSTOMER, "inner")
    return joined.select(*(columns or joined.columns))


# Broadcast bound of the per-customer outcome side in the row-level match-back.
MATCH_BACK_BROADCAST_ROWS = DEFAULT_BROADCAST_ROWS


def cohort_match(matched: DataFrame, cohort: DataFrame) -> DataFrame:
    """Keep baseline rows of the customers in the new model's cohort. An
    inner join, so a customer listed twice in the cohort appears twice, as in
    the source."""
    c = cohort.select(F.col(S.CUSTOMER).cast("long").alias(S.CUSTOMER))
    return matched.join(c, S.CUSTOMER, "inner").select(*matched.columns)

