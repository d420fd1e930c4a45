"""Customer features.

The source builds each feature as its own grouped view and star-joins them on
``consumer_id``. All of them share that key and cover the same customers, so
here they come out of **one** aggregation: one shuffle instead of seven plus
six joins, and the aggregation is partial (map-side) so a hot customer is
pre-reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import (
    PLATFORMS, exact_mean, frequency_band, indicator, lease_band, mean_gap_years, recency_band,
)


def customer_summary(rows: DataFrame) -> DataFrame:
    """A3-A8 over *all* rows of each customer, in one aggregation."""
    aggs = [
        F.count(S.DATE).alias("n_dated"),
        F.sum(S.AGE).alias("age_sum"), F.count(S.AGE).alias("age_n"),
        F.sum(S.LEASE).alias("no_of_lease_purchases"),
        F.sum(S.MARGIN).alias("cm_sum"), F.count(S.MARGIN).alias("cm_n"),
        F.min(S.DATE).alias("min_date"), F.max(S.DATE).alias("max_date"),
    ]
    aggs += [F.sum(indicator(F.col(S.PLATFORM) == p)).alias(f"seg_{p.lower()}") for p in PLATFORMS]
    s = rows.groupBy(S.CUSTOMER).agg(*aggs)
    return s.select(
        S.CUSTOMER,
        F.col("n_dated").alias("freq_excluding_latest"),
        "age_sum", "age_n", "no_of_lease_purchases", "cm_sum", "cm_n",
        F.when(F.col("n_dated") >= 2, F.datediff("max_date", "min_date")).alias("span_days"),
        (F.col("n_dated") - 1).alias("n_gaps"),
        *[f"seg_{p.lower()}" for p in PLATFORMS],
    )


def feature_columns(stats: DataFrame) -> DataFrame:
    """Raw per-customer features from summary statistics (combined table, J4a)."""
    cols = [
        S.CUSTOMER,
        F.col("freq_excluding_latest").cast("long").alias("freq_excluding_latest"),
        exact_mean(F.col(_c(stats, "cm_sum")), F.col(_c(stats, "cm_n"))).alias("avg_contribution_margin_new"),
        recency_band(F.col("span_days"), F.col("n_gaps")).alias("AVERAGE_TIME_TO_PURCHASE"),
        mean_gap_years(F.col("span_days"), F.col("n_gaps")).alias("mean_gap_years"),
        exact_mean(F.col(_c(stats, "age_sum")), F.col(_c(stats, "age_n"))).alias("avg_vehicle_age"),
        F.col("no_of_lease_purchases").cast("long").alias("no_of_lease_purchases"),
        *[F.col(f"seg_{p.lower()}").cast("long").alias(f"seg_{p.lower()}") for p in PLATFORMS],
    ]
    for extra in (S.LIFESTAGE, "Latest_CM", "Latest_CM_purchase_year"):
        if extra in stats.columns:
            cols.append(extra)
    return stats.select(*cols)


def _c(stats: DataFrame, base: str) -> str:
    """Column of a prior-purchase summary (``*_prior``) or of a plain one."""
    prior = {"cm_sum": "cm_sum_prior", "cm_n": "cm_n_prior",
             "age_sum": "age_sum_prior", "age_n": "age_n_prior"}[base]
    return prior if prior in stats.columns else base


def model_features(features: DataFrame, float_margin: bool = True) -> DataFrame:
    """X8-X10 + X4: the model-facing columns (bands and the float margin)."""
    margin = F.col("avg_contribution_margin_new")
    return features.select(
        S.CUSTOMER,
        frequency_band(F.col("freq_excluding_latest")).alias("Freq_purchase"),
        (margin.cast("float") if float_margin else margin).alias("avg_imputed_contribution_margin"),
        "AVERAGE_TIME_TO_PURCHASE",
        "avg_vehicle_age",
        lease_band(F.col("no_of_lease_purchases")).alias("lease_purchase_flag"),
        *[c for c in ("Latest_CM_purchase_year", "Latest_CM") if c in features.columns],
    )


def with_target(features: DataFrame) -> DataFrame:
    """J5 + X4: training/test table layout, target as float."""
    return model_features(features).select(
        S.CUSTOMER, "Freq_purchase", "avg_imputed_contribution_margin", "AVERAGE_TIME_TO_PURCHASE",
        "avg_vehicle_age", "lease_purchase_flag",
        F.col("Latest_CM_purchase_year").cast("int").alias("Latest_CM_purchase_year"),
        F.col("Latest_CM").cast("double").cast("float").alias("Latest_CM"))
