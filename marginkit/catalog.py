"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir)
-> DataFrame`` over the full test tables (no sampling, no row caps).

Every query starts from the driver's tables through the adapter, so its work
grows with the scale factor. ``oracle.oracle_sql()`` holds the DuckDB twin of
each key except ``score_margin`` (an iterative model fit); the tests check its
predictions, and ``score_linear`` applies given coefficients with an exact twin.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans
from . import schema as S
from .operators import baseline as B
from .operators import history as H
from .operators.clean import nonzero_records, null_rows, zero_records, zero_rows
from .operators.features import feature_columns
from .operators import linear
from .operators.impute import group_median, group_median_exact
from .operators.quality import summary_stats, value_counts
from .operators.score import fit_margin_model, score_linear, score_margin
from .operators.split import rest_after, split_parts, split_side
from .session import ensure_checkpoint_dir, scratch_path
from .sources import adapter
from .sources.extract import extract_outcome, extract_ownership, extract_snapshot
from .sources.tables import read_cohort_csv, read_table, write_table

US, SECOND = S.US_FLOW, S.SECOND_FLOW
Query = Callable[[SparkSession, str], DataFrame]


def _live(spark: SparkSession, d: str) -> DataFrame:
    return adapter.ownership(spark, d)


def _hist(spark: SparkSession, d: str) -> DataFrame:
    return adapter.ownership_history(spark, d)


def _extract(spark, d):
    return extract_ownership(_live(spark, d), US.training_extract())


def _imputed(spark, d):
    return plans.imputed_training_rows(_live(spark, d), US)


def _train_rows(spark, d):
    return plans.side_rows(_live(spark, d), US, "train")


def _ranked_multi(spark, d):
    return H.multi_purchase(_train_rows(spark, d))


def _prior(spark, d):
    return H.prior_rows(_train_rows(spark, d))


def _train_profile(spark, d, with_lifestage=False):
    return H.history_profile(_train_rows(spark, d), with_lifestage=with_lifestage)


def _train_features(spark, d, with_lifestage=False):
    return feature_columns(_train_profile(spark, d, with_lifestage))


def _scoring_us(spark, d):
    return plans.scoring_features(_live(spark, d), _hist(spark, d), US)


def _snapshot(spark, d):
    return extract_snapshot(_hist(spark, d), US.calendar.snapshot, US.snapshot_extract())


def _baseline_extract(spark, d):
    return _snapshot(spark, d)


def _cohort(spark: SparkSession, d: str, flow: S.Flow = US) -> DataFrame:
    """S7 + S8: the new model's scored customers written as headered CSV by the
    executors (to the shared checkpoint folder), columns in another order than the
    schema's, and read back by name."""
    from pyspark.sql import types as T

    from .jobs import COHORT_SCHEMA
    path = scratch_path(spark, "cohort-csv")
    scored = plans.scoring_features(_live(spark, d), _hist(spark, d), flow)
    write_table(scored.select(*reversed(scored.columns)), path, "csv")
    return read_cohort_csv(spark, path, T.DataType.fromDDL(COHORT_SCHEMA))


def _scoring_stored(spark: SparkSession, d: str) -> DataFrame:
    """The scoring table as the scoring job stores it before it is cut into parts."""
    path = scratch_path(spark, "scoring-features")
    write_table(_scoring_us(spark, d), path)
    return read_table(spark, path)


def _saved_table(spark: SparkSession, d: str) -> DataFrame:
    """The all-customer features saved as an external ORC table and read by name."""
    name, path = f"marginkit_saved_{uuid.uuid4().hex[:8]}", scratch_path(spark, "saved-table")
    write_table(plans.features_all_customers(_live(spark, d), SECOND), path, "orc", table=name)
    return spark.table(name)


def _gram(spark: SparkSession, d: str) -> DataFrame:
    """The sums of the fit, whole numbers written as text (they may pass a long)."""
    return linear.gram(plans.training_table(_live(spark, d))).withColumn("total", F.col("total").cast("string"))


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    return linear.fit_linear(plans.training_table(_live(spark, d)))


def _linear_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINEAR_WEIGHTS, "term string, weight double")


def _sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The scoring table through Parquet, ORC and CSV sinks and back."""
    df = _scoring_us(spark, d)
    ensure_checkpoint_dir(spark)
    out = None
    for fmt in ("parquet", "orc", "csv"):
        path = scratch_path(spark, f"sink-{fmt}")
        write_table(df, path, fmt)
        back = read_table(spark, path, fmt, schema=df.schema).select(F.lit(fmt).alias("format"), "*")
        out = back if out is None else out.unionByName(back)
    return out


def _score_margin(spark: SparkSession, d: str) -> DataFrame:
    """Fit on the training table, score the US scoring features."""
    model = fit_margin_model(plans.training_table(_live(spark, d), US, "train"))
    return score_margin(model, _scoring_us(spark, d))


from .oracle import SQL_SURFACE  # noqa: E402  (the same view query text on both engines)


def _sql_surface(spark: SparkSession, d: str) -> DataFrame:
    """The flow's stages registered as views and queried with spark.sql."""
    from .plans.views import register_flow_views
    register_flow_views(spark, _live(spark, d), None, US, prefix="mk_")
    return spark.sql(SQL_SURFACE.format(p="mk_"))


# Example coefficients of the linear form (not fitted): a base margin, half the customer's
# own mean, and steps for the bands.
LINEAR_WEIGHTS = [
    ("intercept", 5000.0), ("avg_imputed_contribution_margin", 0.5), ("avg_vehicle_age", -125.5),
    ("Freq_purchase=Two", 310.25), ("Freq_purchase=Three", 720.5), ("Freq_purchase=More_than_Three", 1100.75),
    ("AVERAGE_TIME_TO_PURCHASE=Repurchased_WITHIN_3_yrs", 450.0), ("lease_purchase_flag=One", -80.25),
]


def _columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


SUMMARY_COLUMNS = ["Freq_purchase", "AVERAGE_TIME_TO_PURCHASE", "lease_purchase_flag",
                   "avg_imputed_contribution_margin", "avg_vehicle_age", "Latest_CM", "consumer_id"]

FEATURES_FULL = ["consumer_id", "freq_excluding_latest", "avg_contribution_margin_new", "AVERAGE_TIME_TO_PURCHASE",
                 "seg_car", "seg_suv", "seg_truck", "avg_vehicle_age", "no_of_lease_purchases", S.LIFESTAGE]


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        # sources / projections / filters
        "extract_live": _extract,
        "extract_snapshot": _snapshot,
        "extract_outcome": lambda s, d: extract_outcome(_live(s, d), US.calendar.outcome_start, US.outcome_extract()),
        "retail_only": lambda s, d: _snapshot(s, d).where(F.col(S.CUSTOMER_TYPE) == S.RETAIL_CODE),
        "nonzero_records": lambda s, d: nonzero_records(_extract(s, d)),
        "zero_records": lambda s, d: zero_records(_extract(s, d)),
        # imputation
        "group_median": lambda s, d: group_median(nonzero_records(_extract(s, d))),
        "group_median_exact": lambda s, d: group_median_exact(nonzero_records(_extract(s, d))),
        "impute_zero_margin": _imputed,
        "distinct_customers": lambda s, d: _imputed(s, d).select(S.CUSTOMER).distinct(),
        # split and time cut
        "split_train": lambda s, d: split_side(_imputed(s, d), "train"),
        "split_test": lambda s, d: split_side(_imputed(s, d), "test"),
        "oot_train": _train_rows,
        "oot_test": lambda s, d: plans.side_rows(_live(s, d), US, "test"),
        # history windows, row level
        "new_anchor_running_sum": lambda s, d: H.new_anchor(_train_rows(s, d)),
        "new_anchor_filter": lambda s, d: H.first_new_or_later(_train_rows(s, d)),
        "row_number_desc": lambda s, d: H.rank_newest(_train_rows(s, d)),
        "multi_purchase": _ranked_multi,
        "prior_transactions": _prior,
        "purchase_gaps": lambda s, d: H.purchase_gaps(_train_rows(s, d)),
        "target_latest": lambda s, d: _train_profile(s, d).select(
            S.CUSTOMER, F.col("Latest_CM_purchase_year").cast("int").alias("Latest_CM_purchase_year"), "Latest_CM"),
        # features (one aggregation)
        "purchase_frequency": lambda s, d: _columns(_train_features(s, d), [S.CUSTOMER, "freq_excluding_latest"]),
        "avg_vehicle_age": lambda s, d: _columns(_train_features(s, d), [S.CUSTOMER, "avg_vehicle_age"]),
        "lease_count": lambda s, d: _columns(_train_features(s, d), [S.CUSTOMER, "no_of_lease_purchases"]),
        "avg_margin": lambda s, d: _columns(_train_features(s, d), [S.CUSTOMER, "avg_contribution_margin_new"]),
        "platform_counts": lambda s, d: _columns(_train_features(s, d), [S.CUSTOMER, "seg_car", "seg_suv", "seg_truck"]),
        "mean_purchase_gap": lambda s, d: _columns(_train_features(s, d), [S.CUSTOMER, "mean_gap_years"]),
        "latest_lifestage": lambda s, d: _columns(_train_features(s, d, True), [S.CUSTOMER, S.LIFESTAGE]),
        "features_full": lambda s, d: _columns(_train_features(s, d, True), FEATURES_FULL),
        "band_frequency": lambda s, d: _columns(plans.training_table(_live(s, d)), [S.CUSTOMER, "Freq_purchase"]),
        "band_recency": lambda s, d: _columns(plans.training_table(_live(s, d)), [S.CUSTOMER, "AVERAGE_TIME_TO_PURCHASE"]),
        "band_lease": lambda s, d: _columns(plans.training_table(_live(s, d)), [S.CUSTOMER, "lease_purchase_flag"]),
        # model tables
        "training_table": lambda s, d: plans.training_table(_live(s, d), US, "train"),
        "test_table": lambda s, d: plans.training_table(_live(s, d), US, "test"),
        "features_all_customers": lambda s, d: plans.features_all_customers(_live(s, d), SECOND),
        "first_outcome": lambda s, d: plans.outcome_first(_live(s, d), US),
        "match_back": lambda s, d: B.match_back(plans.scoring_rows(_hist(s, d), US), plans.outcome_first(_live(s, d), US),
                                                rows=True),
        "scoring_features": _scoring_us,
        "scoring_features_second": lambda s, d: plans.scoring_features(_live(s, d), _hist(s, d), SECOND),
        # baseline
        "baseline_avg": lambda s, d: B.baseline_margin(_baseline_extract(s, d)).where(F.col("avg_cm").isNotNull()),
        "baseline_avg_left": lambda s, d: B.baseline_margin(_baseline_extract(s, d)),
        "recent_mean_margin": lambda s, d: B.recent_mean(_baseline_extract(s, d), US.calendar.recent_start,
                                                         US.calendar.recent_end),
        "baseline_imputed": lambda s, d: plans.baseline_predictions(_hist(s, d), US),
        "baseline_match": lambda s, d: plans.baseline_match(_live(s, d), _hist(s, d), US),
        "baseline_match_second": lambda s, d: plans.baseline_match(_live(s, d), _hist(s, d), SECOND),
        "cohort_match_second": lambda s, d: plans.baseline_cohort(_live(s, d), _hist(s, d), _cohort(s, d, SECOND), SECOND),
        "baseline_audit_second": lambda s, d: plans.baseline_audit(_live(s, d), _hist(s, d), _cohort(s, d, SECOND), SECOND),
        "smape_compare_second": lambda s, d: plans.smape_compare(_live(s, d), _hist(s, d), SECOND),
        "cohort_match": lambda s, d: plans.baseline_cohort(_live(s, d), _hist(s, d), _cohort(s, d), US),
        "baseline_audit": lambda s, d: plans.baseline_audit(_live(s, d), _hist(s, d), _cohort(s, d), US),
        "smape_compare": lambda s, d: plans.smape_compare(_live(s, d), _hist(s, d), US),
        # parts, audits, sinks, model
        "split_parts": lambda s, d: split_parts(_scoring_stored(s, d), 3).select(S.CUSTOMER, "part"),
        "left_anti_rest": lambda s, d: _rest_after_first_part(_scoring_stored(s, d)),
        "quality_profile": lambda s, d: plans.training_quality_profile(_live(s, d), US),
        "scoring_profile": lambda s, d: plans.scoring_quality_profile(_live(s, d), _hist(s, d), US),
        "baseline_profile": lambda s, d: plans.baseline_quality_profile(_hist(s, d), US),
        "null_rows": lambda s, d: null_rows(B.baseline_margin(_baseline_extract(s, d)), "avg_cm"),
        "zero_rows": lambda s, d: zero_rows(_snapshot(s, d), S.MARGIN),
        "value_counts": lambda s, d: value_counts(plans.training_table(_live(s, d)),
                                                  ["Freq_purchase", "lease_purchase_flag", "AVERAGE_TIME_TO_PURCHASE"]),
        "summary_stats": lambda s, d: summary_stats(_scoring_us(s, d),
                                                    SUMMARY_COLUMNS),
        "saved_table": _saved_table,
        "score_linear": lambda s, d: score_linear(_scoring_us(s, d), _linear_weights(s)),
        "fit_linear": _gram,
        "fit_linear_weights": _fitted,
        "smape_model": lambda s, d: plans.smape_model(_live(s, d), _hist(s, d), _fitted(s, d)),
        "sink_roundtrip": _sink_roundtrip,
        "sql_surface": _sql_surface,
        "sorted_output": lambda s, d: _sorted(plans.training_table(_live(s, d))),
        "score_margin": _score_margin,
    }
    return q


def _rest_after_first_part(feats: DataFrame) -> DataFrame:
    """The scoring table minus its first part, as the source cuts it."""
    return rest_after(feats, split_parts(feats, 3).where(F.col("part") == 1))


def _sorted(df: DataFrame) -> DataFrame:
    from .plans.views import sorted_output
    return sorted_output(df, S.CUSTOMER)


FLAGSHIP = "training_table"
