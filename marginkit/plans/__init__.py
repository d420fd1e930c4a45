"""Composite flows: training/test tables, scoring features, baseline, comparison."""

from .flows import (  # noqa: F401
    PROXY, baseline_audit, baseline_cohort, baseline_match, baseline_predictions, baseline_quality_profile,
    features_all_customers, fit_medians, imputed_training_rows, matched_margins, outcome_first, scoring_features,
    scoring_quality_profile, scoring_rows, side_features, side_rows, smape_compare, smape_model, training_quality_profile, training_table, training_table_from,
)
from .views import flow_views, register_flow_views, sorted_output  # noqa: F401,E402
