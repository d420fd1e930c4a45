"""DataFrame -> DataFrame operators, grouped by the steps of the source notebooks."""

from .baseline import (  # noqa: F401
    baseline_imputed, baseline_margin, cohort_match, match_back, recent_mean,
)
from .clean import (  # noqa: F401
    clean_ownership, nonzero_records, null_rows, retail_only, time_cut, zero_records, zero_rows,
)
from .evaluate import smape, smape_paired  # noqa: F401
from .features import customer_summary, feature_columns, model_features, with_target  # noqa: F401
from .history import (  # noqa: F401
    anchor_days, day_summary, first_new_or_later, first_outcome, history_profile, history_rows, latest_and_prior,
    multi_purchase, new_anchor, prior_rows, prior_stats, purchase_gaps, rank_newest,
)
from .impute import group_median, group_median_exact, impute_zero_margin  # noqa: F401
from .joins import join_checked, materialize  # noqa: F401
from .linear import fit_linear, gram  # noqa: F401
from .quality import profile_flags, summary_stats, value_counts  # noqa: F401
from .split import rest_after, split_parts, split_side  # noqa: F401
