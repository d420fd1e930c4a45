"""Scalar column expressions (cleaning casts, bands, indicators, stable hashing)."""

from .columns import (  # noqa: F401
    as_margin, clean_int, exact_mean, frequency_band, hash_bucket, indicator, lease_band,
    mean_gap_years, recency_band, sMAPE_term,
)
