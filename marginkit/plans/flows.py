"""Composite flows (C1-C8): from the purchase table to a customer table.

Building a flow starts small jobs of its own: the median table of C1 is fitted, stored
and counted (it decides between a broadcast and a shuffle join), and so are the outcome
customers of the row-level match-back. Everything else is one lazy plan with its action
at the sink.

Inputs are the live purchase table (``live``) and the snapshotted one
(``history``); a ``Flow`` names the country, make and calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import hash_bucket, rejected_int
from ..operators.baseline import baseline_imputed, baseline_margin, cohort_match, match_back, recent_mean
from ..operators.clean import clean_ownership, nonzero_records, time_cut
from ..operators.evaluate import smape, smape_paired
from ..operators.features import customer_summary, feature_columns, model_features, with_target
from ..operators.history import first_outcome, history_profile
from ..operators.impute import group_median, impute_zero_margin
from ..operators.joins import join_checked, materialize
from ..operators.quality import profile_flags
from ..operators.score import score_linear
from ..operators.split import TRAIN_PERCENT, split_side
from ..sources.extract import extract_outcome, extract_ownership, extract_snapshot


# --- C1 ----------------------------------------------------------------------

def fit_medians(live: DataFrame, flow: S.Flow, fit_on: str = "all") -> DataFrame:
    """The medians of C1 on the training extract, fitted and stored once (one row per model
    and year), to be shared by the flows of a job.

    ``fit_on='all'`` takes the medians over all rows before the split, as the
    source does (the training side then sees test-period margins);
    ``fit_on='train'`` fits them on the training side's rows only (train
    customers, on or before the cut), which is leak-free.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    ex = extract_ownership(live, flow.training_extract())
    if fit_on == "train":
        ex = time_cut(split_side(ex, "train"), flow.calendar.cut, "train")
    return materialize(group_median(nonzero_records(ex)))


def imputed_training_rows(live: DataFrame, flow: S.Flow, fit_on: str = "all",
                          medians: DataFrame | None = None) -> DataFrame:
    """C1 on the training extract, with given medians or those of ``fit_medians``."""
    if medians is None:
        medians = fit_medians(live, flow, fit_on)
    return impute_zero_margin(extract_ownership(live, flow.training_extract()), medians=medians)


def side_rows(live: DataFrame, flow: S.Flow, side: str, imputed: DataFrame | None = None,
              fit_on: str = "all") -> DataFrame:
    """R1 + F4: rows of one side: train customers up to the cut, test customers after it."""
    rows = imputed if imputed is not None else imputed_training_rows(live, flow, fit_on)
    return time_cut(split_side(rows, side), flow.calendar.cut, side)


def training_quality_profile(live: DataFrame, flow: S.Flow = S.US_FLOW, medians: DataFrame | None = None) -> DataFrame:
    """A12 over the stages of C1 + R1 + F4 (extract, non-zero, imputed, both
    sides of the split), from one scan of the extract besides the median fit."""
    train = hash_bucket(F.col(S.CUSTOMER), 100) < TRAIN_PERCENT
    cut = F.lit(flow.calendar.cut)
    return _flow_profile(extract_ownership(live, flow.training_extract()), {
        "oot_train": train & (F.col(S.DATE) <= cut),
        "oot_test": ~train & (F.col(S.DATE) > cut),
    }, medians=medians)


def scoring_quality_profile(live: DataFrame, history: DataFrame, flow: S.Flow = S.US_FLOW) -> DataFrame:
    """A12 over the stages of C5: retail snapshot extract, non-zero, imputed, and the
    rows of customers who bought again. Rows are counted per customer before the customers
    of the outcome window are joined, so a customer's rows never meet in one join task."""
    ex = extract_snapshot(history, flow.calendar.snapshot, flow.snapshot_extract())
    rows = ex.where(F.col(S.CUSTOMER_TYPE) == S.RETAIL_CODE)
    return _flow_profile(rows, {}, of_customers={"bought_again": ("imputed", outcome_rows(live, flow))})


def baseline_quality_profile(history: DataFrame, flow: S.Flow = S.US_FLOW) -> DataFrame:
    """A12 over the stages of C6: snapshot extract, retail rows, known margins, and known
    margins of the recent year."""
    ex = baseline_extract(history, flow)
    c, m = flow.calendar, F.col(S.MARGIN)
    retail = F.coalesce(F.col(S.CUSTOMER_TYPE) == S.RETAIL_CODE, F.lit(False))
    known = retail & F.coalesce(m != 0, F.lit(False))
    recent = F.col(S.DATE).between(F.lit(c.recent_start), F.lit(c.recent_end))
    bad = rejected_int(F.col(S.MODEL_YEAR))
    return profile_flags(ex, {
        "extract": (F.lit(True), m), "retail": (retail, m), "known": (known, m), "recent": (known & recent, m),
    }, bad)


def _flow_profile(extract: DataFrame, more: dict, medians: DataFrame | None = None, of_customers: dict | None = None) -> DataFrame:
    """Stages extract, non-zero and imputed of C1 on ``extract``, plus the imputed rows that
    meet each further condition, and the rows of a stage whose customers are in a table."""
    rows = clean_ownership(extract, keep_zero_flag=True, extra=[rejected_int(F.col(S.MODEL_YEAR)).alias("_bad_year")])
    m, zero = F.col(S.MARGIN), F.col("_zero")
    if medians is None:
        medians = group_median(rows.where(~zero))
    j = join_checked(rows, medians.withColumnRenamed(S.MARGIN, "_median"), [S.MODEL, S.YEAR], "left")
    margin = F.when(zero, F.col("_median")).otherwise(m)
    imputed = m.isNotNull() & (~zero | F.col("_median").isNotNull())
    return profile_flags(j, {
        "extract": (F.lit(True), m),
        "nonzero": (F.coalesce(~zero, F.lit(False)), m),
        "imputed": (imputed, margin),
        **{name: (imputed & condition, margin) for name, condition in more.items()},
    }, F.col("_bad_year"), of_customers)


# --- C2 / C3 -----------------------------------------------------------------

def side_features(live: DataFrame, flow: S.Flow, side: str, with_lifestage: bool = False,
                  fit_on: str = "all", imputed: DataFrame | None = None) -> DataFrame:
    """Combined feature table of one side (J4a), prior purchases only."""
    rows = side_rows(live, flow, side, imputed, fit_on)
    return feature_columns(history_profile(rows, with_lifestage=with_lifestage))


def training_table(live: DataFrame, flow: S.Flow = S.US_FLOW, side: str = "train", fit_on: str = "all",
                   imputed: DataFrame | None = None) -> DataFrame:
    """C2 (``side='train'``) / C3 (``side='test'``): one row per customer with more
    than one anchored purchase: features of the prior purchases, target = margin
    and year of the latest one."""
    return with_target(side_features(live, flow, side, fit_on=fit_on, imputed=imputed))


def training_table_from(side_rows_df: DataFrame) -> DataFrame:
    """C2/C3 from already imputed, split and cut rows of one side."""
    return with_target(feature_columns(history_profile(side_rows_df)))


# --- C4 / C5 -----------------------------------------------------------------

def features_all_customers(live: DataFrame, flow: S.Flow = S.SECOND_FLOW) -> DataFrame:
    """C4: features of every customer over all their purchases, no target."""
    rows = impute_zero_margin(extract_ownership(live, flow.all_customers_extract()))
    return model_features(feature_columns(customer_summary(rows))).drop("Latest_CM")


def scoring_rows(history: DataFrame, flow: S.Flow) -> DataFrame:
    """C1 on the snapshot extract, retail buyers only."""
    snap = extract_snapshot(history, flow.calendar.snapshot, flow.snapshot_extract())
    return impute_zero_margin(snap, retail=True)


def outcome_first(live: DataFrame, flow: S.Flow) -> DataFrame:
    """S3 + F7 + W3: each retail customer's first purchase in the outcome window."""
    return first_outcome(outcome_rows(live, flow))


def outcome_rows(live: DataFrame, flow: S.Flow) -> DataFrame:
    """S3 + F7: the retail purchases of the outcome window."""
    return extract_outcome(live, flow.calendar.outcome_start, flow.outcome_extract())


def bought_again(rows: DataFrame, live: DataFrame, flow: S.Flow) -> DataFrame:
    """Rows of customers with a purchase in the outcome window."""
    return rows.join(outcome_rows(live, flow).select(S.CUSTOMER), S.CUSTOMER, "left_semi")


def scoring_features(live: DataFrame, history: DataFrame, flow: S.Flow = S.US_FLOW,
                     float_margin: bool | None = None) -> DataFrame:
    """Features over the full snapshot history of customers who bought again,
    with the first outcome margin as ``Latest_CM``.

    Filter, aggregate, join: a semi join with the raw outcome rows keeps only the
    history of customers who bought again (few), before anything is grouped. A semi
    join needs no distinct, so no aggregate sits on either side of it, and AQE may
    broadcast it or split a hot customer. The final join has one row per customer on
    both sides. ``float_margin`` defaults to the source's choice per country (the US
    notebook keeps the mean uncast).
    """
    if float_margin is None:
        float_margin = flow.country != S.COUNTRY_US
    stats = customer_summary(bought_again(scoring_rows(history, flow), live, flow))
    matched = match_back(stats, outcome_first(live, flow))
    return model_features(feature_columns(matched), float_margin=float_margin)


# --- C6 / C7 -----------------------------------------------------------------

def baseline_extract(history: DataFrame, flow: S.Flow) -> DataFrame:
    return extract_snapshot(history, flow.calendar.snapshot, flow.snapshot_extract())


def _fallback(extract: DataFrame, flow: S.Flow, fallback):
    """The given constant, or the mean of the recent year over all retail customers: a
    global aggregate (no shuffle of customers) used as a scalar subquery."""
    return recent_mean(extract, flow.calendar.recent_start, flow.calendar.recent_end) if fallback is None else fallback


def baseline_predictions(history: DataFrame, flow: S.Flow = S.US_FLOW, fallback=None) -> DataFrame:
    """Customer mean of known margins, else ``fallback`` (default: the mean
    of the recent year, computed from the data; pass the source's constant for
    parity)."""
    ex = baseline_extract(history, flow)
    return baseline_imputed(baseline_margin(ex), _fallback(ex, flow, fallback))


def matched_margins(live: DataFrame, history: DataFrame, flow: S.Flow, fallback) -> DataFrame:
    """Per customer who bought again: raw mean (``avg_cm``), prediction and outcome. Only
    those customers are grouped (the others are most of the table)."""
    ex = baseline_extract(history, flow)
    means = baseline_margin(bought_again(ex, live, flow))
    filled = baseline_imputed(means, _fallback(ex, flow, fallback), keep_raw=True)
    return match_back(filled, outcome_first(live, flow), [S.CUSTOMER, "avg_cm", "avg_cm_imputed", "Latest_CM"])


def baseline_match(live: DataFrame, history: DataFrame, flow: S.Flow = S.US_FLOW, fallback=None) -> DataFrame:
    """C7 (J6b): baseline prediction and actual outcome of customers who bought again."""
    return matched_margins(live, history, flow, fallback).drop("avg_cm")


def baseline_cohort(live: DataFrame, history: DataFrame, cohort: DataFrame, flow: S.Flow = S.US_FLOW,
                    fallback=None) -> DataFrame:
    """C7 (J9): the baseline match restricted to the new model's cohort."""
    return cohort_match(baseline_match(live, history, flow, fallback), cohort)


def baseline_audit(live: DataFrame, history: DataFrame, cohort: DataFrame, flow: S.Flow = S.US_FLOW,
                   fallback=None) -> DataFrame:
    """C7 (J10): cohort customers with their raw mean (NULL = no usable margin)."""
    return cohort_match(matched_margins(live, history, flow, fallback), cohort).select(S.CUSTOMER, "avg_cm")


# --- C8 ----------------------------------------------------------------------

#: name of the stand-in for a model: the customer's mean imputed margin, a feature
PROXY = "mean_margin_proxy"


def smape_compare(live: DataFrame, history: DataFrame, flow: S.Flow = S.US_FLOW, fallback=None,
                  new_predictions: DataFrame | None = None) -> DataFrame:
    """sMAPE of the new and the incumbent model on the same customers.

    ``new_predictions`` (``consumer_id``, ``predicted_margin``, one row per customer) is
    the new model's output, reported as ``new_model``. Without it there is no new model
    in the table: the customer's mean imputed margin is scored as ``mean_margin_proxy``.
    """
    feats = scoring_features(live, history, flow)
    if new_predictions is None:  # one reference to the scoring table, no self-join
        name = PROXY
        scored = feats.select(S.CUSTOMER, "Latest_CM", F.col("avg_imputed_contribution_margin").alias(name))
    else:
        name = "new_model"
        scored = feats.select(S.CUSTOMER, "Latest_CM").join(
            new_predictions.select(S.CUSTOMER, F.col("predicted_margin").alias(name)), S.CUSTOMER)
    base = baseline_match(live, history, flow, fallback)
    joined = scored.join(base.select(S.CUSTOMER, F.col("avg_cm_imputed").alias("current_model")), S.CUSTOMER)
    return smape(joined, {name: name, "current_model": "current_model"})


def smape_model(live: DataFrame, history: DataFrame, weights: DataFrame, flow: S.Flow = S.US_FLOW, fallback=None) -> DataFrame:
    """C8 with a model: the linear model of ``weights`` (fitted or given) and the mean
    margin, each paired with the incumbent baseline on the same customers.

    The scoring table carries the model's inputs and the outcome, so the model is applied
    to it row by row; one join brings the baseline."""
    feats = scoring_features(live, history, flow)
    scored = score_linear(feats, weights, keep=[F.col("Latest_CM"), F.col("avg_imputed_contribution_margin").alias(PROXY)])
    base = baseline_match(live, history, flow, fallback).select(S.CUSTOMER, F.col("avg_cm_imputed").alias("current_model"))
    joined = scored.withColumnRenamed("predicted_margin", "linear_model").join(base, S.CUSTOMER)
    return smape_paired(joined, ["linear_model", PROXY], "current_model")
