"""Command-line jobs: the source's workflow as batch runs over real tables.

    python -m marginkit.jobs training  --live PATH --out DIR [--country USA] [--fit-on all|train]
    python -m marginkit.jobs fit       --live PATH --out DIR [--training PATH]
    python -m marginkit.jobs score     --model DIR --features PATH --out DIR
    python -m marginkit.jobs scoring   --live PATH --history PATH --out DIR [--country USA]
    python -m marginkit.jobs all-customers --live PATH --out DIR [--country CAN]
    python -m marginkit.jobs compare   --live PATH --history PATH --cohort CSV_DIR --out DIR [--predictions PATH]
    python -m marginkit.jobs demo      --sf-dir /root/testdata/sf0.01 --out DIR

Inputs are Parquet paths (or catalog tables with ``--table``) in the purchase
schema; ``history`` carries ``last_update_timestamp``. Every output is written by
the executors (Parquet, plus headered CSV where the source hands a file to
another tool). Dates default to ``--calendar test``; ``--calendar reference``
uses the source's own periods.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import plans
from . import schema as S
from .operators.baseline import cohort_match
from .operators.evaluate import smape
from .operators.quality import value_counts
from .operators.score import fit_margin_model, load_model, save_model, score_margin
from .operators.split import split_parts
from .plans.views import sorted_output
from .session import build_session, drop_scratch
from .sources import adapter
from .sources.tables import bad_cohort_rows, read_cohort_csv, read_table, write_table

# The source's own periods (history 2003-2021, cut at the end of 2017,
# snapshot of 2022-01-02 holding purchases to 2021-12-31, outcomes from 2022, recent year 2021).
REFERENCE_CALENDAR = S.Calendar(
    history_start=dt.date(2003, 1, 1), history_end=dt.date(2021, 12, 31), cut=dt.date(2017, 12, 31),
    snapshot=dt.date(2022, 1, 2), snapshot_history_end=dt.date(2021, 12, 31),
    outcome_start=dt.date(2022, 1, 1), recent_start=dt.date(2021, 1, 1), recent_end=dt.date(2021, 12, 31))
CALENDARS = {"test": S.TEST_CALENDAR, "reference": REFERENCE_CALENDAR}
COHORT_SCHEMA = ("consumer_id BIGINT, Freq_purchase STRING, avg_imputed_contribution_margin DOUBLE, "
                 "AVERAGE_TIME_TO_PURCHASE STRING, avg_vehicle_age DOUBLE, lease_purchase_flag STRING, "
                 "Latest_CM DECIMAL(18,2)")


def _flow(args) -> S.Flow:
    return S.Flow(args.country, make=args.make, calendar=CALENDARS[args.calendar],
                  household_required=args.country == S.COUNTRY_US)


def _load(spark: SparkSession, path_or_table: str, table: bool) -> DataFrame:
    return spark.table(path_or_table) if table else read_table(spark, path_or_table)


def _save(df: DataFrame, out: str, name: str, csv: bool = False, sort: bool = False) -> str:
    """Write as Parquet; the CSV copy is made from the Parquet just written, so the flow
    runs once. ``sort`` orders the table by customer at the sink (a range-sort shuffle)."""
    path = os.path.join(out, name)
    if sort and S.CUSTOMER in df.columns:
        df = sorted_output(df, S.CUSTOMER)
    write_table(df, path, "parquet")
    if csv:
        stored = read_table(df.sparkSession, path)
        write_table(sorted_output(stored, S.CUSTOMER) if sort and S.CUSTOMER in df.columns else stored, path + "_csv", "csv")
    return path


def run_training(spark, live, flow, out, fit_on="all", sort=False) -> dict:
    """C2 + C3: training and out-of-time test tables (Parquet + CSV for the
    modelling tool), with their value counts and the audit. The medians are fitted once."""
    written = {}
    medians = plans.fit_medians(live, flow, fit_on)
    imputed = plans.imputed_training_rows(live, flow, medians=medians)
    for side, name in (("train", "training_table"), ("test", "test_table")):
        t = plans.training_table(live, flow, side, imputed=imputed)
        written[name] = _save(t, out, name, csv=True, sort=sort)
        written[name + "_value_counts"] = _save(
            value_counts(read_table(spark, written[name]),
                         ["Freq_purchase", "lease_purchase_flag", "AVERAGE_TIME_TO_PURCHASE"]),
            out, name + "_value_counts")
    written["quality_profile"] = _save(plans.training_quality_profile(live, flow, medians), out, "quality_profile")
    return written


def run_fit(spark, live, flow, out, fit_on="all", training: str | None = None) -> dict:
    """Fit the margin model on a stored training table (made first if none is named)
    and store it."""
    path = training or run_training(spark, live, flow, out, fit_on)["training_table"]
    model = fit_margin_model(read_table(spark, path))
    save_model(model, os.path.join(out, "margin_model"))
    return {"training_table": path, "margin_model": os.path.join(out, "margin_model")}


def run_score(spark, model_path, features_path, out) -> dict:
    """Predictions of a stored model for a stored feature table."""
    scored = score_margin(load_model(model_path), read_table(spark, features_path))
    return {"predictions": _save(scored, out, "predictions", csv=True)}


def run_scoring(spark, live, history, flow, out, n_parts=3, sort=False) -> dict:
    """Scoring features with the actual outcome (the cohort file read by the
    comparison), the table cut into parts as the source exports it, and the audit."""
    written = {"scoring_features": _save(plans.scoring_features(live, history, flow), out, "scoring_features", csv=True, sort=sort)}
    feats = read_table(spark, written["scoring_features"])
    parts = split_parts(feats, n_parts)
    written["scoring_parts"] = os.path.join(out, "scoring_parts")
    write_table(parts, written["scoring_parts"], "csv", partition_by=["part"])
    written["scoring_profile"] = _save(plans.scoring_quality_profile(live, history, flow), out, "scoring_profile")
    return written


def run_all_customers(spark, live, flow, out, sort=False) -> dict:
    """C4: features of every customer, no target."""
    return {"features_all_customers": _save(plans.features_all_customers(live, flow), out,
                                            "features_all_customers", csv=True, sort=sort)}


def run_compare(spark, live, history, cohort_dir, flow, out, fallback=None, predictions: str | None = None) -> dict:
    """Baseline predictions matched to outcomes, restricted to the new model's
    cohort (read from its CSV), the no-margin audit and sMAPE of both models.

    ``predictions`` names a stored table (consumer_id, predicted_margin); without it the
    cohort's mean imputed margin is scored, and named so. The baseline is computed once;
    a customer listed twice in the cohort counts twice, once for each listing."""
    schema = T.DataType.fromDDL(COHORT_SCHEMA)
    cohort = read_cohort_csv(spark, cohort_dir, schema)
    written = {"cohort_bad_rows": _save(bad_cohort_rows(spark, cohort_dir, schema), out, "cohort_bad_rows"),
               "baseline_margins": _save(plans.matched_margins(live, history, flow, fallback), out, "baseline_margins")}
    matched = read_table(spark, written["baseline_margins"])
    base = matched.drop("avg_cm")
    in_cohort = cohort_match(matched, cohort)
    written["baseline_match"] = _save(base, out, "baseline_match", csv=True)
    written["baseline_cohort"] = _save(in_cohort.drop("avg_cm"), out, "baseline_cohort")
    written["baseline_audit"] = _save(in_cohort.select(S.CUSTOMER, "avg_cm"), out, "baseline_audit")
    written["baseline_profile"] = _save(plans.baseline_quality_profile(history, flow), out, "baseline_profile")
    if predictions:
        name = "new_model"
        scored = cohort.select(S.CUSTOMER, "Latest_CM").join(
            read_table(spark, predictions).select(S.CUSTOMER, F.col("predicted_margin").alias(name)), S.CUSTOMER)
    else:
        name = plans.PROXY
        scored = cohort.select(S.CUSTOMER, "Latest_CM", F.col("avg_imputed_contribution_margin").alias(name))
    joined = scored.join(base.select(S.CUSTOMER, F.col("avg_cm_imputed").alias("current_model")), S.CUSTOMER)
    written["smape"] = _save(smape(joined, {name: name, "current_model": "current_model"}), out, "smape")
    return written


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="marginkit.jobs")
    p.add_argument("job", choices=["training", "fit", "score", "scoring", "all-customers", "compare", "demo"])
    p.add_argument("--live"), p.add_argument("--history"), p.add_argument("--cohort")
    p.add_argument("--training", help="fit: a stored training table")
    p.add_argument("--model"), p.add_argument("--features"), p.add_argument("--predictions")
    p.add_argument("--table", action="store_true", help="--live/--history name catalog tables")
    p.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    p.add_argument("--out", required=True)
    p.add_argument("--country", default=S.COUNTRY_US)
    p.add_argument("--make", default=S.TEST_MAKE)
    p.add_argument("--calendar", choices=sorted(CALENDARS), default="test")
    p.add_argument("--fit-on", choices=["all", "train"], default="all")
    p.add_argument("--fallback", type=float, default=None, help="constant baseline fallback (default: recent mean)")
    p.add_argument("--master", default=None)
    p.add_argument("--sorted", action="store_true", help="order final tables by consumer_id at the sink")
    args = p.parse_args(argv)

    spark = build_session(args.master)
    flow = _flow(args)
    if args.job == "demo":
        live, history = adapter.ownership(spark, args.sf_dir), adapter.ownership_history(spark, args.sf_dir)
        us = S.Flow(S.COUNTRY_US)
        out = os.path.join(args.out, "us")
        written = run_training(spark, live, us, out, args.fit_on, args.sorted)
        written.update(run_fit(spark, live, us, out, training=written["training_table"]))
        written.update(run_scoring(spark, live, history, us, out, sort=args.sorted))
        written.update(run_score(spark, written["margin_model"], written["scoring_features"], out))
        written.update(run_compare(spark, live, history, written["scoring_features"] + "_csv", us, out, args.fallback,
                                   written["predictions"]))
        written["second_country"] = run_all_customers(spark, live, S.SECOND_FLOW, os.path.join(args.out, "second"), args.sorted)
    elif args.job == "score":
        written = run_score(spark, args.model, args.features, args.out)
    else:
        live = _load(spark, args.live, args.table) if args.live else None
        history = _load(spark, args.history, args.table) if args.history else None
        if args.job == "training":
            written = run_training(spark, live, flow, args.out, args.fit_on, args.sorted)
        elif args.job == "fit":
            written = run_fit(spark, live, flow, args.out, args.fit_on, args.training)
        elif args.job == "scoring":
            written = run_scoring(spark, live, history, flow, args.out, sort=args.sorted)
        elif args.job == "all-customers":
            written = run_all_customers(spark, live, flow, args.out, args.sorted)
        else:
            written = run_compare(spark, live, history, args.cohort, flow, args.out, args.fallback, args.predictions)
    drop_scratch(spark)
    print(json.dumps(written, indent=1))


if __name__ == "__main__":
    main()
