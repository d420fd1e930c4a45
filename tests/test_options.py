"""Options and fallbacks: leak-free medians, constant baseline fallback, the
shuffle path of the size-checked join, audits, and the batch jobs."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import purchase
from marginkit import plans
from marginkit import schema as S
from marginkit.jobs import run_training
from marginkit.operators import impute_zero_margin, join_checked, summary_stats, value_counts
from marginkit.operators.clean import clean_ownership
from marginkit.sources import adapter
from marginkit.sources.extract import extract_ownership

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def live(spark):
    return adapter.ownership(spark, SF)


def test_fit_on_train_uses_training_rows_only(spark, live):
    flow = S.US_FLOW
    imputed = plans.imputed_training_rows(live, flow, fit_on="train").toPandas()
    ex = clean_ownership(extract_ownership(live, flow.training_extract())).toPandas()
    train_ids = set(spark.createDataFrame(ex[["consumer_id"]].drop_duplicates()).where(
        F.pmod(F.conv(F.substring(F.md5(F.col("consumer_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100)) < 70
    ).toPandas()["consumer_id"])
    fit = ex[(ex.contribution_margin != 0) & ex.consumer_id.isin(train_ids)
             & (pd.to_datetime(ex.acquisition_date) <= pd.Timestamp(flow.calendar.cut))]
    med = {}
    for key, g in fit.groupby(["vehicle_model", "acquisition_year"]):
        vals = sorted(g.contribution_margin)
        med[key] = vals[(len(vals) + 1) // 2 - 1]  # lower median, an element
    zeros = ex[ex.contribution_margin == 0]
    want = {r.vin: med[(r.vehicle_model, r.acquisition_year)] for r in zeros.itertuples()
            if (r.vehicle_model, r.acquisition_year) in med}
    got = imputed[imputed.vin.isin(list(zeros.vin))]
    assert dict(zip(got.vin, got.contribution_margin)) == want
    assert len(imputed) == (ex.contribution_margin != 0).sum() + len(want)


def test_constant_fallback(spark):
    hist = adapter.ownership_history(spark, "/root/testdata/sf0.01")  # has customers without a known margin
    const = float(S.FALLBACK_MARGIN_US)
    base = plans.baseline_predictions(hist, S.US_FLOW, fallback=const)
    raw = plans.baseline_predictions(hist, S.US_FLOW)
    from marginkit.operators.baseline import baseline_margin
    no_margin = baseline_margin(plans.flows.baseline_extract(hist, S.US_FLOW)).where("avg_cm is null")
    ids = [r.consumer_id for r in no_margin.collect()]
    assert ids, "fixture needs customers without a known margin"
    got = {r.consumer_id: r.avg_cm_imputed for r in base.where(F.col("consumer_id").isin(ids)).collect()}
    assert set(got.values()) == {const}
    assert base.count() == raw.count()


def test_checked_join_shuffle_path_equals_broadcast(make_rows):
    rows = [purchase(i % 7, "2019-01-0%d" % (1 + i % 9), vin=f"v{i}", model="AB"[i % 2],
                     margin="0" if i % 5 == 0 else f"{10 + i}.00") for i in range(200)]
    ex = make_rows(rows)
    small = sorted(map(tuple, impute_zero_margin(ex).collect()))
    large = sorted(map(tuple, impute_zero_margin(ex, max_broadcast_rows=0).collect()))
    assert small == large and len(small) > 150
    plain = make_rows(rows).select("consumer_id").distinct()
    assert join_checked(plain, plain, "consumer_id", max_rows=0).count() == 7


def test_value_counts_and_summary(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", None)], "consumer_id long, band string, x double")
    vc = {(r.column, r.value): r["count"] for r in value_counts(df, ["band"]).collect()}
    assert vc == {("band", "a"): 2, ("band", "b"): 1}
    st = {(r.column, r.statistic): r.value for r in summary_stats(df, ["x", "band"]).collect()}
    assert [st["x", k] for k in ("count", "mean", "min", "max", "p50")] == ["2", "2.000000", "1.000000", "3.000000", "1.000000"]
    assert [st["band", k] for k in ("count", "mean", "min", "max", "p50")] == ["3", None, "a", "b", None]


def _median_fits(monkeypatch):
    """Count the median aggregates that are built."""
    from marginkit.operators import impute
    fits = []
    real = impute.group_median

    def counted(*args, **kwargs):
        fits.append(1)
        return real(*args, **kwargs)
    for module in (impute, plans.flows):
        monkeypatch.setattr(module, "group_median", counted)
    return fits


def test_training_job_writes_tables_and_fits_medians_once(spark, live, monkeypatch):
    fits = _median_fits(monkeypatch)
    out = tempfile.mkdtemp(prefix="marginkit-job-")
    written = run_training(spark, live, S.US_FLOW, out)
    assert len(fits) == 1
    n = spark.read.parquet(written["training_table"]).count()
    assert n == plans.training_table(live).count() and n > 0
    csv = spark.read.option("header", True).csv(written["training_table"] + "_csv")
    assert csv.count() == n
    assert os.path.isdir(written["quality_profile"])


@pytest.fixture(scope="module")
def jobs_run(spark, live):
    """fit, scoring and score on the small tables."""
    from marginkit.jobs import run_fit, run_score, run_scoring
    hist = adapter.ownership_history(spark, SF)
    out = tempfile.mkdtemp(prefix="marginkit-job-")
    written = run_fit(spark, live, S.US_FLOW, out)
    written.update(run_scoring(spark, live, hist, S.US_FLOW, out))
    written.update(run_score(spark, written["margin_model"], written["scoring_features"], out))
    return hist, written


def test_scoring_and_compare_jobs(spark, live, jobs_run):
    from marginkit.jobs import run_compare
    hist, written = jobs_run
    n = spark.read.parquet(written["scoring_features"]).count()
    parts = spark.read.option("header", True).csv(written["scoring_parts"])
    assert parts.count() == n and sorted(r.part for r in parts.select("part").distinct().collect()) == [1, 2, 3]
    cmp = run_compare(spark, live, hist, written["scoring_features"] + "_csv", S.US_FLOW, tempfile.mkdtemp())
    rows = {r.model: r for r in spark.read.parquet(cmp["smape"]).collect()}
    want = {r.model: r for r in plans.smape_compare(live, hist, S.US_FLOW).collect()}
    assert rows.keys() == want.keys() == {"mean_margin_proxy", "current_model"}
    for m in rows:
        assert rows[m].customers == want[m].customers
        assert abs(rows[m].smape - want[m].smape) < 1e-6


def test_fitted_model_is_finite_unbiased_and_better_than_the_mean(spark, jobs_run):
    from marginkit.operators.score import load_model, score_margin
    _, written = jobs_run
    train = spark.read.parquet(written["training_table"])
    scored = score_margin(load_model(written["margin_model"]), train).join(train.select("consumer_id", "Latest_CM"), "consumer_id").toPandas()
    assert len(scored) == train.count() and scored.predicted_margin.notna().all()
    residual = scored.predicted_margin - scored.Latest_CM
    assert abs(residual.mean()) < 0.01 * scored.Latest_CM.mean()
    assert (residual ** 2).mean() < ((scored.Latest_CM - scored.Latest_CM.mean()) ** 2).mean()


def test_compare_scores_the_model_and_counts_a_repeated_cohort_row_twice(spark, live, jobs_run):
    from marginkit.jobs import run_compare
    hist, written = jobs_run
    cohort = spark.read.option("header", True).csv(written["scoring_features"] + "_csv")
    path = tempfile.mkdtemp() + "/cohort"
    cohort.unionByName(cohort.limit(1)).select(*reversed(cohort.columns)).write.option("header", True).csv(path)
    cmp = run_compare(spark, live, hist, path, S.US_FLOW, tempfile.mkdtemp(), predictions=written["predictions"])
    rows = {r.model: r for r in spark.read.parquet(cmp["smape"]).collect()}
    assert rows.keys() == {"new_model", "current_model"}
    n = spark.read.parquet(cmp["baseline_cohort"]).count()
    assert {r.customers for r in rows.values()} == {n} == {cohort.count() + 1}
    bad = spark.read.parquet(cmp["cohort_bad_rows"]).first()
    assert bad.n_rows == n and bad.n_without_id == 0


def test_cohort_csv_is_read_by_name_and_bad_values_are_counted(spark):
    from pyspark.sql import types as T
    from marginkit.sources import bad_cohort_rows, read_cohort_csv
    path = tempfile.mkdtemp() + "/c"
    os.mkdir(path)
    with open(path + "/a.csv", "w") as f:
        f.write("x,consumer_id,more\n1.5,7,z\n,8,z\nbad,nine,z\n")
    schema = T.DataType.fromDDL("consumer_id BIGINT, x DOUBLE")
    assert sorted(map(tuple, read_cohort_csv(spark, path, schema).collect()), key=str) == [(7, 1.5), (8, None), (None, None)]
    r = bad_cohort_rows(spark, path, schema).first()
    assert (r.n_rows, r.n_without_id, r.bad_consumer_id, r.bad_x) == (3, 1, 1, 1)


def test_zero_is_tested_on_the_stored_margin(spark, make_rows):
    rows = [purchase(i, "2019-01-01", vin=f"v{i}") for i in range(3)]
    margins = F.when(F.col("vin") == "v0", 100.0).when(F.col("vin") == "v1", 0.004).otherwise(0.0)
    ex = make_rows(rows).withColumn(S.MARGIN, margins)
    got = {r.vin: float(r.contribution_margin) for r in impute_zero_margin(ex).collect()}
    assert got == {"v0": 100.0, "v1": 0.0, "v2": 0.0}  # v2 takes the lower median of 0.00 and 100.00


def test_missing_age_is_not_a_new_vehicle(spark):
    from marginkit.operators.score import _prepare
    df = spark.createDataFrame([(1, "One", "x", "Zero", 5.0, None), (2, "One", "x", "Zero", None, 0.0)],
                               "consumer_id long, Freq_purchase string, AVERAGE_TIME_TO_PURCHASE string, lease_purchase_flag string, "
                               "avg_imputed_contribution_margin double, avg_vehicle_age double")
    got = [(r.avg_vehicle_age__d, r.avg_vehicle_age__missing) for r in _prepare(df).orderBy("consumer_id").collect()]
    assert got == [(0.0, 1.0), (0.0, 0.0)]


def test_parts_by_refined_histogram_equal_ranks(spark, monkeypatch):
    from marginkit.operators import split
    df = spark.range(1000).withColumnRenamed("id", "consumer_id")
    want = sorted((r._k, r.consumer_id) for r in df.select("consumer_id", split.order_key().alias("_k")).collect())
    for exact in (100_000, 1):
        monkeypatch.setattr(split, "EXACT_ROWS", exact)
        monkeypatch.setattr(split, "CELL_BITS", 12 if exact > 1 else 3)
        got = {r.consumer_id: r.part for r in split.split_parts(df.repartition(5), 3).collect()}
        assert [got[c] for _, c in want] == [1] * 333 + [2] * 333 + [3] * 334
    assert split.split_parts(df.limit(0), 3).count() == 0 and {r.part for r in split.split_parts(df.limit(1), 3).collect()} == {3}
