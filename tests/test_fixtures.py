"""Micro-fixtures with hand-computed answers (FIXTURES.md section 3)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import purchase
from marginkit import schema as S
from marginkit.functions.columns import sMAPE_term
from marginkit.operators import (
    baseline_imputed, baseline_margin, clean_ownership, cohort_match, first_outcome, history_profile,
    impute_zero_margin, rank_newest, split_parts, split_side,
)
from marginkit.operators.features import feature_columns, with_target


def _imputed(df):
    return {(r.vin, r.contribution_margin) for r in impute_zero_margin(df).collect()}


def test_median_even_takes_lower_element(make_rows):
    rows = [purchase(1, "2019-01-0%d" % i, vin=f"v{i}", margin=m) for i, m in
            enumerate(["10.00", "20.00", "30.00", "40.00"], 1)]
    rows.append(purchase(2, "2019-02-01", vin="z", margin="0"))
    got = _imputed(make_rows(rows))
    assert ("z", Decimal("20.00")) in got and len(got) == 5


def test_median_missing_group_drops_zero_row(make_rows):
    rows = [purchase(1, "2019-01-01", vin="a", model="A"), purchase(2, "2019-01-01", vin="z", model="B", margin="0")]
    assert {v for v, _ in _imputed(make_rows(rows))} == {"a"}


def test_null_margin_in_neither_set(make_rows):
    rows = [purchase(1, "2019-01-01", vin="a"), purchase(2, "2019-01-01", vin="n", margin=None)]
    assert {v for v, _ in _imputed(make_rows(rows))} == {"a"}


def test_trimmed_key_matches(make_rows):
    rows = [purchase(1, "2019-01-01", vin="a", model="A", margin="50.00"),
            purchase(2, "2019-03-01", vin="z", model=" A ", margin="0")]
    assert ("z", Decimal("50.00")) in _imputed(make_rows(rows))


def test_year_bad_values(make_rows):
    rows = [purchase(1, "2019-01-01", vin=v, model_year=y) for v, y in
            [("a", "2019.0"), ("b", "abc"), ("c", " 2019 "), ("d", "+2019"), ("e", "99999999999"), ("f", "20.1.9"), ("g", "")]]
    got = {r.vin: r.vehicle_model_year for r in clean_ownership(make_rows(rows)).collect()}
    assert got == {"a": 2019, "b": None, "c": 2019, "d": 2019, "e": None, "f": None, "g": None}


def _profile(make_rows, rows, lifestage=True):
    df = clean_ownership(make_rows(rows))
    return {r.consumer_id: r for r in feature_columns(history_profile(df, with_lifestage=lifestage)).collect()}


def _ranked(make_rows, rows):
    return {r.vin: r.ROW_numbering for r in rank_newest(clean_ownership(make_rows(rows))).collect()}


def test_anchor_drops_used_after_newest_new(make_rows):
    rows = [purchase(1, "2019-05-01", vin="u1", cycle=2), purchase(1, "2019-04-01", vin="u2", cycle=2),
            purchase(1, "2019-03-01", vin="n", cycle=1), purchase(1, "2019-02-01", vin="u3", cycle=3)]
    assert _ranked(make_rows, rows) == {"n": 1, "u3": 2}


def test_anchor_tie_keeps_same_day_peers(make_rows):
    rows = [purchase(1, "2019-05-01", vin="a", cycle=1), purchase(1, "2019-05-01", vin="b", cycle=2),
            purchase(1, "2018-01-01", vin="c", cycle=2)]
    assert _ranked(make_rows, rows) == {"a": 1, "b": 2, "c": 3}


def test_anchor_none_and_one_purchase_disappear(make_rows):
    rows = [purchase(1, "2019-05-01", cycle=2), purchase(1, "2018-05-01", cycle=3),
            purchase(2, "2019-05-01", cycle=1)]
    assert _profile(make_rows, rows) == {}


def test_two_purchases_use_the_older_one(make_rows):
    rows = [purchase(1, "2019-05-01", vin="new", margin="900.00", age=1, lifestage="LATEST"),
            purchase(1, "2015-05-01", vin="old", margin="300.00", age=7, lifestage="OLDER", lease=1)]
    df = clean_ownership(make_rows(rows))
    t = with_target(feature_columns(history_profile(df))).collect()[0]
    assert (t.Freq_purchase, t.AVERAGE_TIME_TO_PURCHASE, t.avg_vehicle_age, t.lease_purchase_flag) == \
        ("One", "Purchased_only_once", 7.0, "One")
    assert t.avg_imputed_contribution_margin == 300.0 and t.Latest_CM == 900.0 and t.Latest_CM_purchase_year == 2019
    assert _profile(make_rows, rows)[1].lifestage_value == "OLDER"


def test_recency_edges_exact_days(make_rows):
    base = dt.date(2010, 1, 1)
    rows = []
    for cid, gap in [(1, 0), (2, 1095), (3, 1825), (4, 1826)]:
        rows += [purchase(cid, base + dt.timedelta(days=gap + 5000), vin=f"l{cid}"),
                 purchase(cid, base + dt.timedelta(days=gap), vin=f"p{cid}"),
                 purchase(cid, base, vin=f"q{cid}")]
    got = {c: r.AVERAGE_TIME_TO_PURCHASE for c, r in _profile(make_rows, rows).items()}
    assert got == {1: "Repurchased_WITHIN_3_yrs", 2: "Repurchased_WITHIN_3_yrs",
                   3: "Repurchased_BTWN_3_5_yrs", 4: "Repurchased_AFTER_5_yrs"}


def test_frequency_edges(make_rows):
    rows = []
    for cid, n_prior in [(1, 1), (2, 2), (3, 3), (4, 4)]:
        rows += [purchase(cid, dt.date(2019, 1, 1) - dt.timedelta(days=30 * i), vin=f"{cid}-{i}") for i in range(n_prior + 1)]
    df = clean_ownership(make_rows(rows))
    got = {r.consumer_id: r.Freq_purchase for r in with_target(feature_columns(history_profile(df))).collect()}
    assert got == {1: "One", 2: "Two", 3: "Three", 4: "More_than_Three"}


def test_lease_null_gives_one(make_rows):
    rows = [purchase(1, "2019-01-01", lease=None, vin="a"), purchase(1, "2018-01-01", lease=None, vin="b")]
    df = clean_ownership(make_rows(rows))
    assert with_target(feature_columns(history_profile(df))).collect()[0].lease_purchase_flag == "One"


def test_date_tie_rank_lower_vin_first(make_rows):
    rows = [purchase(1, "2019-01-01", vin="B"), purchase(1, "2019-01-01", vin="A")]
    assert _ranked(make_rows, rows) == {"A": 1, "B": 2}


def test_outcome_first_takes_earlier(make_rows):
    rows = [purchase(1, "2020-06-01", margin="5.00", vin="x"), purchase(1, "2020-02-01", margin="7.00", vin="y")]
    assert first_outcome(make_rows(rows)).collect()[0].Latest_CM == Decimal("7.00")


def test_baseline_fill_uses_fallback(spark, make_rows):
    rows = [purchase(1, "2019-01-01", margin="0"), purchase(1, "2019-02-01", margin=None, vin="n"),
            purchase(2, "2019-01-01", margin="10.00")]
    src = make_rows(rows).withColumn(S.CUSTOMER_TYPE, F.lit("I"))
    got = {r.consumer_id: r.avg_cm_imputed for r in baseline_imputed(baseline_margin(src), 42.5).collect()}
    assert got == {1: 42.5, 2: 10.0}


def test_cohort_duplicates_multiply(spark):
    matched = spark.createDataFrame([(1, 5.0, 6.0)], "consumer_id long, avg_cm_imputed double, Latest_CM double")
    cohort = spark.createDataFrame([(1,), (1,)], "consumer_id long")
    assert cohort_match(matched, cohort).count() == 2


def test_split_invariant_under_partitioning(make_rows):
    rows = [purchase(i, "2019-01-01", vin=f"v{i}") for i in range(300)]
    sides = []
    for p in (2, 3, 7):
        df = make_rows(rows, partitions=p)
        tr = {r.consumer_id for r in split_side(df, "train").collect()}
        te = {r.consumer_id for r in split_side(df, "test").collect()}
        assert not tr & te and len(tr | te) == 300
        sides.append((tr, te))
    assert sides[0] == sides[1] == sides[2]


def test_parts_exact_sizes(spark):
    df = spark.range(10).withColumnRenamed("id", "consumer_id").repartition(3)
    sizes = sorted(r["count"] for r in split_parts(df, 3).groupBy("part").count().collect())
    assert sizes == [3, 3, 4]
    bigger = spark.range(1001).withColumnRenamed("id", "consumer_id").repartition(5)
    parts = split_parts(bigger, 3).collect()
    assert len({r.consumer_id for r in parts}) == 1001
    assert sorted(r["count"] for r in split_parts(bigger, 3).groupBy("part").count().collect()) == [333, 334, 334]


def test_smape_zero_term(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "p double, a double")
    got = [r.t for r in df.select(sMAPE_term(F.col("p"), F.col("a")).alias("t")).collect()]
    assert got == [0.0, 1.0]
