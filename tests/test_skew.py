"""A third of all rows on one customer: the skew-safe history plan must give the
same features as the literal window formulation (DuckDB), and its
customer-partitioned windows only ever see that customer's day rows."""

import duckdb
from pyspark.sql import functions as F

from marginkit import oracle
from marginkit import schema as S
from marginkit.operators import clean_ownership, day_summary, history_profile
from marginkit.operators.features import feature_columns

N = 150_000
HOT = 999_999


def _rows(spark):
    i = F.col("id")
    h = lambda k: F.pmod(F.hash(i, F.lit(k)), F.lit(1 << 30))
    return spark.range(N).select(
        F.concat(F.lit("V"), i.cast("string")).alias(S.VIN),
        F.when(i % 3 == 0, F.lit(HOT)).otherwise(i % 20000).cast("long").alias(S.CUSTOMER),
        (h(1) % 3 + 1).cast("int").alias(S.CYCLE),
        F.lit("M").alias(S.MODEL), F.lit("2010").alias(S.MODEL_YEAR),
        F.date_add(F.lit("2005-01-01").cast("date"), (h(2) % 2500).cast("int")).alias(S.DATE),
        F.lit(2010).alias(S.YEAR),
        F.when(h(3) % 10 == 0, F.lit(None)).otherwise(h(3) % 15).cast("int").alias(S.AGE),
        F.when(h(4) % 7 == 0, F.lit(None)).otherwise(h(4) % 2).cast("int").alias(S.LEASE),
        F.element_at(F.array(F.lit("CAR"), F.lit("SUV"), F.lit("TRUCK")), (h(5) % 3 + 1).cast("int")).alias(S.PLATFORM),
        F.concat(F.lit("L"), (h(6) % 4).cast("string")).alias(S.LIFESTAGE),
        ((h(7) % 5_000_000 + 1) / 100).cast("decimal(18,2)").alias(S.MARGIN),
    )


def test_hot_customer_features_match_literal_windows(spark):
    _assert_features_match_literal_windows(spark, _rows(spark))


def test_hot_anchor_day_lifestage_matches_literal_windows(spark):
    """Half of the hot customer's rows (a sixth of all rows) on its newest day, so
    the lifestage is the second-lowest vin of a 25,000-row anchor day, found by
    the two-rows-per-day limit instead of a window over the whole day."""
    raw = _rows(spark)
    hot_day = (F.col(S.CUSTOMER) == HOT) & (F.substring(F.col(S.VIN), -1, 1).isin("0", "2", "4", "6", "8"))
    raw = raw.withColumn(S.DATE, F.when(hot_day, F.lit("2013-01-01").cast("date")).otherwise(F.col(S.DATE)))
    got = _assert_features_match_literal_windows(spark, raw)
    assert got[HOT].lifestage_value is not None


def _assert_features_match_literal_windows(spark, raw):
    rows = clean_ownership(raw).repartition(16)
    got = {r.consumer_id: r for r in feature_columns(history_profile(rows, with_lifestage=True)).collect()}

    pdf = raw.toPandas()
    pdf["contribution_margin"] = pdf["contribution_margin"].astype(str)
    con = duckdb.connect()
    con.register("raw", pdf)
    sql = ("with tr as (select vin, consumer_id, vehicle_ownership_cycle_num, vehicle_model, vehicle_model_year, "
           "cast(acquisition_date as date) as acquisition_date, acquisition_year, vehicle_age, fmcc_lease_purchase_ind, "
           "platform, lifestage_value, cast(contribution_margin as decimal(18,2)) as contribution_margin from raw)"
           + oracle.history_ctes("tr") + "\nselect * from comb")
    want = {int(r[0]): r for r in con.execute(sql).fetchall()}
    assert set(got) == set(want) and HOT in got
    cols = ["consumer_id", "freq_excluding_latest", "avg_contribution_margin_new", "AVERAGE_TIME_TO_PURCHASE",
            "seg_car", "seg_suv", "seg_truck", "avg_vehicle_age", "no_of_lease_purchases", "lifestage_value"]
    for cid, w in want.items():
        g = got[cid]
        assert tuple(g[c] for c in cols) == tuple(w), (cid, g, w)
    assert got[HOT].freq_excluding_latest > 40_000
    return got


def test_hot_customer_window_groups_are_calendar_bounded(spark):
    rows = clean_ownership(_rows(spark))
    per_customer = day_summary(rows).groupBy(S.CUSTOMER).count()
    biggest = per_customer.agg(F.max("count")).first()[0]
    hot_rows = rows.where(F.col(S.CUSTOMER) == HOT).count()
    assert hot_rows == N // 3
    assert biggest <= 2500 < hot_rows  # the window sees days, not the 50,000 rows


def _hot_day_rows(spark, n=40_000):
    """A third of the rows on one (customer, day), plus a hot day with no date;
    vins repeat inside the hot day so the margin (NULLs first) breaks ties."""
    i = F.col("id")
    h = lambda k: F.pmod(F.hash(i, F.lit(k)), F.lit(1 << 30))
    hot = i % 3 == 0
    no_date = i % 3 == 1
    return spark.range(n).select(
        F.when(hot, F.concat(F.lit("V"), (i % 5000).cast("string")))
         .otherwise(F.concat(F.lit("W"), i.cast("string"))).alias(S.VIN),
        F.when(hot | (no_date & (i % 2 == 1)), F.lit(HOT)).otherwise(i % 3000).cast("long").alias(S.CUSTOMER),
        (h(1) % 3 + 1).cast("int").alias(S.CYCLE),
        F.lit("M").alias(S.MODEL), F.lit("2010").alias(S.MODEL_YEAR),
        F.when(hot, F.lit("2015-06-01").cast("date"))
         .when(no_date & (i % 2 == 1), F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit("2005-01-01").cast("date"), (h(2) % 2500).cast("int"))).alias(S.DATE),
        F.lit(2010).alias(S.YEAR),
        (h(3) % 15).cast("int").alias(S.AGE), (h(4) % 2).cast("int").alias(S.LEASE),
        F.lit("CAR").alias(S.PLATFORM), F.lit("L1").alias(S.LIFESTAGE),
        F.when(hot & (i % 5000 == i % 15000), F.lit(None))
         .otherwise((i + 100) / 100).cast("decimal(18,2)").alias(S.MARGIN),
    )


def test_hot_day_rank_equals_window_rank(spark, monkeypatch):
    """Row-level history with hot days ranked by range partitioning (threshold
    1,000 rows) equals the plain in-day window (no day counts as hot)."""
    from marginkit.operators import history as H
    rows = clean_ownership(_hot_day_rows(spark)).repartition(16)
    cols = [S.CUSTOMER, S.VIN, S.MARGIN, S.DATE, "grp", "ROW_numbering", "no_of_purc"]

    def run(limit):
        monkeypatch.setattr(H, "HOT_DAY_ROWS", limit)
        ranked = H.history_rows(rows).select(*cols, "_wd")
        gaps = H.purchase_gaps(rows)
        return sorted(map(tuple, ranked.collect()), key=repr), sorted(map(tuple, gaps.collect()), key=repr)

    hot = H._hot_days(H._day_counts(rows), 1000)
    assert hot is not None and hot.count() == 2  # the dated and the undated hot day
    hot_ranked, hot_gaps = run(1000)
    plain_ranked, plain_gaps = run(10 ** 9)
    assert len(hot_ranked) == rows.count()
    assert hot_ranked == plain_ranked
    assert hot_gaps == plain_gaps
    hot_day = [r for r in hot_ranked if r[0] == HOT and r[3] is not None and str(r[3]) == "2015-06-01"]
    assert sorted(r[-1] for r in hot_day) == list(range(1, len(hot_day) + 1))


def test_row_level_match_back_splits_the_hot_customer(spark, monkeypatch):
    """Above the broadcast bound, the row-level match-back joins two plain shuffle
    stages, so AQE splits the hot customer's partition; the rows equal a plain join."""
    from marginkit.operators import baseline as B
    from marginkit.operators import history as H
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "32",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    saved = {k: spark.conf.get(k, None) for k in conf}
    monkeypatch.setattr(B, "MATCH_BACK_BROADCAST_ROWS", 0)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = clean_ownership(_rows(spark))
        outcome = H.first_outcome(rows.where(F.col(S.DATE) >= "2010-01-01"))
        df = B.match_back(rows, outcome, rows=True)
        got = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan, plan
        plain = rows.join(outcome.select(S.CUSTOMER, "Latest_CM"), S.CUSTOMER).select(*df.columns)
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_days_stay_within_the_broadcast_bound(spark, monkeypatch):
    """With more hot days than the bound, the limit rises to ceil(rows / bound):
    here 20,000 rows in two hot days and a bound of 1 leave 13,333 < 20,000, so
    none is hot, and the window path still gives the same numbers."""
    from marginkit.operators import history as H
    from marginkit.operators import joins
    rows = clean_ownership(_hot_day_rows(spark))
    monkeypatch.setattr(joins, "DEFAULT_BROADCAST_ROWS", 1)
    assert H._hot_days(H._day_counts(rows), 1000) is None
    monkeypatch.setattr(joins, "DEFAULT_BROADCAST_ROWS", 2)
    assert H._hot_days(H._day_counts(rows), 1000).count() == 2


def test_hot_days_are_cut_out_before_the_shuffle(spark, monkeypatch):
    """With hot days present, the normal rows are cut by a broadcast anti join on
    the bounded hot-day keys (map side), before any shuffle. (The hot branch is
    checkpointed after its range sort, so its broadcast semi joins ran inside
    that materialization and are not part of this plan.)"""
    from marginkit.operators import history as H
    monkeypatch.setattr(H, "HOT_DAY_ROWS", 1000)
    df = H.history_rows(clean_ownership(_hot_day_rows(spark)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert any("BroadcastHashJoin" in line and "LeftAnti" in line for line in plan.splitlines()), plan
    for line in plan.splitlines():
        if "SortMergeJoin" in line or "ShuffledHashJoin" in line:
            assert "LeftAnti" not in line and "LeftSemi" not in line, line
