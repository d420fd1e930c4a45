"""Invariants of every flow output (FIXTURES.md section 4) and plan-shape checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marginkit import plans
from marginkit import schema as S
from marginkit.sources import adapter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def live(spark):
    return adapter.ownership(spark, SF)


@pytest.fixture(scope="module")
def hist(spark):
    return adapter.ownership_history(spark, SF)


def _one_row_per_customer(df):
    return df.count() == df.select(S.CUSTOMER).distinct().count()


def test_tables_have_one_row_per_customer(live, hist):
    for df in (plans.training_table(live), plans.training_table(live, side="test"),
               plans.features_all_customers(live), plans.scoring_features(live, hist),
               plans.baseline_match(live, hist)):
        assert _one_row_per_customer(df)


def test_no_null_margin_after_imputation(live):
    imp = plans.imputed_training_rows(live, S.US_FLOW)
    assert imp.where(F.col(S.MARGIN).isNull() | (F.col(S.MARGIN) == 0)).count() == 0


def test_train_test_disjoint_and_cut(live):
    tr = plans.side_rows(live, S.US_FLOW, "train")
    te = plans.side_rows(live, S.US_FLOW, "test")
    cut = S.TEST_CALENDAR.cut
    assert tr.where(F.col(S.DATE) > F.lit(cut)).count() == 0
    assert te.where(F.col(S.DATE) <= F.lit(cut)).count() == 0
    assert tr.select(S.CUSTOMER).intersect(te.select(S.CUSTOMER)).count() == 0


def test_result_unchanged_under_repartitioning(spark, live):
    a = sorted(map(tuple, plans.training_table(live).collect()))
    b = sorted(map(tuple, plans.training_table(live.repartition(7)).collect()))
    assert a == b


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extract_pushes_filters_and_prunes_columns(spark, live):
    import tempfile
    from marginkit.sources.extract import extract_ownership
    path = tempfile.mkdtemp(prefix="marginkit-live-") + "/live"
    live.write.parquet(path)
    flow = S.US_FLOW
    shown = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = _plan(extract_ownership(spark.read.parquet(path), flow.training_extract()).select(S.VIN, S.MARGIN))
    spark.conf.set("spark.sql.maxMetadataStringLength", shown)
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    for part in ("IsNotNull(consumer_id)", "EqualTo(country_code", "EqualTo(vehicle_make", "GreaterThanOrEqual(acquisition_date", "LessThanOrEqual(acquisition_date"):
        assert part in pushed, pushed
    read = plan.split("ReadSchema: struct<")[1]
    assert "platform" not in read and "lifestage_value" not in read and "vehicle_age" not in read


def test_sorted_output_is_in_order(spark, live):
    from marginkit.plans import sorted_output
    rows = [r[0] for r in sorted_output(plans.training_table(live).repartition(9), S.CUSTOMER).select(S.CUSTOMER).collect()]
    assert rows == sorted(rows) and len(rows) > 1


def test_only_customers_who_bought_again_are_grouped(live, hist):
    """A semi join with the raw outcome rows sits below the per-customer aggregate, with no
    aggregate on either side of it, and nothing of customer grain is checkpointed."""
    for df in (plans.scoring_features(live, hist), plans.baseline_match(live, hist)):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        semi = [i for i, line in enumerate(lines) if "Join LeftSemi" in line]
        assert semi, "\n".join(lines)
        above = [line for line in lines[:semi[0]] if "Aggregate [consumer_id" in line]
        assert above, "\n".join(lines)


def test_row_level_history_writes_only_hot_keys(spark, live):
    """row_number_desc and purchase_gaps leave nothing in the checkpoint folder that grows
    with the rows: only the medians and the (here empty) hot-day keys."""
    import os
    from marginkit.operators import history as H
    from marginkit.session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).replace("file:", "")
    rows = plans.side_rows(live, S.US_FLOW, "train")

    def size():
        return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.startswith("part-")}
    before = size()
    for op in (H.rank_newest, H.purchase_gaps):
        op(rows).count()
    assert sum(v for k, v in size().items() if k not in before) < 20_000


def test_flows_plan_no_cross_or_nested_loop_join(live, hist):
    for df in (plans.training_table(live), plans.scoring_features(live, hist), plans.baseline_match(live, hist),
               plans.smape_compare(live, hist)):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_history_windows_run_on_day_grain(live):
    """No window in the training plan is partitioned by the customer over raw rows:
    the only customer-partitioned windows sit above the (customer, day) aggregate."""
    lines = plans.training_table(live)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(lines) if "Window [" in line and "consumer_id" in line]
    assert windows
    for i in windows:
        # the first aggregate, join or scan below the window must be the day-grain aggregate
        below = next(line for line in lines[i + 1:]
                     if any(k in line for k in ("Aggregate [", "Join ", "Relation [")))
        assert "Aggregate [consumer_id" in below and "acquisition_date" in below.split("]")[0], below


def test_in_day_rank_reuses_join_partitioning(live):
    """The row-level history shuffles rows once (for the join back); the in-day
    rank must run on that partitioning, with no exchange in between."""
    from marginkit.operators import history as H
    lines = _plan(H.rank_newest(plans.side_rows(live, S.US_FLOW, "train"))).splitlines()
    i = next(k for k, line in enumerate(lines) if "Window [row_number()" in line and "_dk" in line)
    below = next(line for line in lines[i + 1:] if "Exchange" in line or "SortMergeJoin" in line)
    assert "SortMergeJoin" in below or "BroadcastHashJoin" in below, below


def test_snapshot_extract_prunes_partitions(spark, hist):
    import tempfile
    from marginkit.sources import extract_snapshot, write_history
    path = tempfile.mkdtemp(prefix="marginkit-hist-") + "/history"
    write_history(hist, path)
    stored = spark.read.parquet(path)
    flow = S.US_FLOW
    a = extract_snapshot(stored, flow.calendar.snapshot, flow.snapshot_extract())
    b = extract_snapshot(hist, flow.calendar.snapshot, flow.snapshot_extract())
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    plan = _plan(a)
    assert "PartitionFilters: [isnotnull(snapshot_day" in plan and "(snapshot_day" in plan


def test_lifestage_in_day_rank_is_limited_before_the_shuffle(live):
    """W5 needs the two lowest rows of a day. A partial WindowGroupLimit must run
    below the exchange, so a hot (customer, day) sends at most two rows per map
    task; the join with the day sums must add no exchange of its own."""
    from marginkit.operators import history as H
    df = H.day_summary(plans.side_rows(live, S.US_FLOW, "train"), with_second=True)
    lines = _plan(df).splitlines()
    limits = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line]
    assert len(limits) == 2, "\n".join(lines)
    final, partial = limits
    assert "Final" in lines[final] and "Partial" in lines[partial]
    assert any("Exchange" in line for line in lines[final + 1:partial])
    day_shuffles = [line for line in lines if "Exchange hashpartitioning(consumer_id" in line]
    assert len(day_shuffles) == 2 and all("_dk" in line for line in day_shuffles), "\n".join(day_shuffles)
