"""Per-customer purchase history: anchoring, ranking, latest/prior split (W1-W5,
F9-F11, J3).

Skew-safe plan. A customer may hold a large share of all rows, so no window or
join here ever sees all of one customer's rows in one task:

1. ``day_summary`` pre-aggregates rows to (customer, day) grain. The shuffle key
   is (consumer_id, acquisition_date), so a hot customer is spread over its days,
   and partial aggregation runs before the shuffle.
2. Per-customer windows then run over *day* rows. A customer has at most one row
   per calendar day in the extract window (< 7,000 for 19 years), so each window
   group has a proven size bound however skewed the customers are.
3. Row-level outputs join day facts back on (consumer_id, acquisition_date),
   again a key that spreads a hot customer. A hot *day* (more than
   ``HOT_DAY_ROWS`` rows) is found first and ranked by range partitioning, so
   no join or window sees one day whole either.

Date ties: all rows of one day are peers for the "new purchase" anchor (the
source's RANGE frame), and are ordered by ``vin`` when one row must be picked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import PLATFORMS, indicator

# Fields of the row picked per day (ordered: vin first, it is the tie-break).
ROW_FIELDS = (S.VIN, S.MARGIN, S.YEAR, S.AGE, S.LEASE, S.PLATFORM, S.LIFESTAGE, S.CYCLE)
DAY_KEYS = (S.CUSTOMER, S.DATE)


# What the features need of a day's first row. Rows equal in these are interchangeable,
# so leaving out the other fields does not change the tie-break.
NARROW_FIELDS = (S.VIN, S.MARGIN, S.YEAR, S.AGE, S.LEASE, S.PLATFORM)


def _row_struct(fields=ROW_FIELDS) -> Column:
    return F.struct(*[F.col(c) for c in fields])


def _newest_days() -> Window:
    return Window.partitionBy(S.CUSTOMER).orderBy(F.col(S.DATE).desc_nulls_last())


def _day_sums() -> list[Column]:
    sums = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count(S.DATE).alias("n_dated"),
        F.sum(indicator(F.col(S.CYCLE) == S.NEW_VEHICLE_CYCLE)).alias("n_new"),
        F.sum(S.AGE).alias("age_sum"), F.count(S.AGE).alias("age_n"),
        F.sum(S.LEASE).alias("lease_sum"), F.count(S.LEASE).alias("lease_n"),
        F.sum(S.MARGIN).alias("cm_sum"), F.count(S.MARGIN).alias("cm_n"),
    ]
    sums += [F.sum(indicator(F.col(S.PLATFORM) == p)).alias(f"n_{p.lower()}") for p in PLATFORMS]
    return sums


def day_summary(rows: DataFrame, with_second: bool = False) -> DataFrame:
    """One row per (customer, day): counts and sums of the day's purchases plus
    ``first``, the day's row with the lowest vin (and ``second`` if asked)."""
    if not with_second:
        return rows.groupBy(*DAY_KEYS).agg(*_day_sums(), F.min(_row_struct(NARROW_FIELDS)).alias("first"))
    # The second row of a day needs an order inside the (customer, day) group.
    # ``_wd <= 2`` on a row_number becomes a WindowGroupLimit that Spark also runs
    # before the shuffle, so each map task sends at most two rows per day and a
    # hot (customer, day) never reaches one task whole. Both halves are grouped
    # on the integer day key (NULL dates included), so the join that puts them
    # together reuses their partitioning.
    keyed = rows.withColumn("_dk", _day_key())
    sums = keyed.groupBy(S.CUSTOMER, "_dk").agg(*_day_sums(), F.max(S.DATE).alias(S.DATE))
    in_day = Window.partitionBy(S.CUSTOMER, "_dk").orderBy(*[F.col(c).asc_nulls_first() for c in ROW_FIELDS])
    top2 = (keyed.select(S.CUSTOMER, "_dk", _row_struct().alias("_r"),
                         F.row_number().over(in_day).alias("_wd"))
            .where(F.col("_wd") <= 2)
            .groupBy(S.CUSTOMER, "_dk").agg(
                F.max(F.when(F.col("_wd") == 1, F.col("_r"))).alias("first"),
                F.max(F.when(F.col("_wd") == 2, F.col("_r"))).alias("second")))
    return sums.join(top2, [S.CUSTOMER, "_dk"]).drop("_dk")


def anchor_days(days: DataFrame) -> DataFrame:
    """W1 + F10 at day grain: keep days on or before the customer's newest day with
    a new-vehicle purchase (``grp >= 1``), and rank the kept days newest first.

    ``grp`` is the running count of new purchases from the newest day back, the
    current day included (so a used purchase on the same day as the new one is
    kept, as peers of a RANGE frame are). ``day_rank`` 1 is the anchor day.
    """
    w = _newest_days()
    kept = (days.withColumn("grp", F.sum("n_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .where(F.col("grp") >= 1))
    return (kept.withColumn("day_rank", F.row_number().over(w))
            .withColumn("rows_before", F.coalesce(
                F.sum("n_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))


def latest_and_prior(days: DataFrame, anchored: bool = True) -> DataFrame:
    """Per customer: totals over the (anchored) history, the latest purchase
    (``top``: first row of the newest day) and what the newest *prior* purchase
    needs. Runs on the day frame's partitioning: no shuffle beyond the window's.
    """
    d = anchor_days(days) if anchored else (
        days.withColumn("day_rank", F.row_number().over(_newest_days())))
    r1 = F.col("day_rank") == 1
    r2 = F.col("day_rank") == 2
    aggs = [F.sum(c).alias(c) for c in ("n_rows", "n_dated", "age_sum", "age_n", "lease_sum",
                                        "lease_n", "cm_sum", "cm_n",
                                        *[f"n_{p.lower()}" for p in PLATFORMS])]
    aggs += [
        F.min(S.DATE).alias("min_date"),
        F.max(F.when(r1, F.col("first"))).alias("top"),
        F.max(F.when(r1, F.col("n_rows"))).alias("top_day_rows"),
        F.max(F.when(r1, F.col(S.DATE))).alias("top_date"),
        F.max(F.when(r2, F.col(S.DATE))).alias("day2_date"),
        F.max(F.when(r2, F.col("first"))).alias("day2_first"),
    ]
    if "second" in days.columns:
        aggs.append(F.max(F.when(r1, F.col("second"))).alias("top_day_second"))
    return d.groupBy(S.CUSTOMER).agg(*aggs)


def prior_stats(summary: DataFrame) -> DataFrame:
    """Aggregates over the prior purchases (all but the latest), derived exactly
    from the totals by removing the latest row's contribution once."""
    top = F.col("top")

    def minus_top(total: str, n: str, field: str):
        present = top[field].isNotNull().cast("long")
        n_prior = F.col(n) - present
        total_prior = F.when(n_prior > 0, F.col(total) - F.coalesce(top[field], F.lit(0)))
        return total_prior, n_prior

    top_dated = F.col("top_date").isNotNull().cast("long")
    freq_prior = F.col("n_dated") - top_dated
    age_sum, age_n = minus_top("age_sum", "age_n", S.AGE)
    lease_sum, lease_n = minus_top("lease_sum", "lease_n", S.LEASE)
    cm_sum, cm_n = minus_top("cm_sum", "cm_n", S.MARGIN)
    # Newest prior purchase: the 2nd row of the anchor day if it has one, else
    # the first row of the day before.
    has_same_day = F.col("top_day_rows") >= 2
    second_date = F.when(has_same_day, F.col("top_date")).otherwise(F.col("day2_date"))
    cols = [
        F.col(S.CUSTOMER),
        F.col("n_dated").alias("no_of_purc"),
        freq_prior.alias("freq_excluding_latest"),
        age_sum.alias("age_sum_prior"), age_n.alias("age_n_prior"),
        lease_sum.alias("no_of_lease_purchases"),
        cm_sum.alias("cm_sum_prior"), cm_n.alias("cm_n_prior"),
        F.when(freq_prior >= 2, F.datediff(second_date, F.col("min_date"))).alias("span_days"),
        (freq_prior - 1).alias("n_gaps"),
        top[S.YEAR].alias("Latest_CM_purchase_year"),
        top[S.MARGIN].alias("Latest_CM"),
    ]
    for p in PLATFORMS:
        cols.append((F.col(f"n_{p.lower()}") - indicator(top[S.PLATFORM] == p)).alias(f"seg_{p.lower()}"))
    if "top_day_second" in summary.columns:
        cols.append(F.when(has_same_day, F.col("top_day_second")[S.LIFESTAGE])
                    .otherwise(F.col("day2_first")[S.LIFESTAGE]).alias(S.LIFESTAGE))
    return summary.select(*cols)


def history_profile(rows: DataFrame, with_lifestage: bool = False) -> DataFrame:
    """The training-flow history in one plan: anchor, rank, keep customers with
    more than one dated purchase, and aggregate their prior purchases."""
    summary = latest_and_prior(day_summary(rows, with_second=with_lifestage))
    return prior_stats(summary).where(F.col("no_of_purc") > 1)


# ----------------------------------------------------------------------------
# Row-level views of the same steps (the source's intermediate tables).
# ----------------------------------------------------------------------------

# Day key: days since epoch, NULL dates as the minimum int (outside the
# 0001-9999 date range, so it never collides). A plain equi-join on it keeps the
# join's hash partitioning usable by the in-day window that follows; a null-safe
# join on the date would not, and would cost a second full shuffle of the rows.
NO_DATE_KEY = -(2 ** 31)


def _day_key() -> Column:
    return F.coalesce(F.unix_date(F.col(S.DATE)), F.lit(NO_DATE_KEY))


def _join_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Attach day facts to rows on (customer, day key); the result is hash
    partitioned by that key, which the in-day window reuses."""
    d = days.withColumn("_dkd", _day_key()).drop(S.DATE).withColumnRenamed(S.CUSTOMER, "_c")
    r = rows.withColumn("_dk", _day_key())
    return r.join(d, (r[S.CUSTOMER] == d["_c"]) & (r["_dk"] == d["_dkd"])).drop("_c", "_dkd")


def history_rows(rows: DataFrame, hot_day_rows: int | None = None) -> DataFrame:
    """Every row annotated with the source's window results, in one pass:
    ``grp`` (W1), ``_anchored`` (F10), ``ROW_numbering`` (W2, anchored rows),
    ``no_of_purc`` (J3: the customer's dated anchored purchases), plus what W4
    needs (``_newer``: the next newer day, ``_wd``: rank inside the day).

    One day-grain aggregate (partial, narrow columns), one bounded window over
    days (all frames share one partitioning and order), one join back on
    (customer, day key) whose partitioning the in-day rank reuses.

    Days with more than ``hot_day_rows`` rows (default ``HOT_DAY_ROWS``) never
    reach one task: they are found first (a count aggregate whose result is
    bounded for broadcast), skip the hash join, and are ranked by range
    partitioning (``_rank_hot_days``).
    """
    limit = HOT_DAY_ROWS if hot_day_rows is None else hot_day_rows
    days = _day_counts(rows)
    hot = _hot_days(days, limit)
    w = _newest_days()
    anchored = F.col("grp") >= 1
    # Anchored days are a suffix of a customer's days in newest-first order, so a
    # running sum over the anchored days before a day counts its newer rows.
    days = (days.withColumn("grp", F.sum("n_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_anchored", anchored)
            .withColumn("rows_before", F.coalesce(F.sum(F.when(anchored, F.col("n_rows"))).over(
                w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("no_of_purc", F.coalesce(F.sum(F.when(anchored, F.col("n_dated"))).over(
                w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0)))
            .withColumn("_newer", F.lag(S.DATE).over(w)))
    facts = days.select(*DAY_KEYS, "grp", "_anchored", "rows_before", "no_of_purc", "_newer")
    if hot is None:
        return _rank_in_day(_join_days(rows, facts))
    hot_ref = F.broadcast(hot)  # size-bounded by _hot_days
    keyed = rows.withColumn("_dk", _day_key())
    normal = keyed.join(hot_ref, [S.CUSTOMER, "_dk"], "left_anti").drop("_dk")
    hot_rows = keyed.join(hot_ref, [S.CUSTOMER, "_dk"], "left_semi")
    hot_facts = (facts.withColumn("_dk", _day_key()).drop(S.DATE)
                 .join(hot_ref, [S.CUSTOMER, "_dk"], "left_semi"))
    hot_rows = hot_rows.join(F.broadcast(hot_facts), [S.CUSTOMER, "_dk"])
    return _rank_in_day(_join_days(normal, facts)).unionByName(_rank_hot_days(hot_rows))


# A (customer, day) with more rows than this is ranked without a per-day window.
HOT_DAY_ROWS = 100_000


def _ordered_row_fields() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ROW_FIELDS]


def _with_row_numbering(df: DataFrame) -> DataFrame:
    return df.withColumn("ROW_numbering", F.when(F.col("_anchored"), F.col("rows_before") + F.col("_wd")).cast("int"))


def _rank_in_day(joined: DataFrame) -> DataFrame:
    in_day = Window.partitionBy(S.CUSTOMER, "_dk").orderBy(*_ordered_row_fields())
    return _with_row_numbering(joined.withColumn("_wd", F.row_number().over(in_day)))


def _day_counts(rows: DataFrame) -> DataFrame:
    """Row counts per (customer, day key). Lazy: the hot-day check below uses the count
    alone, the day windows the rest; neither writes a table that grows with the rows."""
    return rows.withColumn("_dk", _day_key()).groupBy(S.CUSTOMER, "_dk").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(S.DATE).alias("n_dated"),
        F.sum(indicator(F.col(S.CYCLE) == S.NEW_VEHICLE_CYCLE)).alias("n_new"),
        F.max(S.DATE).alias(S.DATE))


def _hot_days(days: DataFrame, limit: int) -> DataFrame | None:
    """(customer, day key) pairs with more than ``limit`` rows, or None if there are none.
    Only these keys are written (a scan of the two key columns, no rows). Always few
    enough to broadcast: if more than the broadcast bound B exceed ``limit``, the limit is
    raised to ceil(T / B), T the rows of those days; fewer than B days can exceed it, and
    every other day's window group is bounded by it."""
    from .joins import DEFAULT_BROADCAST_ROWS, materialize
    counts = materialize(days.where(F.col("n_rows") > limit).select(S.CUSTOMER, "_dk", "n_rows"))
    n, total = counts.agg(F.count(F.lit(1)), F.sum("n_rows")).first()
    if n > DEFAULT_BROADCAST_ROWS:
        counts = counts.where(F.col("n_rows") > -(-total // DEFAULT_BROADCAST_ROWS))
        n = counts.count()
    return None if n == 0 else counts.select(S.CUSTOMER, "_dk")


def _rank_hot_days(hot_rows: DataFrame) -> DataFrame:
    """Exact in-day rank of rows of hot days without a window per day: range
    partition on (customer, day, row fields) so a hot day spans many tasks,
    number rows inside each sorted partition, and add the rows of the same day
    in earlier partitions (one row per day segment, at most partitions + hot
    days rows, which is what is joined back)."""
    from .joins import join_checked, materialize
    spark = hot_rows.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(S.CUSTOMER).asc(), F.col("_dk").asc(), *_ordered_row_fields()]
    ordered = (hot_rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mono", F.monotonically_increasing_id()))
    # Stable ids for both uses below (a reliable checkpoint, not a re-sample).
    ordered = materialize(ordered)
    segs = ordered.groupBy("_pid", S.CUSTOMER, "_dk").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_start"))
    by_day = Window.partitionBy(S.CUSTOMER, "_dk").orderBy("_pid")
    segs = segs.withColumn("_before", F.coalesce(
        F.sum("_n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = join_checked(ordered, segs, ["_pid", S.CUSTOMER, "_dk"])
    ranked = ranked.withColumn("_wd", (F.col("_before") + F.col("_mono") - F.col("_start") + 1).cast("int"))
    return _with_row_numbering(ranked.drop("_pid", "_mono", "_start", "_before"))


def new_anchor(rows: DataFrame) -> DataFrame:
    """Every row with ``grp``, the number of new-vehicle purchases of the
    customer on or after the row's day (same-day purchases are peers)."""
    return history_rows(rows).select(*rows.columns, "grp")


def first_new_or_later(rows: DataFrame) -> DataFrame:
    """rows with ``grp >= 1``: used purchases made after the newest new one
    are dropped; customers without any new purchase disappear."""
    return new_anchor(rows).where(F.col("grp") >= 1)


def rank_newest(rows: DataFrame) -> DataFrame:
    """Anchored rows numbered newest first (``ROW_numbering``), ties by vin:
    the count of anchored rows on newer days plus the rank inside the day."""
    return history_rows(rows).where(F.col("_anchored")).select(*rows.columns, "ROW_numbering")


def _multi(rows: DataFrame) -> DataFrame:
    return history_rows(rows).where(F.col("_anchored") & (F.col("no_of_purc") > 1))


def multi_purchase(rows: DataFrame) -> DataFrame:
    """F9 + J3: ranked rows of customers with more than one dated anchored
    purchase (the count comes from the day frame; no self-join)."""
    return _multi(rows).select(*rows.columns, "ROW_numbering")


def prior_rows(rows: DataFrame) -> DataFrame:
    """all but the latest purchase (``ROW_numbering != 1``) of those customers."""
    return multi_purchase(rows).where(F.col("ROW_numbering") != 1)


def purchase_gaps(rows: DataFrame) -> DataFrame:
    """Per prior row, years to the next newer prior purchase of the customer
    (``moving_diff``; NULL for the newest prior row). The first row of a day
    (lowest vin) carries the gap to the newer day, other rows of the day 0.
    """
    prior = _multi(rows).where(F.col("ROW_numbering") != 1)
    gap_days = (F.when(F.col(S.DATE).isNull() | (F.col("ROW_numbering") == 2), F.lit(None))
                .when(F.col("_wd") == 1, F.datediff(F.col("_newer"), F.col(S.DATE)))
                .otherwise(F.lit(0)))
    return prior.select(S.CUSTOMER, S.VIN, S.DATE, "ROW_numbering",
                        (gap_days.cast("double") / 365.0).alias("moving_diff"))


def first_outcome(outcome: DataFrame) -> DataFrame:
    """W3 + F11: each customer's earliest purchase in the outcome window (ties by
    vin) as ``Latest_CM``. A min over (date, vin) structs: partial aggregation,
    no sort, no window."""
    first = F.min(F.struct(F.col(S.DATE), F.col(S.VIN), F.col(S.MARGIN)))
    return (outcome.groupBy(S.CUSTOMER).agg(first.alias("_f"))
            .select(S.CUSTOMER, F.col("_f")[S.DATE].alias(S.DATE), F.col("_f")[S.MARGIN].alias("Latest_CM")))
