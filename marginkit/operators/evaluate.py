"""Symmetric mean absolute percentage error of predictions against outcomes, per model
and as a paired comparison of two models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import hash_bucket, sMAPE_term

SMAPE_DIGITS = 9
#: customers are resampled in this many md5 buckets, this often; the interval holds 95 % of the draws
BOOTSTRAP_BUCKETS, BOOTSTRAP_DRAWS = 64, 200
INTERVAL = (0.025, 0.975)
#: fixed values: P(X <= k) of a Poisson variable of mean 1, k = 0..6, in 2^-32
POISSON_STEPS = (1580030169, 3160060337, 3950075422, 4213413783, 4279248374, 4292415292, 4294609778)


def smape(df: DataFrame, predictions: dict[str, str], actual: str = "Latest_CM") -> DataFrame:
    """One row per model: customers scored and sMAPE (mean of 2|p-a|/(|p|+|a|)).

    All models are averaged in a single aggregation over the shared rows, then
    unpivoted; rounding to 9 digits hides summation-order noise.
    """
    aggs = []
    for name, col in predictions.items():
        term = sMAPE_term(F.col(col), F.col(actual))
        aggs += [F.count(term).alias(f"n__{name}"), F.avg(term).alias(f"s__{name}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{m}', `n__{m}`, `s__{m}`" for m in predictions)
    return wide.selectExpr(f"stack({len(predictions)}, {stack}) as (model, customers, smape)").select(
        "model", F.col("customers").cast("long").alias("customers"),
        F.round(F.col("smape"), SMAPE_DIGITS).alias("smape"))


def smape_paired(df: DataFrame, models: list[str], against: str, actual: str = "Latest_CM",
                 key: str = S.CUSTOMER) -> DataFrame:
    """Each of ``models`` compared with ``against`` on the rows that both predict: (model,
    against, customers, smape, smape_against, difference, low, high).

    ``low`` to ``high`` is the bootstrap interval of the difference (model minus
    ``against``; below 0: the model is better). Customers are resampled in md5 buckets, each
    drawn a Poisson(1) number of times from a hash of draw and bucket, so a rerun gives the
    same interval. Terms are summed as whole 1e-9, which does not depend on the order. One
    aggregation over the rows leaves ``BOOTSTRAP_BUCKETS`` rows a model; the draws work on
    those. A model without a common row has NULL results, an interval needs one drawn row."""
    def whole(column):
        return F.round(sMAPE_term(F.col(column), F.col(actual)) * F.lit(1e9)).cast("long")

    items = F.array(*[F.struct(F.lit(m).alias("model"), whole(m).alias("t"), whole(against).alias("u")) for m in models])
    rows = df.select(hash_bucket(F.col(key), BOOTSTRAP_BUCKETS).alias("bucket"), F.explode(items).alias("x")).select("bucket", "x.*")
    both = F.col("t").isNotNull() & F.col("u").isNotNull()
    sums = rows.groupBy("model", "bucket").agg(
        F.count_if(both).alias("n"), F.sum(F.when(both, F.col("t"))).alias("t"), F.sum(F.when(both, F.col("u"))).alias("u"))

    def mean(total, n):
        return F.when(n > 0, total.cast("double") / n.cast("double") / F.lit(1e9))

    drawn = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(BOOTSTRAP_DRAWS))).alias("draw"))
    h = hash_bucket(F.concat_ws(":", "draw", "bucket"), 1 << 32)
    times = sum((F.when(h >= step, 1).otherwise(0) for step in POISSON_STEPS), F.lit(0))
    draws = drawn.withColumn("times", times).groupBy("model", "draw").agg(
        F.sum(F.col("n") * F.col("times")).alias("n"), F.sum((F.col("t") - F.col("u")) * F.col("times")).alias("d"))
    spread = draws.select("model", mean(F.col("d"), F.col("n")).alias("d")).groupBy("model").agg(
        F.percentile("d", list(INTERVAL)).alias("p"))
    totals = sums.groupBy("model").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("u").alias("u"))
    n = F.col("n")
    return totals.join(spread, "model").select(
        "model", F.lit(against).alias("against"), n.cast("long").alias("customers"),
        F.round(mean(F.col("t"), n), SMAPE_DIGITS).alias("smape"),
        F.round(mean(F.col("u"), n), SMAPE_DIGITS).alias("smape_against"),
        F.round(mean(F.col("t") - F.col("u"), n), SMAPE_DIGITS).alias("difference"),
        F.round(F.col("p")[0], SMAPE_DIGITS).alias("low"), F.round(F.col("p")[1], SMAPE_DIGITS).alias("high"))
