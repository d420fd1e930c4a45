"""Exact group medians and parts of repeated and NULL keys."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marginkit import schema as S
from marginkit.operators import group_median_exact
from marginkit.operators.split import split_parts

N = 400_000


def _margins(spark):
    i = F.col("id")
    spread = F.pmod(F.xxhash64(i), F.lit(900_000_000_000)) - 300_000_000_000
    return spark.range(0, N, 1, 16).select(
        F.when(i % 3 != 0, "hot").when(i % 3000 == 0, F.lit(None)).otherwise(F.concat(F.lit("m"), (i % 50).cast("string"))).alias(S.MODEL),
        F.when(i % 3 != 0, 2010).otherwise(F.lit(2000) + i % 7).cast("int").alias(S.YEAR),
        F.when(i % 11 == 0, F.lit(None)).when(i % 5 == 0, F.lit(777)).otherwise(spread / 100).cast("decimal(18,2)").alias(S.MARGIN))


def test_exact_median_of_a_hot_group(spark):
    rows = _margins(spark)
    got = {(r[0], r[1]): r[2] for r in group_median_exact(rows).collect()}
    t = rows.toArrow()  # noqa: F841
    want = duckdb.sql(f"select {S.MODEL}, {S.YEAR}, quantile_disc({S.MARGIN}, 0.5) from t group by 1, 2").fetchall()
    assert got == {(a, b): c for a, b, c in want} and len(got) > 300
    hot = rows.where(F.col(S.MODEL) == "hot").select(S.MARGIN).distinct().count()
    assert hot > 100_000


def test_no_window_over_the_rows_of_a_group(spark):
    plan = group_median_exact(_margins(spark))._jdf.queryExecution().toString()
    assert "Window" not in plan and "percentile" not in plan     # the rounds are written; the last step is a join of groups


@pytest.mark.parametrize("kind", ["int", "bigint", "decimal(9,4)"])
def test_small_groups(spark, kind):
    data = [("a", 1), ("a", 2), ("a", 2), ("a", 9), ("b", -5), ("c", None), (None, 3), (None, -4), ("d", 0), ("d", -1)]
    df = spark.createDataFrame(data, "k string, v int").select("k", F.col("v").cast(kind).alias("v"))
    got = {r.k: r.v for r in group_median_exact(df, ("k",), "v").collect()}
    assert got == {"a": 2, "b": -5, "c": None, None: -4, "d": -1}
    assert dict(group_median_exact(df, ("k",), "v").dtypes)["v"] == kind
    assert group_median_exact(df.where("false"), ("k",), "v").count() == 0


def test_other_types_are_refused(spark):
    with pytest.raises(TypeError, match="exact median"):
        group_median_exact(spark.createDataFrame([("a", 1.5)], "k string, v double"), ("k",), "v")


@pytest.mark.parametrize("exact", [True, False])
def test_parts_of_null_and_repeated_keys(spark, exact):
    i = F.col("id")
    df = spark.range(0, 30_000, 1, 8).select(F.when(i % 3 == 0, F.lit(None)).when(i % 7 == 0, F.lit(5)).otherwise(i).alias(S.CUSTOMER), "id")
    out = split_parts(df, 3, exact=exact)
    parts = {r.part: r.n for r in out.groupBy("part").agg(F.count("id").alias("n")).collect()}
    assert sum(parts.values()) == 30_000 and set(parts) <= {1, 2, 3}
    assert out.groupBy(S.CUSTOMER).agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    if exact:
        assert all(n >= 4000 for n in parts.values())
