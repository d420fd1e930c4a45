"""Where a rule differs from the source's literal form on purpose, on the rows that show it."""

import random

from pyspark.sql import functions as F

from marginkit.functions.columns import clean_int, exact_mean, recency_band


def test_recency_band_edge_is_exact_where_doubles_round_away(spark):
    """A mean gap of exactly 3 years (1095 days): the literal avg(-datediff / 365) can land
    beside 3.0, the whole-day test cannot."""
    rng, found = random.Random(1), []
    while len(found) < 5:
        gaps = [rng.randint(100, 2500) for _ in range(rng.randint(2, 12))]
        gaps.append(1095 * (len(gaps) + 1) - sum(gaps))
        literal = sum(g / 365 for g in gaps) / len(gaps)
        if gaps[-1] >= 0 and literal > 3:
            found.append((sum(gaps), len(gaps)))
    df = spark.createDataFrame(found, "span long, n long")
    assert {r.b for r in df.select(recency_band(F.col("span"), F.col("n")).alias("b")).collect()} == {"Repurchased_WITHIN_3_yrs"}


def test_mean_is_a_double_of_the_exact_sum(spark):
    """avg(decimal(18,2)) keeps six decimals; the library divides the exact sum as doubles."""
    df = spark.createDataFrame([("1.00",), ("1.00",), ("0.01",)], "m string").select(F.col("m").cast("decimal(18,2)").alias("m"))
    r = df.agg(F.avg("m").alias("literal"), exact_mean(F.sum("m"), F.count("m")).alias("ours")).first()
    assert str(r.literal) == "0.670000" and r.ours == 2.01 / 3


def test_int_cast_equals_the_bare_cast_on_numbers(spark):
    texts = ["2019", " 2019 ", "2019.0", "+2019", "-3", "2019.9", "abc", "", "1e3", "99999999999", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        literal = [r[0] for r in df.select(F.col("t").cast("int")).collect()]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
    ours = [r[0] for r in df.select(clean_int(F.col("t"))).collect()]
    assert ours == literal
