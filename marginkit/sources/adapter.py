"""Present the driver's star-schema tables as the purchase (ownership) table.

One row per order that has lines. The mapping (which column stands for the
margin, the model, the country, ...) is fixed in ``FIXTURES.md`` section 2 and is
mirrored by ``oracle.OWNERSHIP_SQL`` for the DuckDB check.

Plan at scale: ``lineitem`` is pre-aggregated to order grain (partial aggregation
collapses an order's lines in the map task, since lines of an order are stored
together), joined to ``orders`` on the order key (the aggregate's hash
partitioning is reused), then to ``part`` and ``customer`` by shuffle or AQE
broadcast, and to ``nation`` by broadcast: 25 rows, fixed by the TPC-H spec.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from .tables import read_table

# Fixed values of the adapter (FIXTURES.md section 2).
LEASE_RETURNFLAG = "R"
LEASE_MIN_DISCOUNT = 0.07
CAR_TYPES = ("ECONOMY", "SMALL")
SUV_TYPES = ("MEDIUM", "STANDARD")
BUSINESS_SEGMENTS = ("BUILDING", "MACHINERY")
UNKNOWN_PRIORITY = "4-NOT SPECIFIED"
SECOND_COUNTRY_REGION = 0
SNAPSHOTS = (  # (snapshot timestamp in the session's zone, last acquisition date it holds)
    ("2000-01-02 03:00:00", dt.date(1999, 12, 31)),
    ("1999-12-05 03:00:00", dt.date(1999, 12, 3)),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live purchase table built from ``orders``/``lineitem``/``part``/``customer``/``nation``."""
    li = _table(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("pk"),
        F.min("l_linenumber").alias("cyc"),
        F.max(F.when((F.col("l_returnflag") == LEASE_RETURNFLAG)
                     & (F.col("l_discount") > LEASE_MIN_DISCOUNT), 1).otherwise(0)).alias("lease"),
    )
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")

    j = (orders.join(lines, orders.o_orderkey == lines.l_orderkey)
         .join(part, F.col("p_partkey") == F.col("pk"))
         .join(customer, F.col("c_custkey") == F.col("o_custkey"))
         .join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey")))

    ok, pk, ck = F.col("o_orderkey"), F.col("pk"), F.col("o_custkey")
    odate = F.col("o_orderdate").cast("date")
    oyear = F.year(odate)
    return j.select(
        F.when(ok % 101 == 9, F.lit(None)).otherwise(F.concat(F.lit("VIN"), ok.cast("string"))).alias(S.VIN),
        F.when(ok % 97 == 5, F.lit(None)).otherwise(ck).cast("long").alias(S.CUSTOMER),
        F.col("cyc").cast("int").alias(S.CYCLE),
        F.when(pk % 53 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))).alias(S.MODEL),
        (oyear - F.col("p_size") % 5).cast("string").alias(S.MODEL_YEAR),
        odate.alias(S.DATE),
        oyear.cast("int").alias(S.YEAR),
        (F.col("p_size") % 12).cast("int").alias(S.AGE),
        F.col("lease").cast("int").alias(S.LEASE),
        F.when(F.col("p_type").isin(*CAR_TYPES), "CAR")
         .when(F.col("p_type").isin(*SUV_TYPES), "SUV").otherwise("TRUCK").alias(S.PLATFORM),
        F.concat(F.col("c_mktsegment"), F.lit(" ")).alias(S.LIFESTAGE),
        F.when(F.col("c_mktsegment").isin(*BUSINESS_SEGMENTS), "B").otherwise(S.RETAIL_CODE).alias(S.CUSTOMER_TYPE),
        F.when(ok % 50 == 7, F.lit(None).cast(S.MARGIN_TYPE))
         .when(F.col("o_orderpriority") == UNKNOWN_PRIORITY, F.lit(0).cast(S.MARGIN_TYPE))
         .otherwise(F.col("o_totalprice").cast(S.MARGIN_TYPE)).alias(S.MARGIN),
        F.when(F.col("n_regionkey") == SECOND_COUNTRY_REGION, S.COUNTRY_SECOND).otherwise(S.COUNTRY_US).alias(S.COUNTRY),
        F.when(pk % 10 == 0, "MAKE_B").otherwise("MAKE_A").alias(S.MAKE),
        F.when(ck % 40 == 3, F.lit(None)).otherwise(F.concat(F.lit("H"), ck.cast("string"))).alias(S.HOUSEHOLD),
    )


def ownership_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshotted purchase table: each snapshot holds the purchases known on its day."""
    live = ownership(spark, sf_dir)
    parts = [live.where(F.col(S.DATE) <= F.lit(upto))
             .withColumn(S.SNAPSHOT_TS, F.lit(ts).cast("timestamp"))
             for ts, upto in SNAPSHOTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
