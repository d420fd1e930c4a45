"""Customer-level splits (R1, J2) and equal parts.

The source splits customers with ``randomSplit``, whose result depends on how the
data happens to be partitioned, and cuts parts with ``limit`` on unordered data.
Here every assignment is a function of the customer key alone (an md5 bucket),
so it is identical at any partitioning and after any task retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import hash_bucket

TRAIN_PERCENT = 70


def split_side(rows: DataFrame, side: str, train_percent: int = TRAIN_PERCENT,
               salt: str = "") -> DataFrame:
    """R1 + J2: rows of the train (or test) customers.

    Membership is a predicate on the key, so the source's distinct + join
    becomes a filter: no shuffle, no skew.
    """
    in_train = hash_bucket(F.col(S.CUSTOMER), 100, salt) < train_percent
    return rows.where(in_train if side == "train" else ~in_train)


def order_key(key: str = S.CUSTOMER):
    """A 60-bit md5 value of the key: a stable pseudo-random order. A NULL key comes first."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def split_parts(df: DataFrame, n_parts: int = 3, exact: bool = True, key: str = S.CUSTOMER) -> DataFrame:
    """R2: add ``part`` in 1..n_parts, disjoint and complete.

    ``exact=True`` reproduces the source's sizes (``n // k`` of what is left for
    each part but the last, which takes the rest) in md5 order, ties by key. The last
    (md5, key) of each part is found first, from the key column alone; then ``part`` is a
    comparison with these few values: no ranks, no join, nothing written. ``df`` is read
    a few times, so pass a stored table. Rows that repeat a key stay in one part, NULL keys too.
    ``exact=False`` is one md5 bucket per key (near-equal, no extra pass).
    """
    if not exact:
        return df.withColumn("part", (F.coalesce(hash_bucket(F.col(key), n_parts), F.lit(0)) + 1).cast("int"))
    keys = df.select(order_key(key).alias("_k"), F.col(key).alias("_key"))
    cells = _histogram(keys, 0, ORDER_BITS)
    total, bound, ends = sum(n for _, n in cells), 0, []
    for left in range(n_parts, 1, -1):
        bound += (total - bound) // left
        ends.append(_nth(keys, cells, bound) if bound else None)
    part = F.lit(n_parts)
    here = F.struct(order_key(key).alias("_k"), F.col(key).alias("_key"))
    key_type = df.schema[key].dataType
    for i in range(n_parts - 1, 0, -1):
        if ends[i - 1] is not None:
            k, last = ends[i - 1]
            end = F.struct(F.lit(k).cast("long").alias("_k"), F.lit(last).cast(key_type).alias("_key"))
            part = F.when(here <= end, F.lit(i)).otherwise(part)
    return df.withColumn("part", part.cast("int"))


ORDER_BITS = 60          # of order_key
CELL_BITS = 12           # cells of one histogram: 4096, which is what reaches the driver
EXACT_ROWS = 100_000     # rows of a cell whose keys one task sorts


def _histogram(keys: DataFrame, low: int, bits: int) -> list[tuple[int, int]]:
    """(first value, rows) of the non-empty cells of [low, low + 2^bits), in order."""
    width = max(0, bits - CELL_BITS)
    inside = keys if bits == ORDER_BITS else keys.where(F.col("_k").between(low, low + (1 << bits) - 1))
    cells = inside.groupBy(F.shiftright("_k", width).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["c"] << width, r["n"]) for r in cells)


def _nth(keys: DataFrame, cells: list[tuple[int, int]], n: int, bits: int = ORDER_BITS):
    """The n-th smallest (md5 value, key), looking ever closer at the cell it falls into."""
    width = max(0, bits - CELL_BITS)
    for start, rows in cells:
        if n <= rows:
            break
        n -= rows
    cell = keys.where(F.col("_k").between(start, start + (1 << width) - 1))
    if rows <= EXACT_ROWS or width == 0:
        # keys, not rows: a key that repeats is one row here, however often
        counted = cell.groupBy("_k", "_key").agg(F.count(F.lit(1)).alias("_n"))
        upto = counted.withColumn("_upto", F.sum("_n").over(Window.orderBy("_k", "_key")))
        return tuple(upto.where(F.col("_upto") >= n).orderBy("_k", "_key").select("_k", "_key").first())
    return _nth(keys, _histogram(keys, start, width), n, width)


def rest_after(df: DataFrame, taken: DataFrame, key: str = S.CUSTOMER) -> DataFrame:
    """Rows of ``df`` whose key is not in ``taken`` (left anti join)."""
    return df.join(taken.select(key), key, "left_anti")
