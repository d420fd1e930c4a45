"""Join helpers: broadcast only behind a size check.

``join_checked`` materialises the small side once (reliable checkpoint in the
shared checkpoint folder, so an executor loss does not recompute it), counts it,
and broadcasts it only under ``max_rows``. Above that it falls back to a shuffle
join, where AQE splits skewed partitions of the large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Broadcast bound for lookup tables built from the data (e.g. one median per
# model and year): a few MB at most.
DEFAULT_BROADCAST_ROWS = 200_000


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small intermediate result with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_checked(large: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Join ``large`` with ``small``, broadcasting ``small`` only if its row count
    is proven below ``max_rows``; otherwise a shuffle join (AQE skew handling)."""
    small = materialize(small)
    n = small.count()
    if n <= max_rows:
        small = F.broadcast(small)
    return large.join(small, on, how)
