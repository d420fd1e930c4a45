"""Column expressions shared by the operators.

All are built-in Catalyst expressions, so they stay inside whole-stage codegen;
no Python runs per row anywhere in the library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

# Labels of the model-facing bands, as the reference writes them.
FREQ_ONE = "One"
FREQ_TWO = "Two"
FREQ_THREE = "Three"
FREQ_MORE = "More_than_Three"
RECENCY_ONCE = "Purchased_only_once"
RECENCY_WITHIN_3 = "Repurchased_WITHIN_3_yrs"
RECENCY_3_TO_5 = "Repurchased_BTWN_3_5_yrs"
RECENCY_AFTER_5 = "Repurchased_AFTER_5_yrs"
LEASE_ZERO = "Zero"
LEASE_ONE = "One"
# Platform labels and the recency band edges in years; a year is 365 days.
PLATFORMS = ("CAR", "SUV", "TRUCK")
DAYS_PER_YEAR = 365
RECENCY_EDGES_YEARS = (3, 5)


def clean_int(c: Column) -> Column:
    """Trimmed text -> int as a bare (non-ANSI) cast does: an optional sign, digits, and a
    fraction that is cut off (``'2019.0'`` and ``'+2019'`` give 2019). Anything else, or
    a number outside the int range, gives NULL and never raises."""
    number = F.regexp_extract(F.trim(c), r"^([+-]?[0-9]+)([.][0-9]*)?$", 1)
    return F.when(number != "", number.try_cast("int"))


def rejected_int(c: Column) -> Column:
    """True where a non-NULL text is no int to ``clean_int``."""
    return c.isNotNull() & clean_int(c).isNull()


def as_margin(c: Column) -> Column:
    return c.cast(S.MARGIN_TYPE)


def indicator(cond: Column) -> Column:
    """1 when the condition holds, else 0 (NULL condition -> 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def frequency_band(n: Column) -> Column:
    """Prior-purchase count -> One / Two / Three / More_than_Three (else-branch as in the source)."""
    return (F.when(n == 1, FREQ_ONE).when(n == 2, FREQ_TWO).when(n == 3, FREQ_THREE)
            .otherwise(FREQ_MORE))


def lease_band(n_lease: Column) -> Column:
    """Zero only if the lease count is exactly 0; NULL counts fall to One, as in the source."""
    return F.when(n_lease == 0, LEASE_ZERO).otherwise(LEASE_ONE)


def recency_band(span_days: Column, n_gaps: Column) -> Column:
    """Band of the mean gap between purchases, compared exactly in whole days.

    The mean gap in years is ``span_days / (365 * n_gaps)``; comparing
    ``span_days`` with ``365 * edge * n_gaps`` is the same test without floating
    point, so a mean of exactly 3 or 5 years always falls in the lower band.
    No gap (``n_gaps`` 0 or NULL) means the customer bought only once.
    """
    low, high = (DAYS_PER_YEAR * e for e in RECENCY_EDGES_YEARS)
    gaps = n_gaps.cast("long")
    return (F.when(gaps.isNull() | (gaps <= 0), RECENCY_ONCE)
            .when((span_days >= 0) & (span_days <= gaps * low), RECENCY_WITHIN_3)
            .when((span_days > gaps * low) & (span_days <= gaps * high), RECENCY_3_TO_5)
            .when(span_days > gaps * high, RECENCY_AFTER_5))


def mean_gap_years(span_days: Column, n_gaps: Column) -> Column:
    """Mean years between consecutive purchases: total span over the number of gaps."""
    return F.when(n_gaps > 0, span_days.cast("double") / (n_gaps.cast("double") * DAYS_PER_YEAR))


def exact_mean(total: Column, n: Column) -> Column:
    """sum / count as double, NULL for an empty group.

    The decimal sum is exact, so the mean does not depend on the order rows are
    added in (unlike a running double average).
    """
    return F.when(n > 0, total.cast("double") / n.cast("double"))


def hash_bucket(key: Column, buckets: int, salt: str = "") -> Column:
    """Stable bucket in [0, buckets) from the md5 of the key's text.

    Depends only on the key, never on partitioning or task order, so a re-run
    after an executor loss assigns every key to the same bucket.
    """
    text = key.cast("string") if not salt else F.concat(F.lit(salt), key.cast("string"))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(buckets))


def sMAPE_term(pred: Column, actual: Column) -> Column:
    """2|p-a| / (|p|+|a|), defined as 0 when both are 0."""
    p = pred.cast("double")
    a = actual.cast("double")
    denom = F.abs(p) + F.abs(a)
    return F.when(denom == 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.abs(p - a) / denom)
