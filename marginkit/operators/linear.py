"""C9 with a checkable fit: ridge regression from one distributed Gram matrix.

The inputs are two numbers (the mean margin and the mean vehicle age, each with an
indicator of a missing value) and three bands. Rows are grouped by their indicators, a few
hundred combinations whatever the number of rows, and each group keeps ten exact sums of
whole units (margins in cents, ages in 1/10,000 year). These are all a linear fit needs:
the Gram matrix of the terms is put together from them, and the normal equations of at
most ``len(TERMS)`` unknowns are solved exactly, in fractions. So the fit takes one pass
over the table with a map-side aggregate, no sort or shuffle of rows, and gives the same
weights at any partitioning.

Edge cases: a NULL or NaN number counts as 0 beside its indicator; a NULL band or one that
is not listed has no indicator; rows without a target are left out; a term that never
occurs gets the weight 0, and so does every term of an empty table; repeated rows count
as often as they occur; other columns are not looked at.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .score import LINEAR_TERMS, MISSING, NUMERIC, TARGET

#: whole units per unit of value
UNITS = {"avg_imputed_contribution_margin": 100, "avg_vehicle_age": 10_000, TARGET: 100}
MARGIN, AGE = NUMERIC
TERMS = ["intercept", *NUMERIC, *[f"{c}={MISSING}" for c in NUMERIC],
         *[f"{c}={n}" for c, names in LINEAR_TERMS.items() for n in names]]
RIDGE = Fraction(1, 1000)
#: decimals of a weight: a money step, and a factor of the mean margin
STEP_DIGITS, FACTOR_DIGITS = 4, 8

# a term's value in a row is 1 or one of the three numbers
_ONE = "1"
_KIND = {MARGIN: "m", AGE: "a", TARGET: "y"}


def _whole(column: str):
    """The value in whole units, NULL if missing."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), F.round(x * F.lit(float(UNITS[column]))).cast("decimal(18,0)"))


def sufficient_sums(training: DataFrame) -> DataFrame:
    """Per combination of indicators: rows and the sums of the numbers, their squares and
    their products, as exact decimals (``s_1`` is the row count)."""
    rows = training.select(
        *LINEAR_TERMS, _whole(MARGIN).alias("m"), _whole(AGE).alias("a"), _whole(TARGET).alias("y"),
    ).where(F.col("y").isNotNull())
    zero = F.lit(0).cast("decimal(18,0)")
    rows = rows.select(*LINEAR_TERMS, F.col("m").isNull().alias("m_missing"), F.col("a").isNull().alias("a_missing"),
                       F.coalesce("m", zero).alias("m"), F.coalesce("a", zero).alias("a"), "y")
    wide = "decimal(38,0)"
    sums = [F.count(F.lit(1)).cast(wide).alias("s_11")]
    sums += [F.sum(x).cast(wide).alias(f"s_1{x}") for x in "amy"]
    sums += [F.sum(F.col(x) * F.col(z)).cast(wide).alias(f"s_{x}{z}") for x, z in ("aa", "am", "ay", "mm", "my", "yy")]
    return rows.groupBy(*LINEAR_TERMS, "m_missing", "a_missing").agg(*sums)


def gram(training: DataFrame) -> DataFrame:
    """(row_term, column_term, total): the Gram matrix of ``TERMS`` and the target, in whole
    units, without the pairs that never occur together. ``total`` is exact."""
    def term(name, kind, present=None):
        item = F.struct(F.lit(name).alias("term"), F.lit(kind).alias("kind"))
        return item if present is None else F.when(present, item)

    items = [term("intercept", _ONE), *[term(c, _KIND[c]) for c in (*NUMERIC, TARGET)],
             term(f"{MARGIN}={MISSING}", _ONE, F.col("m_missing")), term(f"{AGE}={MISSING}", _ONE, F.col("a_missing"))]
    items += [term(f"{c}={n}", _ONE, F.col(c) == n) for c, names in LINEAR_TERMS.items() for n in names]
    products = ["11", "1a", "1m", "1y", "aa", "am", "ay", "mm", "my", "yy"]
    total = F.create_map(*[x for p in products for x in (F.lit(p), F.col(f"s_{p}"))])
    groups = sufficient_sums(training).select(F.filter(F.array(*items), lambda x: x.isNotNull()).alias("items"), total.alias("sums"))
    pairs = groups.select("items", "sums", F.explode("items").alias("x")).select("sums", "x", F.explode("items").alias("z"))
    key = F.concat(F.least("x.kind", "z.kind"), F.greatest("x.kind", "z.kind"))
    return (pairs.select(F.col("x.term").alias("row_term"), F.col("z.term").alias("column_term"), F.col("sums")[key].alias("v"))
            .groupBy("row_term", "column_term").agg(F.sum("v").alias("total")))


def solve_ridge(totals: dict[tuple[str, str], int], ridge: Fraction = RIDGE) -> dict[str, float]:
    """Weights from a Gram matrix in whole units. Each term but the intercept is penalised
    by ``ridge`` times its own sum of squares, so the scale of an input does not matter."""
    known = [t for t in TERMS if totals.get((t, t))]
    rows = []
    for a in known:
        row = [Fraction(int(totals.get((a, b), 0))) for b in known]
        if a != "intercept":
            row[len(rows)] *= 1 + Fraction(ridge)
        rows.append(row + [Fraction(int(totals.get((a, TARGET), 0)))])
    for k in range(len(rows)):   # positive definite: every pivot is positive
        rows[k] = [v / rows[k][k] for v in rows[k]]
        for i, row in enumerate(rows):
            if i != k and row[k]:
                rows[i] = [v - row[k] * p for v, p in zip(row, rows[k])]
    solved = {t: row[-1] * UNITS.get(t, 1) / UNITS[TARGET] for t, row in zip(known, rows)}
    return {t: float(_rounded(solved.get(t, Fraction(0)), digits(t))) for t in TERMS}


def digits(term: str) -> int:
    return FACTOR_DIGITS if term == MARGIN else STEP_DIGITS


def _rounded(value: Fraction, places: int) -> Fraction:
    """Half away from zero."""
    unit = 10 ** places
    whole = (abs(value) * unit + Fraction(1, 2)).__floor__()
    return Fraction(whole if value >= 0 else -whole, unit)


def fit_linear(training: DataFrame, ridge: Fraction = RIDGE) -> DataFrame:
    """Fitted weights (term, weight), one row for each of ``TERMS``, for ``score_linear``.
    At most (terms + 1)^2 numbers reach the driver."""
    totals = {(r.row_term, r.column_term): int(r.total) for r in gram(training).collect()}
    weights = solve_ridge(totals, ridge)
    return training.sparkSession.createDataFrame(list(weights.items()), "term string, weight double")
