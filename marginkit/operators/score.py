"""Fit, store, load and apply a margin model with Spark ML, distributed end to end.

The source trains in an external AutoML service and loads a code-generated
predictor it never calls. Here the model is a Spark ML pipeline fitted on the
training table and applied with ``transform`` (a narrow, per-partition step), so
scoring the whole customer base is one scan of the feature table.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .joins import materialize

CATEGORICAL = ("Freq_purchase", "AVERAGE_TIME_TO_PURCHASE", "lease_purchase_flag")
NUMERIC = ("avg_imputed_contribution_margin", "avg_vehicle_age")
TARGET = "Latest_CM"


def margin_pipeline(reg_param: float = 0.1) -> Pipeline:
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep") for c in CATEGORICAL]
    ohe = OneHotEncoder(inputCols=[f"{c}__i" for c in CATEGORICAL],
                        outputCols=[f"{c}__v" for c in CATEGORICAL], handleInvalid="keep")
    asm = VectorAssembler(inputCols=[f"{c}__v" for c in CATEGORICAL] + [f"{c}__{k}" for c in NUMERIC for k in ("d", "missing")],
                          outputCol="features", handleInvalid="keep")
    reg = LinearRegression(featuresCol="features", labelCol="label", regParam=reg_param,
                           elasticNetParam=0.0)
    return Pipeline(stages=[*idx, ohe, asm, reg])


def _prepare(df: DataFrame) -> DataFrame:
    """Numeric inputs as double, a missing one as 0 beside an indicator ``__missing``, so
    that an unknown vehicle age does not read as a new vehicle."""
    cols = []
    for c in NUMERIC:
        cols += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"{c}__d"),
                 F.col(c).isNull().cast("double").alias(f"{c}__missing")]
    extra = [F.col(TARGET).cast("double").alias("label")] if TARGET in df.columns else []
    return df.select(S.CUSTOMER, *CATEGORICAL, *cols, *extra)


def fit_margin_model(training: DataFrame, reg_param: float = 0.1) -> PipelineModel:
    """Fit on a training table (features + ``Latest_CM`` target).

    The fit makes several passes (one per indexer, then the solver), so its
    input, one narrow row per customer, is materialized once in the shared
    checkpoint folder instead of re-running the feature flow on every pass.
    """
    data = materialize(_prepare(training).where(F.col("label").isNotNull()))
    return margin_pipeline(reg_param).fit(data)


def score_margin(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Apply a fitted model: one prediction per customer."""
    out = model.transform(_prepare(features))
    return out.select(S.CUSTOMER, F.col("prediction").alias("predicted_margin"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


#: categories the linear form knows, by column; a row gets the weight of its category
LINEAR_TERMS = {
    "Freq_purchase": ("One", "Two", "Three", "More_than_Three"),
    "AVERAGE_TIME_TO_PURCHASE": ("Purchased_only_once", "Repurchased_WITHIN_3_yrs", "Repurchased_BTWN_3_5_yrs",
                                 "Repurchased_AFTER_5_yrs"),
    "lease_purchase_flag": ("Zero", "One"),
}
#: ``column=MISSING`` is the weight of a number that is NULL
MISSING = "(missing)"


def score_linear(features: DataFrame, weights: DataFrame, keep: list | None = None) -> DataFrame:
    """C9 with given coefficients: ``weights`` is a table (term, weight), terms being
    ``intercept``, a numeric column, ``column=category``, or ``column=(missing)`` for a
    number that is NULL or NaN. The prediction is their sum in whole cents, so it does not depend
    on the order of adding; a NULL category or a term without weight adds 0. The weights are a few named terms, grouped to one row and used
    as a scalar subquery. ``keep`` lists further columns of the result."""
    table = weights.where(F.col("term").isin(_linear_names())).agg(
        F.map_from_entries(F.collect_list(F.struct("term", F.col("weight").cast("double")))).alias("w")).scalar()

    def weight(term):
        return F.coalesce(F.element_at(table, F.lit(term)), F.lit(0.0))

    def cents(value):
        return F.coalesce(F.round(value * F.lit(100.0)).cast("long"), F.lit(0).cast("long"))

    total = cents(weight("intercept"))
    for c in NUMERIC:
        gone = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        total = total + F.when(gone, cents(weight(f"{c}={MISSING}"))).otherwise(cents(weight(c) * F.col(c).cast("double")))
    for c, names in LINEAR_TERMS.items():
        for name in names:
            total = total + F.when(F.col(c) == name, cents(weight(f"{c}={name}"))).otherwise(F.lit(0).cast("long"))
    return features.select(S.CUSTOMER, (total.cast("double") / F.lit(100.0)).alias("predicted_margin"), *(keep or []))


def _linear_names() -> list[str]:
    return ["intercept", *NUMERIC, *[f"{c}={MISSING}" for c in NUMERIC], *[f"{c}={n}" for c, names in LINEAR_TERMS.items() for n in names]]
