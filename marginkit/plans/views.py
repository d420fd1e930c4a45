"""The SQL surface. The stages of a flow registered as temporary views, so
analysts can keep writing ``spark.sql`` against named tables (as the source's
notebooks do) while every view is the same lazy operator plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..sources.extract import extract_ownership
from .flows import (
    baseline_match, imputed_training_rows, outcome_first, scoring_features, side_rows, training_table_from,
)


def flow_views(live: DataFrame, history: DataFrame | None, flow: S.Flow = S.US_FLOW) -> dict[str, DataFrame]:
    """Name -> DataFrame for the main stages of a country flow."""
    imputed = imputed_training_rows(live, flow)  # built once, shared by every view below
    train = side_rows(live, flow, "train", imputed=imputed)
    test = side_rows(live, flow, "test", imputed=imputed)
    views = {
        "extract": extract_ownership(live, flow.training_extract()),
        "imputed": imputed,
        "train_rows": train,
        "test_rows": test,
        "training_table": training_table_from(train),
        "test_table": training_table_from(test),
        "outcome_first": outcome_first(live, flow),
    }
    if history is not None:
        views["scoring_features"] = scoring_features(live, history, flow)
        views["baseline_match"] = baseline_match(live, history, flow)
    return views


def register_flow_views(spark: SparkSession, live: DataFrame, history: DataFrame | None,
                        flow: S.Flow = S.US_FLOW, prefix: str = "") -> list[str]:
    """Register every stage as ``{prefix}{name}``; returns the view names."""
    names = []
    for name, df in flow_views(live, history, flow).items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def sorted_output(df: DataFrame, *columns: str, descending: tuple[str, ...] = ()) -> DataFrame:
    """O3: a final ordering for the sink only (a range-partitioned global sort);
    intermediate ``ORDER BY`` clauses of the source are dropped as meaningless
    under joins and aggregates."""
    from pyspark.sql import functions as F
    cols = [F.col(c).desc() if c in descending else F.col(c).asc() for c in (columns or (S.CUSTOMER,))]
    return df.orderBy(*cols)
