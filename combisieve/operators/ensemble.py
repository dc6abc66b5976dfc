"""Combining and comparing predictions, always by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.functions.checks import require
from combisieve.operators.skew import broadcast_if_small


def mean_ensemble(preds: DataFrame, ids: Sequence[str], value: str = "binds") -> DataFrame:
    """Mean over models or folds."""
    return preds.groupBy(*ids).agg(F.avg(value).alias(value))


def weighted_ensemble(
    preds: DataFrame, weights: DataFrame, id_col: str = "id", segment: str = "segment", value: str = "binds"
) -> DataFrame:
    """``(id, segment, binds)``: sum(w*p)/sum(w) with weights per (model,
    segment); a model without a weight takes no part, and a result outside
    [0, 1] fails."""
    weighted = preds.join(broadcast_if_small(weights), ["model", segment])
    out = weighted.groupBy(id_col, segment).agg(
        (F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias(value)
    )
    return out.withColumn(value, require(F.col(value).between(0, 1), F.col(value), "ensemble outside [0, 1]"))


def fill_missing_targets(df: DataFrame, prefix: str = "pred_", targets: Sequence[str] = TARGETS) -> DataFrame:
    """Targets a model does not predict become 0."""
    cols = {
        f"{prefix}{t}": F.coalesce(F.col(f"{prefix}{t}"), F.lit(0.0)) if f"{prefix}{t}" in df.columns else F.lit(0.0)
        for t in targets
    }
    return df.withColumns(cols)


def compare_predictions(a: DataFrame, b: DataFrame, ids: Sequence[str], value: str = "binds") -> DataFrame:
    """One row: rows on both sides, equal values, missing partners, largest
    absolute difference."""
    left = a.select(*ids, F.col(value).alias("__a"))
    right = b.select(*ids, F.col(value).alias("__b"))
    both = left.join(right, list(ids), "full_outer")
    diff = F.abs(F.col("__a") - F.col("__b"))
    return both.agg(
        F.count(diff).alias("n"),
        F.count_if(diff == 0).alias("n_equal"),
        F.count_if(diff.isNull()).alias("n_missing"),
        F.max(diff).alias("max_diff"),
    )
