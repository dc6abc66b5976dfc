"""How well do building-block rates alone rank binders?"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.operators.metrics import average_precision, metric_rollup
from combisieve.operators.predicates import in_sets
from combisieve.operators.targets import rate_baseline


def held_out_subset(df: DataFrame, held: Mapping[str, Iterable[int]], name: str = "subset") -> DataFrame:
    """0 when all blocks are held out, 1 when some are, 2 otherwise."""
    subset = F.when(in_sets(held, "all"), 0).when(in_sets(held, "any"), 1).otherwise(2)
    return df.withColumn(name, subset)


def baseline_report(
    train: DataFrame, scored: DataFrame, form: str = "product", targets: Sequence[str] = TARGETS
) -> DataFrame:
    """``(metric, value)``: average precision per part and protein, and the
    roll-ups, of the block-rate score.  ``scored`` has targets and ``subset``."""
    preds = rate_baseline(train, scored, [form], targets)
    preds = preds.select("subset", *[f"pred_{t}" for t in targets], *[F.col(t).alias(f"target_{t}") for t in targets])
    ap = average_precision(preds, targets=targets)
    cells = ap.filter("ap is not null").select(
        F.concat_ws("_", "part", "protein", F.lit("AP")).alias("metric"), F.col("ap").alias("value")
    )
    return cells.unionByName(metric_rollup(ap))
