"""Average precision, log loss and metric bookkeeping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from combisieve import TARGETS
from combisieve.operators.ordering import prefix_sums, quantile_bucket, row_index
from combisieve.session import cut_lineage

# The row subsets of each named part and the parts each roll-up
# averages.  None: every subset but 0, also rows whose subset is NULL.
PARTS = {"nonshare": (0,), "share": None, "share1": (1,), "share2": (2, 3)}
ROLLUPS = {
    "pseudo_AP": ("nonshare", "share2"),
    "AP": ("nonshare", "share"),
    "nonshare_AP": ("nonshare",),
    "share_AP": ("share",),
    "share1_AP": ("share1",),
    "share2_AP": ("share2",),
}


def long_predictions(
    df: DataFrame, keep: Sequence[str] = ("subset",), targets: Sequence[str] = TARGETS
) -> DataFrame:
    """``pred_*``/``target_*`` columns as ``(protein, score, target)`` rows; the
    target is binarised at 0.5."""
    cells = F.array(*[
        F.struct(
            F.lit(t).alias("protein"),
            F.col(f"pred_{t}").cast("double").alias("score"),
            (F.col(f"target_{t}") > 0.5).cast("int").alias("target"),
        )
        for t in targets
    ])
    return df.select(*keep, F.inline(cells))


def score_counts(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and positives per score: equal scores are one threshold, and a score
    shared by many rows becomes one row before anything is ordered."""
    return long.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("target").cast("bigint").alias("pos"))


def ap_from_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Average precision per ``by`` from :func:`score_counts` rows:
    sum over descending thresholds of (recall step) * precision; NULL without
    positives."""
    by = list(by)
    # read three times below (cut points, bucket totals, running sums): written
    # once instead of scoring again
    counts = cut_lineage(counts)
    run = prefix_sums(
        quantile_bucket(counts, "score", descending=True),
        "__b",
        [F.desc("score")],
        {"cum_n": F.col("n"), "cum_pos": F.col("pos")},
        by,
    )
    area = F.sum(F.col("pos") * (F.col("cum_pos") / F.col("cum_n")))
    total = F.sum("pos")
    return run.groupBy(*by).agg(
        F.sum("n").alias("n"), total.alias("positives"), F.when(total > 0, area / total).alias("ap")
    )


def in_part(subsets: Sequence[int] | None) -> Column:
    return ~F.col("subset").eqNullSafe(F.lit(0)) if subsets is None else F.col("subset").isin(list(subsets))


def average_precision(
    df: DataFrame, by: Sequence[str] = (), targets: Sequence[str] = TARGETS, parts: Mapping[str, Sequence[int] | None] = PARTS
) -> DataFrame:
    """Average precision per named part and protein (and ``by``)."""
    by = list(by)
    counts = score_counts(long_predictions(df, [*by, "subset"], targets), [*by, "subset", "protein"])
    of = F.array_compact(F.array(*[F.when(in_part(s), F.lit(p)) for p, s in parts.items()]))
    named = counts.withColumn("part", F.explode(of))
    keys = [*by, "part", "protein"]
    merged = named.groupBy(*keys, "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return ap_from_counts(merged, keys)


def metric_rollup(ap: DataFrame, by: Sequence[str] = (), rollups: Mapping[str, Sequence[str]] = ROLLUPS) -> DataFrame:
    """Means over the available cells; a metric without any is dropped."""
    of = F.array_compact(F.array(*[F.when(F.col("part").isin(list(p)), F.lit(m)) for m, p in rollups.items()]))
    cells = ap.filter(F.col("ap").isNotNull() & ~F.isnan("ap")).withColumn("metric", F.explode(of))
    return cells.groupBy(*by, "metric").agg(F.avg("ap").alias("value"))


def micro_average_precision(df: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """One precision-recall curve over all proteins: all rows, subset 0, rest."""
    counts = score_counts(long_predictions(df, ["subset"], targets), ["subset"])
    of = F.array(F.lit("all"), F.when(in_part(None), F.lit("share")).otherwise(F.lit("nonshare")))
    merged = counts.withColumn("part", F.explode(of)).groupBy("part", "score").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos")
    )
    return ap_from_counts(merged, ["part"])


def row_log_loss(
    logit: Column, target: Column, pos_weight: float = 1.0, smoothing: float = 0.0, target_threshold: float | None = None
) -> Column:
    """Binary cross entropy of a logit, stable for large values.  Smoothing s
    moves targets to s/2 and 1 - s/2; with ``target_threshold`` they then become
    1 above it and 0 elsewhere."""
    y = F.when(target > 0.5, F.lit(1.0 - smoothing / 2)).otherwise(F.lit(smoothing / 2)) if smoothing else target
    if target_threshold is not None:
        y = F.when(y > target_threshold, F.lit(1.0)).otherwise(F.lit(0.0))
    weight = 1.0 + F.lit(pos_weight - 1.0) * y
    softplus = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (1.0 - y) * logit + weight * softplus


def log_loss(
    df: DataFrame,
    targets: Sequence[str] = TARGETS,
    pos_weight: float = 1.0,
    smoothing: float = 0.0,
    reduction: str = "mean",
    target_threshold: float | None = None,
) -> DataFrame:
    """``mean`` over all cells, ``sum``, or ``batch_mean`` = sum over rows / rows."""
    terms = [row_log_loss(F.col(f"pred_{t}"), F.col(f"target_{t}").cast("double"), pos_weight, smoothing, target_threshold) for t in targets]
    total = F.sum(sum(terms[1:], terms[0]))
    n = F.count(F.lit(1))
    value = {"sum": total, "batch_mean": total / n, "mean": total / (n * F.lit(len(targets)))}[reduction]
    return df.agg(value.alias("loss"))


def clean_predictions(df: DataFrame, preds: Sequence[str], flag: str = "had_nan") -> DataFrame:
    """A row with a NaN prediction gets 0 everywhere and is flagged."""
    bad = F.greatest(*[F.isnan(p).cast("int") for p in preds]) if len(preds) > 1 else F.isnan(preds[0]).cast("int")
    return df.withColumn(flag, bad).withColumns({
        p: F.when(F.col(flag) == 1, F.lit(0.0)).otherwise(F.col(p)) for p in preds
    })


def ordered_predictions(df: DataFrame, preds: Sequence[str], index: str, flag: str = "had_nan") -> tuple[DataFrame, DataFrame]:
    """``clean_predictions`` with the ``position`` of each row in the order of its
    unique ``index``, and one row ``(n_rows, n_nan)``."""
    cleaned = row_index(clean_predictions(df, preds, flag), [index], "position")
    return cleaned, cleaned.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col(flag).cast("bigint")), F.lit(0)).alias("n_nan"))


def best_metrics(
    log: DataFrame, modes: Mapping[str, str], default: str = "max", top_k: int = -1
) -> DataFrame:
    """Ranked log rows per metric.  At a step the best model counts; ties go to
    the later epoch, then the later step."""
    is_min = F.col("metric").isin([m for m, d in modes.items() if d == "min"])
    if default == "min":
        is_min = ~F.col("metric").isin([m for m, d in modes.items() if d == "max"])
    cost = F.when(is_min, F.col("value")).otherwise(-F.col("value"))
    best = log.groupBy("metric", "step").agg(
        F.min_by(F.struct("epoch", "model", "value"), F.struct(cost, F.col("model"))).alias("b")
    ).select("metric", "step", "b.*")
    order = [F.col("cost"), F.desc("epoch"), F.desc("step")]
    best = best.withColumn("cost", cost)
    if top_k > 0:
        # Catalyst keeps top_k rows per metric before the shuffle
        rank = F.row_number().over(W.partitionBy("metric").orderBy(*order))
        return best.withColumn("rank", rank).filter(F.col("rank") <= top_k).drop("cost")
    ranked = prefix_sums(quantile_bucket(best, "cost"), "__b", order, {"rank": F.lit(1)}, ["metric"])
    return ranked.withColumn("rank", F.col("rank").cast("int")).drop("cost", "__b")
