"""Rate baselines and label smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.operators.joins import left_join_m1
from combisieve.operators.profile import positive_rate, positive_rate_union, quantiles_from_counts
from combisieve.session import cut_lineage

# Ways to combine the rates p1 (first block) and p2, p3 (pair blocks).
FORMS = {
    "product": lambda p1, p2, p3: p1 * p2 * p3,
    "at_least_one": lambda p1, p2, p3: 1.0 - (1.0 - p1) * (1.0 - p2) * (1.0 - p3),
    "first_and_any": lambda p1, p2, p3: p1 * (1.0 - (1.0 - p2) * (1.0 - p3)),
    "first_times_sum": lambda p1, p2, p3: p1 * (p2 + p3),
    "first_times_min": lambda p1, p2, p3: p1 * F.least(p2, p3),
    "first_times_max": lambda p1, p2, p3: p1 * F.greatest(p2, p3),
}


def rate_baseline(
    train: DataFrame, scored: DataFrame, forms: Sequence[str] = ("product",), targets: Sequence[str] = TARGETS
) -> DataFrame:
    """``scored`` plus ``pred_{target}`` (one form) or ``{form}_{target}``:
    scores from the positive rates of the blocks in ``train``; an unknown block
    has rate 0."""
    # one row per block, joined (and size-checked) several times
    first = cut_lineage(positive_rate(train, ["bb1"], targets).drop("n"))
    first = first.withColumnsRenamed({t: f"__1{t}" for t in targets})
    pair = cut_lineage(positive_rate_union(train, ("bb2", "bb3"), "bb23", targets).drop("n"))
    out = left_join_m1(scored, first, ["bb1"])
    for col, tag in (("bb2", "__2"), ("bb3", "__3")):
        side = pair.withColumnsRenamed({"bb23": col, **{t: f"{tag}{t}" for t in targets}})
        out = left_join_m1(out, side, [col])
    preds = []
    for form in forms:
        for t in targets:
            rates = [F.coalesce(f"__{i}{t}", F.lit(0.0)) for i in (1, 2, 3)]
            name = f"pred_{t}" if len(forms) == 1 else f"{form}_{t}"
            preds.append(FORMS[form](*rates).alias(name))
    return out.select(*scored.columns, *preds)


def minmax_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns scaled to [0, 1] over the table; a constant column becomes 0."""
    edges = df.select(F.struct(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols])).scalar()
    out = {}
    for c in cols:
        lo, hi = edges[f"lo_{c}"], edges[f"hi_{c}"]
        out[c] = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return df.withColumns(out)


def class_cutoffs(
    df: DataFrame, score: str = "pred_", label: str = "target_", p: float = 0.99, targets: Sequence[str] = TARGETS, kind: str = "disc"
) -> DataFrame:
    """``(protein, label, cutoff)``: a high percentile of the score per target
    and class, exact however large a class is."""
    cells = F.array(*[
        F.struct(F.lit(t).alias("protein"), F.col(f"{label}{t}").cast("int").alias("label"), F.col(f"{score}{t}").alias("score"))
        for t in targets
    ])
    counts = df.select(F.inline(cells)).groupBy("protein", "label", "score").agg(F.count(F.lit(1)).alias("n"))
    name = f"p{round(p * 100):02d}"
    return quantiles_from_counts(counts, ["protein", "label"], "score", [p], kind).withColumnRenamed(name, "cutoff")


def smooth_label(x: Column, label: Column, cut0: Column, cut1: Column, base: float = 0.05, mul: float = 0.15) -> Column:
    """Soft label: negatives start at ``base``, positives at 1 - base - mul, and
    both grow with the score up to the cutoff of their class."""
    if base + mul >= 0.5:
        raise ValueError("base + mul must stay below 0.5")
    rise = lambda c: F.least(x, c) * (F.lit(mul) / c)
    return F.when(label == 0, F.lit(base) + rise(cut0)).otherwise(F.lit(1.0 - base - mul) + rise(cut1))


def smooth_labels(
    df: DataFrame, cutoffs: DataFrame, score: str = "pred_", label: str = "target_", out: str = "smooth_",
    targets: Sequence[str] = TARGETS, base: float = 0.05, mul: float = 0.15,
) -> DataFrame:
    """Soft labels with the cutoffs of :func:`class_cutoffs` (two per target)."""
    cut = {(r["protein"], r["label"]): r["cutoff"] for r in cutoffs.collect()}
    return df.withColumns({
        f"{out}{t}": smooth_label(
            F.col(f"{score}{t}"), F.col(f"{label}{t}"), F.lit(cut.get((t, 0))).cast("double"),
            F.lit(cut.get((t, 1))).cast("double"), base, mul,
        )
        for t in targets
    })
