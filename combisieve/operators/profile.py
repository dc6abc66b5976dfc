"""Column, key and group profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from combisieve import TARGETS
from combisieve.operators.ordering import bucket_bits, prefix_sums, quantile_bucket
from combisieve.operators.skew import attach_totals, broadcast_if_small, scalar
from combisieve.session import cut_lineage

# the largest finite half-precision number
HALF_MAX = 65504.0


def unpivot_struct(one_row: DataFrame, cells: Mapping[str, Mapping[str, Column]], key: str = "column") -> DataFrame:
    """Turn one wide aggregate row into one row per column."""
    return one_row.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias(key), *[e.alias(n) for n, e in v.items()]) for k, v in cells.items()]))
    )


def n_unique(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct count of every column, exact or by a mergeable sketch."""
    cols = list(cols or df.columns)
    if approx:
        one = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
    else:
        one = df.agg(*[F.countDistinct(c).alias(c) for c in cols])
    return unpivot_struct(one, {c: {"n_unique": F.col(c)} for c in cols})


def quantile(col: str, p: float, kind: str = "disc") -> Column:
    """Aggregate for columns with few distinct values (it keeps one counter per
    value): ``disc`` returns an observed value, ``cont`` interpolates."""
    if kind == "cont":
        return F.percentile(col, F.lit(p))
    if kind == "approx":
        return F.percentile_approx(col, p, 10_000)
    return F.expr(f"percentile_disc({p}) within group (order by `{col}`)")


def quantiles_from_counts(
    counts: DataFrame, by: Sequence[str], value: str, percentiles: Sequence[float], kind: str = "disc", bucket: str | None = None
) -> DataFrame:
    """Exact quantiles ``p01..p99`` per ``by`` from ``(by, value, n)`` rows.

    The values are cumulated in buckets, so neither a continuous column nor one
    group with most of the rows has to fit a single task.
    """
    by = list(by)
    counts = cut_lineage(counts)
    src = counts if bucket else quantile_bucket(counts, value)
    run = prefix_sums(src, bucket or "__b", [F.col(value)], {"__cum": F.col("n")}, by)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__n"))
    run = run.join(broadcast_if_small(totals), by) if by else run.withColumn("__n", scalar(counts, F.sum("n")))

    def at(rank: Column) -> Column:
        inside = (F.col("__cum") >= rank) & (F.col("__cum") - F.col("n") < rank)
        return F.max(F.when(inside, F.col(value).cast("double")))

    out = []
    for p in percentiles:
        name = f"p{round(p * 100):02d}"
        if kind == "cont":
            pos = F.lit(p) * (F.col("__n") - 1)
            low, high = at(F.floor(pos) + 1), at(F.ceil(pos) + 1)
            out.append((low + (high - low) * F.max(pos - F.floor(pos))).alias(name))
        else:
            out.append(at(F.greatest(F.ceil(F.lit(p) * F.col("__n")), F.lit(1))).alias(name))
    return run.groupBy(*by).agg(*out)


def column_quantiles(df: DataFrame, cols: Sequence[str], percentiles: Sequence[float], kind: str = "disc") -> DataFrame:
    """Exact quantiles of several columns in one pass over the rows."""
    cols = list(cols)
    n = 2 ** min(12, bucket_bits(df.sparkSession))
    cuts = df.approxQuantile(cols, [i / n for i in range(1, n)], 1 / (4 * n))
    src = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    src = Bucketizer(
        splitsArray=[[float("-inf"), *sorted(set(c)), float("inf")] for c in cuts],
        inputCols=cols,
        outputCols=[f"__b_{c}" for c in cols],
        handleInvalid="keep",
    ).transform(src)
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__b_{c}").cast("int").alias("__b"), F.col(c).alias("value")) for c in cols
    ])
    counts = src.select(F.inline(cells)).filter("value is not null").groupBy("column", "__b", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    return quantiles_from_counts(counts, ["column"], "value", percentiles, kind, "__b")


def describe(
    df: DataFrame, cols: Sequence[str], percentiles: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99), kind: str = "disc"
) -> DataFrame:
    """count, null count, mean, std, min, max and percentiles per column:
    ``disc`` and ``cont`` are exact, ``approx`` is a sketch."""
    aggs, cells = [], {}
    for c in cols:
        stats = {
            "n": F.count(c),
            "n_null": F.sum(F.col(c).isNull().cast("bigint")),
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
            "min": F.min(c).cast("double"),
            "max": F.max(c).cast("double"),
        }
        if kind == "approx":
            stats |= {f"p{round(p * 100):02d}": quantile(c, p, kind).cast("double") for p in percentiles}
        aggs += [e.alias(f"{c}__{n}") for n, e in stats.items()]
        cells[c] = {n: F.col(f"{c}__{n}") for n in stats}
    basic = unpivot_struct(df.agg(*aggs), cells)
    if kind == "approx":
        return basic
    return basic.join(column_quantiles(df, cols, percentiles, kind), "column", "left")


def positive_rate(df: DataFrame, key: Sequence[str], targets: Sequence[str] = TARGETS) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(t).alias(t) for t in targets])


def positive_rate_union(
    df: DataFrame, cols: Sequence[str] = ("bb2", "bb3"), name: str = "bb23", targets: Sequence[str] = TARGETS
) -> DataFrame:
    """Rate per block over the rows that have it in any of ``cols``; a row with
    the block twice counts once.

    Rows are first summed per block combination on the map side, so a hot block
    costs one partial row per combination and task.
    """
    sums = [F.sum(t).alias(t) for t in targets]
    pre = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), *sums)
    per = pre.select("n", *targets, F.explode(F.array_distinct(F.array(*cols))).alias(name))
    return per.groupBy(name).agg(F.sum("n").alias("n"), *sums).select(
        name, "n", *[(F.col(t) / F.col("n")).alias(t) for t in targets]
    )


def overall_positives(df: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Sum and mean per target and the micro mean over all cells."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("n"), *[F.sum(t).alias(t) for t in targets])
    cells = {t: {"positives": F.col(t), "rate": F.col(t) / F.col("n")} for t in targets}
    every = sum((F.col(t) for t in targets[1:]), F.col(targets[0]))
    cells["micro"] = {"positives": every, "rate": every / (F.col("n") * F.lit(len(targets)))}
    return unpivot_struct(one, cells, "target")


def set_overlap(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Sizes, overlap, union and ratios of the value sets of one column."""
    marked = a.select(col, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(col, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    flags = marked.groupBy(col).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = flags.agg(
        F.sum("a").alias("n_a"),
        F.sum("b").alias("n_b"),
        F.sum(F.col("a") * F.col("b")).alias("n_overlap"),
        F.sum(F.col("b") * (1 - F.col("a"))).alias("n_b_only"),
        F.count(F.lit(1)).alias("n_union"),
    )
    return out.select(
        F.lit(col).alias("column"),
        "*",
        (F.col("n_overlap") / F.col("n_a")).alias("overlap_of_a"),
        (F.col("n_overlap") / F.col("n_b")).alias("overlap_of_b"),
        (F.col("n_overlap") / F.col("n_union")).alias("overlap_of_union"),
    )


def value_counts(df: DataFrame, key: Sequence[str], first: str | None = None, order: str | None = None) -> DataFrame:
    """Rows per key and, optionally, ``first`` of the row lowest in ``order``."""
    extra = [F.min_by(first, order).alias(f"first_{first}")] if first else []
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *extra)


def size_histogram(df: DataFrame, key: str) -> DataFrame:
    """``(size, n_groups)``: n rows have at most sqrt(2n) distinct sizes."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def group_size_distribution(df: DataFrame, key: str, over: Sequence[int] = (10, 100, 1000)) -> DataFrame:
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("size").alias("n_rows"),
        F.sum((F.col("size") == 1).cast("bigint")).alias("n_single"),
        F.avg("size").alias("mean_size"),
        F.max("size").alias("max_size"),
        quantile("size", 0.5).alias("p50"),
        quantile("size", 0.9).alias("p90"),
        quantile("size", 0.99).alias("p99"),
        *[F.sum((F.col("size") > t).cast("bigint")).alias(f"over_{t}") for t in over],
    )


def concentration(df: DataFrame, key: str, row_share: float = 0.8) -> DataFrame:
    """Cumulative share of groups and rows by group size, from the largest and
    from the smallest; ``is_cut`` marks the size where the groups up to it first
    hold ``row_share`` of the rows."""
    hist = cut_lineage(size_histogram(df, key).withColumn("rows", F.col("size") * F.col("n_groups")))
    sums = {"groups_up_to": F.col("n_groups"), "rows_up_to": F.col("rows")}
    # a size histogram is one row per size, so the buckets are balanced
    run = prefix_sums(quantile_bucket(hist, "size"), "__b", [F.col("size")], sums)
    all_groups, all_rows = scalar(hist, F.sum("n_groups")), scalar(hist, F.sum("rows"))
    at, before = F.col("rows_up_to"), F.col("rows_up_to") - F.col("rows")
    goal = F.lit(row_share) * all_rows
    return run.select(
        "size",
        "n_groups",
        "groups_up_to",
        "rows_up_to",
        ((all_groups - F.col("groups_up_to") + F.col("n_groups")) / all_groups).alias("top_group_share"),
        ((all_rows - before) / all_rows).alias("top_row_share"),
        ((at >= goal) & (before < goal)).alias("is_cut"),
    )


def histogram(df: DataFrame, col: str, bins: int, log: bool = False) -> DataFrame:
    """Fixed-width bins between min and max; the top edge joins the last bin."""
    x = df.select((F.log10(col) if log else F.col(col).cast("double")).alias("x")).filter("x is not null")
    edge = x.select(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    width = (edge["hi"] - edge["lo"]) / F.lit(bins)
    pos = F.when(edge["hi"] > edge["lo"], F.floor((F.col("x") - edge["lo"]) / width)).otherwise(F.lit(0))
    return x.groupBy(F.least(pos, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def binned_mean(df: DataFrame, x: str | Column, y: str, width: float) -> DataFrame:
    """Mean of ``y`` in floor-divided bins of ``x``."""
    c = F.col(x) if isinstance(x, str) else x
    return df.groupBy(F.floor(c / F.lit(width)).cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean")
    )


def iqr_outliers(rates: DataFrame, key: str, k: float, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Keys above q3 + k*(q3 - q1) for at least one target."""
    q = {t: (scalar(rates, quantile(t, 0.25, "cont")), scalar(rates, quantile(t, 0.75, "cont"))) for t in targets}
    over = {f"over_{t}": (F.col(t) > q3 + F.lit(k) * (q3 - q1)).cast("int") for t, (q1, q3) in q.items()}
    return rates.select(key, *[e.alias(n) for n, e in over.items()]).filter(
        " or ".join(f"{n} = 1" for n in over)
    )


def weighted_positive_share(df: DataFrame, weight: str, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Share of the total weight on positives, per target and for any target."""
    w = F.col(weight)
    tests = {t: F.col(t) > 0 for t in targets}
    tests["any"] = F.greatest(*targets) > 0
    one = df.agg(F.sum(w).alias("__all"), *[F.sum(F.when(c, w).otherwise(F.lit(0.0))).alias(t) for t, c in tests.items()])
    return unpivot_struct(one, {t: {"share": F.col(t) / F.col("__all")} for t in tests}, "target")


def split_stats(
    df: DataFrame,
    in_bb1: Column,
    in_bb2: Column,
    in_bb3: Column,
    unique: Sequence[str],
    targets: Sequence[str] = TARGETS,
    cell: Sequence[str] = (),
) -> DataFrame:
    """Count, percentage, distinct values and positive % of the rows with all
    blocks held out and of those with any; one result row per ``cell``."""
    modes = {"all_in": in_bb1 & in_bb2 & in_bb3, "any_in": in_bb1 | in_bb2 | in_bb3}
    hits = F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in modes.items()]))
    total = scalar(df, F.count(F.lit(1)))
    return (
        df.withColumn("mode", F.explode(hits))
        .groupBy(*cell, "mode")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.countDistinct(c).alias(f"n_unique_{c}") for c in unique],
            *[(F.avg(t) * 100).alias(f"pct_{t}") for t in targets],
        )
        .withColumn("pct", F.col("n") * 100 / total)
    )


def column_values(df: DataFrame, features: str, by: Sequence[str] = ()) -> DataFrame:
    """``(col, value, n)`` over an array column, per chunk when ``by`` is given."""
    cells = df.select(*by, F.posexplode(features).alias("col", "value"))
    return cells.groupBy(*by, "col", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_column_values(chunks: DataFrame) -> DataFrame:
    """Counts of separate chunks merge by addition."""
    return chunks.groupBy("col", "value").agg(F.sum("n").alias("n"))


def profile_from_values(values: DataFrame, show: int = 3) -> DataFrame:
    """Distinct count, constant flag and, up to ``show`` (at most 3) distinct
    values, the count of the lowest, highest and middle one."""
    return values.groupBy("col").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.sum("n").alias("n_rows"),
        F.min(F.struct("value", "n")).alias("__lo"),
        F.max(F.struct("value", "n")).alias("__hi"),
    ).select(
        "col",
        "n_values",
        "n_rows",
        (F.col("n_values") == 1).alias("is_constant"),
        F.when(F.col("n_values") <= show, F.col("__lo.n")).alias("n_lowest"),
        F.when((F.col("n_values") <= show) & (F.col("n_values") > 1), F.col("__hi.n")).alias("n_highest"),
        F.when(
            F.col("n_values") == 3, F.col("n_rows") - F.col("__lo.n") - F.col("__hi.n")
        ).alias("n_middle"),
    )


def column_profile(df: DataFrame, features: str) -> DataFrame:
    return profile_from_values(column_values(df, features))


def nan_rate(df: DataFrame, features: str) -> DataFrame:
    """Share of missing or NaN cells and number of distinct other values."""
    cells = df.select(F.posexplode(features).alias("col", "value"))
    bad = F.col("value").isNull() | F.isnan("value")
    counts = cells.groupBy("col", F.when(~bad, F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("col").agg(
        (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("nan_rate"),
        F.count("value").alias("n_values"),
    ).withColumn("few_values", F.col("n_values") <= 2)


def unparseable(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    """Number of non-null values per text column that do not parse as ``to``."""
    aggs = [F.sum((F.col(c).isNotNull() & F.col(c).try_cast(to).isNull()).cast("bigint")).alias(c) for c in cols]
    return unpivot_struct(df.agg(*aggs), {c: {"n_bad": F.col(c)} for c in cols})


def column_range(df: DataFrame, features: str) -> DataFrame:
    """Minimum and maximum per position, NaN ignored."""
    cells = df.select(F.posexplode(features).alias("col", "value")).filter(~F.isnan("value"))
    return cells.groupBy("col").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def half_overflow(df: DataFrame, features: str) -> DataFrame:
    """Columns with a value outside the half-precision range."""
    wide = (F.col("max") > HALF_MAX) | (F.col("min") < -HALF_MAX)
    return column_range(df, features).filter(wide)


def one_sided_columns(train: DataFrame, test: DataFrame, features: str) -> DataFrame:
    """Columns whose test values all lie on one side of the train range."""
    a = column_range(train, features).select("col", F.col("min").alias("train_min"), F.col("max").alias("train_max"))
    b = column_range(test, features).select("col", F.col("min").alias("test_min"), F.col("max").alias("test_max"))
    side = F.when(F.col("test_min") > F.col("train_max"), F.lit("above")).when(
        F.col("test_max") < F.col("train_min"), F.lit("below")
    )
    return a.join(b, "col").withColumn("side", side).filter("side is not null")


def integrity_checks(
    long: DataFrame, key: str = "mol_id", kind: str = "protein", kinds: Sequence[str] = TARGETS
) -> DataFrame:
    """``(check, ok, n_bad)`` for a long assay table: each key has exactly the
    given kinds, keys are in range and counts add up."""
    bits = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, 1 << i)])
    full = (1 << len(kinds)) - 1
    per = long.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_or(F.coalesce(bits[F.col(kind)], F.lit(1 << len(kinds)))).alias("mask"),
    )
    one = per.agg(
        F.sum((F.col("mask") != full).cast("bigint")).alias("kinds"),
        F.sum((F.col("n") != len(kinds)).cast("bigint")).alias("rows"),
        F.sum((F.col(key) < 0).cast("bigint")).alias("range"),
        F.abs(F.sum("n") - F.count(F.lit(1)) * len(kinds)).alias("total"),
    )
    checks = {"every_kind_present": "kinds", "one_row_per_kind": "rows", "key_in_range": "range", "counts_add_up": "total"}
    return unpivot_struct(
        one, {k: {"ok": F.col(v) == 0, "n_bad": F.col(v)} for k, v in checks.items()}, "check"
    )


def disjoint_check(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values that two tables share, as a ``(check, ok, n_bad)`` row."""
    shared = a.select(col).distinct().join(b.select(col).distinct(), col, "left_semi")
    n = F.count(F.lit(1))
    return shared.agg(F.lit(f"disjoint_{col}").alias("check"), (n == 0).alias("ok"), n.alias("n_bad"))


def with_group_stats(df: DataFrame, key: str, spread_by: Sequence[str], stats: Mapping[str, Column], count: str = "group_size") -> DataFrame:
    """Per-key count and sums on every row (a window over the key, built so
    that a key with most of the rows does not meet in one task)."""
    totals = df.groupBy(key).agg(F.count(F.lit(1)).alias(count), *[e.alias(n) for n, e in stats.items()])
    return attach_totals(df, totals, [key], count, spread_by)


def by_frequency(df: DataFrame, group: str, value: str) -> DataFrame:
    """Values sorted by the size of their group, then by value, descending."""
    sized = with_group_stats(df, group, [value], {}, "frequency")
    return sized.orderBy(F.desc("frequency"), F.desc(value))


def top_k_features(importance: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` features of highest importance, overall or per class."""
    order = [F.desc("importance"), F.asc("feature")]
    if not by:
        return importance.orderBy(*order).limit(k)
    # Catalyst limits each partition to k rows per class before the shuffle
    rn = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return importance.withColumn("__rn", rn).filter(F.col("__rn") <= k).drop("__rn")
