"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType

MIN_HOT_PARTS = 64
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def hot_parts(spark: SparkSession) -> int:
    """A key is hot when it holds more than one of so many parts of the rows: more
    than a shuffle partition should have.  There are fewer hot keys than parts."""
    return max(MIN_HOT_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and about ``max_bytes`` (an
    aggregate: a limit would gather its rows in one task)."""
    wide = [f.name for f in df.schema if not isinstance(f.dataType, (NumericType, BooleanType, DatetimeType))]
    width = F.lit(16 * len(df.columns)).cast("bigint")
    for name in wide:
        width = width + F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; otherwise a shuffle join is planned."""
    return F.broadcast(df) if fits(df, max_rows) else df


def scalar(df: DataFrame, expr: Column) -> Column:
    """One aggregate of ``df`` as a scalar subquery, evaluated inside the plan."""
    return df.select(expr).scalar()


def attach_totals(
    df: DataFrame,
    totals: DataFrame,
    keys: Sequence[str],
    count_col: str,
    spread_by: Sequence[str],
) -> DataFrame:
    """Left-join per-key ``totals`` (unique on ``keys``, with the row count of
    each key in ``count_col``) onto ``df``.

    Hot keys (fewer than ``hot_parts`` rows by construction) come from a
    broadcast; their rows are spread over salts in the shuffle join that serves
    all other keys, so no task receives a hot key whole.
    """
    keys = list(keys)
    values = [c for c in totals.columns if c not in keys]
    n_rows = scalar(totals, F.sum(count_col))
    parts = hot_parts(df.sparkSession)
    is_hot = F.col(count_col) * F.lit(parts) > n_rows
    renamed = [F.col(k).alias(f"__k_{k}") for k in keys]
    hot = totals.filter(is_hot).select(*renamed, F.struct(*values).alias("__hot"))
    # counts are positive, so this is always 0; a plain literal would be folded
    # out of the join keys and the salt would not take part in the shuffle
    zero = F.when(F.col(count_col) > 0, F.lit(0)).otherwise(F.lit(1))
    cold = totals.filter(~is_hot).select(*renamed, zero.alias("__k_salt"), F.struct(*values).alias("__cold"))
    salt = F.when(
        F.col("__hot").isNotNull(),
        F.pmod(F.xxhash64(*spread_by), F.lit(parts * 16)).cast("int") + 1,
    ).otherwise(F.lit(0))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    joined = (
        df.join(F.broadcast(hot), same, "left")
        .withColumn("__salt", salt)
        .drop(*[f"__k_{k}" for k in keys])
        .join(cold, [*same, F.col("__salt") == F.col("__k_salt")], "left")
    )
    picked = F.coalesce("__hot", "__cold")
    return joined.select(*df.columns, *[picked[v].alias(v) for v in values])


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``left`` (keys may be hot) with ``right`` (unique on ``keys``)."""
    keys = list(keys)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    values = [c for c in right.columns if c not in keys]
    totals = counts.join(right.withColumn("__found", F.lit(True)), keys, "left")
    out = attach_totals(left, totals, keys, "__n", spread_by or left.columns)
    if how == "inner":
        out = out.filter("__found")
    elif how == "left_anti":
        return out.filter("__found is null").select(*left.columns)
    elif how == "left_semi":
        return out.filter("__found").select(*left.columns)
    return out.select(*left.columns, *values)
