"""Checked joins and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from combisieve.functions.checks import require
from combisieve.operators.skew import fits, spread_join


def left_join_m1(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Left join that fails when a key repeats on the right.

    The uniqueness test is a group-by on the join key, so it shares the join's
    partitioning instead of adding a pass.
    """
    on = list(on)
    values = [c for c in right.columns if c not in on]
    packed = right.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), F.max(F.struct(*values)).alias("__v"))
    # checked in the key, which no column pruning can take out of the join
    unique = packed.select(*[require(F.col("__n") == 1, F.col(k), "join key repeats on the right").alias(k) for k in on], "__v")
    if fits(right):
        out = left.join(F.broadcast(unique), on, "left")
    else:
        out = spread_join(left, unique, on, "left", left.columns)
    return out.select(
        *left.columns, *[F.col("__v")[v].alias(f"{v}{suffix}" if v in left.columns else v) for v in values]
    )


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows side by side; a key that does not stand exactly once on both sides
    (a NULL stands on neither) fails the query, whatever columns are read."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    both = left.withColumn("__l", n).join(right.withColumn("__r", n), key, "full_outer")
    ok = (F.coalesce("__l", F.lit(0)) == 1) & (F.coalesce("__r", F.lit(0)) == 1)
    return both.filter(require(ok, F.lit(True), f"tables do not have the same {key} values, once each")).drop("__l", "__r")


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], inside: bool = True) -> DataFrame:
    """Semi join (``inside``) or anti join by a key list that may be large."""
    distinct = keys.select(*on).distinct()
    if fits(distinct):
        return df.join(F.broadcast(distinct), list(on), "left_semi" if inside else "left_anti").select(*df.columns)
    return spread_join(df, distinct, on, "left_semi" if inside else "left_anti")


def union_tagged(first: DataFrame, second: DataFrame, name: str = "is_train") -> DataFrame:
    """Vertical concatenation with an origin flag (1 for ``first``)."""
    return first.withColumn(name, F.lit(1)).unionByName(second.withColumn(name, F.lit(0)))


def set_algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each distinct value of two one-column tables with its set memberships."""
    value = a.columns[0]
    both = a.select(value, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(
        b.select(F.col(b.columns[0]).alias(value), F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    )
    flags = both.groupBy(value).agg(F.max("__a").alias("in_a"), F.max("__b").alias("in_b"))
    return flags.select(
        value,
        (F.col("in_a") * F.col("in_b")).alias("in_both"),
        (F.col("in_a") * (1 - F.col("in_b"))).alias("only_a"),
        (F.col("in_b") * (1 - F.col("in_a"))).alias("only_b"),
    )


def sets_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: are the two value sets the same?"""
    flags = set_algebra(a, b)
    return flags.agg((F.coalesce(F.sum(F.col("only_a") + F.col("only_b")), F.lit(0)) == 0).alias("equal"))
