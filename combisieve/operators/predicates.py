"""Row predicates and label columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.operators.skew import fits, spread_join

INLINE_VALUES = 10_000


def member(col: str, values: Iterable) -> Column:
    """True or false: NULL is in no set, and no member."""
    return F.coalesce(F.col(col).isin([v for v in values if v is not None]), F.lit(False))


def in_sets(sets: Mapping[str, Iterable[int]], mode: str = "all") -> Column:
    """Predicate over ``{column: allowed values}``: all, any or none inside."""
    flags = [member(c, v) for c, v in sets.items()]
    if mode == "all":
        return reduce(and_, flags)
    if mode == "any":
        return reduce(or_, flags)
    if mode == "none":
        return ~reduce(or_, flags)
    raise ValueError(f"mode must be all, any or none, not {mode!r}")


def filter_in_set(df: DataFrame, members: Mapping[str, DataFrame], mode: str = "all") -> DataFrame:
    """Same predicate against member tables (first column = value).

    Small tables become literals of an ``isin``; larger ones are joined, with
    hot values spread over tasks.  Either way a NULL is in no set: mode ``none``
    keeps it.
    """
    inline, flags, out = {}, [], df
    for col, table in members.items():
        value = table.columns[0]
        distinct = table.select(F.col(value).alias(col)).filter(F.col(col).isNotNull()).distinct()
        if fits(distinct, INLINE_VALUES):
            inline[col] = [r[0] for r in distinct.collect()]
            flags.append(member(col, inline[col]))
        else:
            flag = f"__in_{col}"
            out = spread_join(out, distinct.withColumn(flag, F.lit(True)), [col], "left", df.columns)
            flags.append(F.coalesce(flag, F.lit(False)))
    keep = reduce(and_ if mode == "all" else or_, flags)
    if mode == "none":
        keep = ~keep
    elif mode not in ("all", "any"):
        raise ValueError(f"mode must be all, any or none, not {mode!r}")
    return out.filter(keep).select(*df.columns)


def size_between(df: DataFrame, size_col: str, low: int, high: int) -> DataFrame:
    return df.filter(F.col(size_col).between(low, high))


def bitmask_label(targets: Sequence[str] = TARGETS) -> Column:
    """First target is the highest bit: BRD4*4 + HSA*2 + sEH."""
    top = len(targets) - 1
    return reduce(lambda a, b: a + b, [F.col(t) * F.lit(1 << (top - i)) for i, t in enumerate(targets)])


def any_positive(targets: Sequence[str] = TARGETS) -> Column:
    return (F.greatest(*targets) > 0).cast("int")


def compact(df: DataFrame, drop: Sequence[str] = (), casts: Mapping[str, str] | None = None) -> DataFrame:
    """Exclude columns and narrow the types of others."""
    return df.drop(*drop).withColumns({c: F.col(c).cast(t) for c, t in (casts or {}).items()})


def assign_group(
    df: DataFrame,
    groups: DataFrame,
    cols: Sequence[str],
    name: str = "mol_group",
    default: int = -1,
) -> DataFrame:
    """Group of a row from a ``(group_id, member)`` table; a row whose blocks
    belong to several groups takes the last (highest) one, none gives ``default``."""
    best = groups.groupBy("member").agg(F.max("group_id").alias("group_id"))
    out, hits = df, []
    if fits(best, INLINE_VALUES):
        table = {r["member"]: r["group_id"] for r in best.collect()}
        lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else None
        hits = [lookup[F.col(c)] for c in cols] if table else [F.lit(None).cast("int")]
    else:
        for c in cols:
            hit = f"__g_{c}"
            out = spread_join(
                out, best.select(F.col("member").alias(c), F.col("group_id").alias(hit)), [c], "left", df.columns
            )
            hits.append(F.col(hit))
    top = F.greatest(*hits) if len(hits) > 1 else hits[0]
    return out.select(*df.columns, F.coalesce(top, F.lit(default)).cast("int").alias(name))


def segment_id(group: str, position: int, n_targets: int = len(TARGETS)) -> Column:
    return (F.col(group) * F.lit(n_targets) + F.lit(position)).cast("int")
