"""Long/wide conversion, dictionary encoding and row multiplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.functions.checks import require
from combisieve.functions.hashing import uniform
from combisieve.operators.joins import one_to_one
from combisieve.operators.ordering import row_index
from combisieve.operators.skew import broadcast_if_small, spread_join


def long_to_wide(
    df: DataFrame, key: Sequence[str], kind: str = "protein", value: str = "binds", kinds: Sequence[str] = TARGETS
) -> DataFrame:
    """One row per key, one column per kind."""
    return df.groupBy(*key).agg(*[F.max(F.when(F.col(kind) == k, F.col(value))).alias(k) for k in kinds])


def ids_to_wide(
    df: DataFrame,
    key: str,
    id_col: str = "id",
    kind: str = "protein",
    carry: Sequence[str] = (),
    kinds: Sequence[str] = TARGETS,
) -> DataFrame:
    """Ids per kind with 0 for "no such row"; ``carry`` columns depend on the
    key.  Sorted by the greatest id."""
    ids = [F.sum(F.when(F.col(kind) == k, F.col(id_col)).otherwise(F.lit(0))).alias(f"id_{k}") for k in kinds]
    wide = df.groupBy(key).agg(*ids, *[F.min(c).alias(c) for c in carry])
    return wide.withColumn("max_id", F.greatest(*[f"id_{k}" for k in kinds])).orderBy("max_id")


def wide_to_long(
    df: DataFrame, stems: Mapping[str, str], kind: str = "protein", kinds: Sequence[str] = TARGETS, drop_zero: str | None = "id"
) -> DataFrame:
    """``{output column: input prefix}`` flattened to one row per kind; rows
    whose ``drop_zero`` column is 0 do not exist."""
    cells = F.array(
        *[F.struct(F.lit(k).alias(kind), *[F.col(f"{p}{k}").alias(o) for o, p in stems.items()]) for k in kinds]
    )
    used = {f"{p}{k}" for p in stems.values() for k in kinds}
    keep = [c for c in df.columns if c not in used]
    out = df.select(*keep, F.explode(cells).alias("__c")).select(*keep, "__c.*")
    return out.filter(F.col(drop_zero) != 0) if drop_zero else out


def attach_by_index(left: DataFrame, right: DataFrame, index: str = "index") -> DataFrame:
    """Side-by-side tables by key; any row without its one partner fails the query."""
    return one_to_one(left, right, index)


def build_dictionary(columns: Sequence[tuple[DataFrame, str]], value: str = "value", name: str = "id") -> DataFrame:
    """Distinct values over several columns and tables, ids in value order."""
    parts = [t.select(F.col(c).alias(value)) for t, c in columns]
    return row_index(reduce(DataFrame.unionByName, parts).distinct(), [value], name)


def map_values(
    df: DataFrame, dictionary: DataFrame, cols: Sequence[str], value: str = "value", name: str = "id", default: int = -1
) -> DataFrame:
    """Replace each column by its dictionary id, ``default`` when unknown."""
    small = broadcast_if_small(dictionary)
    out = df
    for c in cols:
        right = small.select(F.col(value).alias(c), F.col(name).alias(f"__id_{c}"))
        if small is dictionary:
            out = spread_join(out, right, [c], "left", df.columns)
        else:
            out = out.join(F.broadcast(right), c, "left")
    mapped = {c: F.coalesce(f"__id_{c}", F.lit(default)) for c in cols}
    return out.select(*[mapped[c].alias(c) if c in mapped else F.col(c) for c in df.columns])


def encode(
    df: DataFrame, dictionary: DataFrame, cols: Sequence[str], value: str = "value", name: str = "id"
) -> DataFrame:
    """Dictionary encoding where an unknown value is an error."""
    out = map_values(df, dictionary, cols, value, name)
    return out.withColumns({c: require(F.col(c) >= 0, F.col(c), f"unknown value in {c}") for c in cols})


def unmapped_report(df: DataFrame, cols: Sequence[str], default: int = -1) -> DataFrame:
    """``(column, n_unmapped)`` after :func:`map_values`."""
    sums = df.agg(*[F.sum((F.col(c) == default).cast("bigint")).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_unmapped")) for c in cols])
    return sums.select(F.inline(cells))


def replicate_by_group(df: DataFrame, group: str, times: Mapping[int, int], copy: str = "copy") -> DataFrame:
    """Repeat each row as often as its group says; groups not listed once."""
    n = F.coalesce(F.create_map(*[F.lit(x) for kv in times.items() for x in kv])[F.col(group)], F.lit(1))
    return df.withColumn("__n", n).filter("__n > 0").withColumn(
        copy, F.explode(F.sequence(F.lit(1), F.col("__n")))
    ).drop("__n")


def swap_pair(df: DataFrame, ids: Sequence[str], a: str = "bb2", b: str = "bb3", p: float = 0.5, seed: int = 42) -> DataFrame:
    """Swap two columns in a row with probability ``p``."""
    hit = uniform(*ids, seed=seed) < F.lit(p)
    return df.withColumns({
        a: F.when(hit, F.col(b)).otherwise(F.col(a)),
        b: F.when(hit, F.col(a)).otherwise(F.col(b)),
    })


def pair_key(a: str, b: str) -> Column:
    """Order-free key of two blocks."""
    return F.concat_ws("_", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def canonical_combo(*cols: str) -> Column:
    """Order-free key of several blocks."""
    return F.concat_ws("_", F.array_sort(F.array(*cols)).cast("array<string>"))


def mirrored_combos(df: DataFrame, first: str = "bb1", a: str = "bb2", b: str = "bb3") -> DataFrame:
    """Block combinations that occur with ``a`` and ``b`` in both orders."""
    seen = df.groupBy(first, F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max((F.col(a) < F.col(b)).cast("int")).alias("forward"),
        F.max((F.col(a) > F.col(b)).cast("int")).alias("backward"),
    )
    return seen.filter("forward = 1 and backward = 1").select(first, "low", "high", "n_rows")


def combo_coverage(df: DataFrame, first: str = "bb1", a: str = "bb2", b: str = "bb3") -> DataFrame:
    """Observed and possible block combinations; the unordered variant counts
    ``a``/``b`` as one set of n blocks with n(n+1)/2 pairs."""
    # distinct combinations first, so that the shuffle carries no copies
    combos = df.select(first, a, b).distinct()
    lo, hi = F.least(a, b), F.greatest(a, b)
    sides = combos.select(first, a, b, F.explode(F.array(a, b)).alias("__x"))
    stats = sides.agg(
        F.countDistinct(first).alias("n_first"),
        F.countDistinct(a).alias("n_a"),
        F.countDistinct(b).alias("n_b"),
        F.countDistinct("__x").alias("n_pair_blocks"),
        F.countDistinct(F.struct(first, a, b)).alias("observed"),
        F.countDistinct(F.struct(F.col(first), lo, hi)).alias("observed_unordered"),
    )
    n = F.col("n_pair_blocks")
    unordered = F.col("n_first") * ((n * (n + 1)) / 2)
    possible = F.col("n_first") * F.col("n_a") * F.col("n_b")
    return stats.withColumns({
        "possible": possible,
        "possible_unordered": unordered.cast("bigint"),
        "coverage": F.col("observed") / possible,
        "coverage_unordered": F.col("observed_unordered") / unordered,
    })
