"""Bit and dense feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combisieve.functions.exprs import let
from combisieve.operators.joins import one_to_one
from combisieve.operators.profile import HALF_MAX, column_range, top_k_features


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- bits ------------------------------------------------------------------

def pack_bits(bits: Column | str) -> Column:
    """0/1 array to bytes, first bit highest, last byte filled with zeros."""
    def pack(c: Column) -> Column:
        def byte(i: Column) -> Column:
            part = F.slice(c, i * 8 + 1, F.lit(8))
            value = F.aggregate(part, F.lit(0), lambda acc, b: acc * 2 + b.cast("int"))
            return (value * F.pow(F.lit(2.0), F.lit(8) - F.size(part))).cast("int")

        n_bytes = F.floor((F.size(c) + 7) / 8).cast("int")
        packed = F.transform(F.sequence(F.lit(0), n_bytes - 1), byte)
        return F.when(n_bytes > 0, packed).otherwise(F.array().cast("array<int>"))

    return let(_c(bits), pack)


def unpack_bits(packed: Column | str) -> Column:
    """Bytes to a 0/1 array, eight per byte, highest bit first."""
    weights = F.array(*[F.lit(1 << (7 - i)) for i in range(8)])
    return F.flatten(F.transform(_c(packed), lambda b: F.transform(weights, lambda w: (b.bitwiseAND(w) > 0).cast("int"))))


def on_bits(bits: Column | str) -> Column:
    """``set`` format: positions of the on bits."""
    tagged = F.transform(_c(bits), lambda b, i: F.when(b > 0, i))
    return F.array_compact(tagged)


def offset_bits(bits: Column | str) -> Column:
    """``seq_v2`` format: 2*i + bit."""
    return F.transform(_c(bits), lambda b, i: i * 2 + b.cast("int"))


def bit_formats(packed: Column | str, fmt: str = "seq") -> Column:
    bits = unpack_bits(packed)
    if fmt == "seq":
        return bits
    if fmt == "set":
        return on_bits(bits)
    if fmt == "seq_v2":
        return offset_bits(bits)
    raise ValueError(f"unknown bit format {fmt!r}")


def project_bits(packed: Column | str, positions: Sequence[int]) -> Column:
    """0/1 array of the chosen positions of packed bytes, in that order, tested
    where they stand: nothing is unpacked.  Positions behind the end are 0."""
    if not positions:
        return F.array().cast("array<int>")
    places = F.array(*[F.struct(F.lit(p // 8).alias("byte"), F.lit(1 << (7 - p % 8)).alias("mask")) for p in positions])
    return let(_c(packed), lambda c: F.transform(
        places, lambda x: F.coalesce(F.get(c, x["byte"]).bitwiseAND(x["mask"]) > 0, F.lit(False)).cast("int")))


def project_top_features(
    df: DataFrame, packed: str, importance: DataFrame, k: int, by: str | None = None, prefix: str = "top"
) -> DataFrame:
    """``df`` with the bits of the ``k`` best features of ``importance(feature,
    importance)``, best first: a column ``<prefix>``, or one ``<prefix>_<class>``
    per class of ``by``.  ``k`` rows per class come to the driver."""
    best = top_k_features(importance, k, [by] if by else [])
    rows = sorted(best.collect(), key=lambda r: (-r["importance"], r["feature"]))
    classes = sorted({r[by] for r in rows}) if by else [None]
    return df.withColumns({
        prefix if c is None else f"{prefix}_{c}": project_bits(packed, [r["feature"] for r in rows if by is None or r[by] == c]) for c in classes
    })


def popcount(words: Column | str) -> Column:
    return F.aggregate(_c(words), F.lit(0), lambda a, w: a + F.bit_count(w))


def bit_density(df: DataFrame, packed: str) -> DataFrame:
    """Share of on bits and of non-zero bytes."""
    on = F.sum(popcount(packed).cast("bigint"))
    used = F.sum(F.size(F.filter(packed, lambda b: b != 0)).cast("bigint"))
    total = F.sum(F.size(packed).cast("bigint"))
    return df.agg((on / (total * 8)).alias("bit_density"), (used / total).alias("byte_density"))


# --- dense vectors ----------------------------------------------------------

def keep_columns(vector: Column | str, positions: Sequence[int]) -> Column:
    places = F.array(*[F.lit(int(p)) for p in positions])
    return let(_c(vector), lambda c: F.transform(places, lambda p: F.get(c, p)))


def drop_columns(vector: Column | str, positions: Sequence[int]) -> Column:
    """All but an ignore list."""
    gone = F.array(*[F.lit(int(p)) for p in positions]) if positions else F.array().cast("array<int>")
    return F.filter(_c(vector), lambda _, i: ~F.array_contains(gone, i))


def concat_features(tables: Sequence[tuple[DataFrame, str]], key: str, name: str | None = "features") -> DataFrame:
    """Feature tables side by side by key: one long vector, or one column per
    table when ``name`` is None.  A key that a table lacks or repeats fails the
    query."""
    out = None
    for df, col in tables:
        part = df.select(key, F.col(col))
        out = part if out is None else one_to_one(out, part, key)
    cols = [c for _, c in tables]
    return out.select(key, F.concat(*cols).alias(name)) if name else out.select(key, *cols)


def minmax_stats(df: DataFrame, features: str) -> DataFrame:
    """min, max and mean per position, NaN ignored."""
    cells = df.select(F.posexplode(features).alias("col", "value")).filter(~F.isnan("value"))
    return cells.groupBy("col").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def minmax_scale(df: DataFrame, features: str, stats: DataFrame | None = None) -> DataFrame:
    """Every position to [0, 1]; positions that are constant are left out."""
    stats = column_range(df, features) if stats is None else stats
    # one row per vector position
    rows = stats.filter("max > min").select("col", F.col("min").cast("double"), F.col("max").cast("double")).collect()
    cells = [
        F.struct(F.lit(c).alias("col"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for c, lo, hi in sorted(map(tuple, rows))
    ]

    def scale(c: Column) -> Column:
        return F.transform(
            F.array(*cells), lambda r: (F.get(c, r["col"]).cast("double") - r["lo"]) / (r["hi"] - r["lo"])
        )

    return df.withColumn(features, let(F.col(features), scale))


def log_columns(vector: Column | str, positions: Sequence[int], half: bool = True) -> Column:
    """Natural log on listed positions (0 gives -inf, negatives NaN), then the
    half-precision range: what does not fit becomes infinite."""
    listed = F.array(*[F.lit(int(p)) for p in positions])
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))

    def one(x: Column, i: Column) -> Column:
        v = x.cast("double")
        logged = F.when(F.isnan(v), v).when(v > 0, F.log(v)).when(v == 0, -inf).otherwise(nan)
        out = F.when(F.array_contains(listed, i), logged).otherwise(v)
        if not half:
            return out
        return F.when(F.isnan(out), out).when(out > HALF_MAX, inf).when(out < -HALF_MAX, -inf).otherwise(out)

    return F.transform(_c(vector), one)


# --- importance --------------------------------------------------------------

def importance_rank(df: DataFrame, values: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute value per feature position, highest first."""
    cells = df.select(*by, F.posexplode(F.col(values).cast("array<double>")).alias("feature", "value"))
    ranked = cells.groupBy(*by, "feature").agg(F.avg(F.abs("value")).alias("importance"))
    return ranked.orderBy(F.desc("importance"), "feature")


def importance_summary(df: DataFrame, by: Sequence[str] = (), feature: str = "feature", value: str = "importance") -> DataFrame:
    """mean, median and std (ddof 1) over importance files (folds, and classes
    unless ``by`` names them), kept where the mean is positive and ordered by it.
    A group has one value per file, so the exact median is bounded."""
    out = df.groupBy(*by, feature).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std")
    )
    return out.filter("mean > 0").orderBy(*by, F.desc("mean"), feature)
