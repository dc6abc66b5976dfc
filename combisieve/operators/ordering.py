"""Global ranks and prefix sums without a single-partition window.

The order is cut into buckets that follow it.  Rows are numbered inside their
bucket, bucket totals (one row per bucket) are cumulated, and both are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from combisieve.functions.hashing import HASH_BITS, hash_key
from combisieve.session import cut_lineage


def bucket_bits(spark: SparkSession) -> int:
    """Buckets grow with the cluster: about four per shuffle partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(20, max(5, (4 * parts - 1).bit_length()))


def prefix_sums(
    df: DataFrame,
    bucket: str,
    order: Sequence[Column],
    values: Mapping[str, Column],
    within: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums ``{name: expression}`` in ``(bucket, order)``
    order, separately for each combination of ``within``.

    ``order`` must be total inside a bucket.  Strata are split over buckets, so
    a stratum with most of the rows still uses all tasks.
    """
    within = list(within)
    names = list(values)
    src = df.withColumns({f"__v_{n}": e for n, e in values.items()})
    totals = src.groupBy(*within, bucket).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    # one row per bucket: at most 2**20 rows in a stratum
    before = W.partitionBy(*within).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__k_{c}") for c in within + [bucket]],
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names],
    )
    if not within:
        offsets = F.broadcast(offsets)
    inside = W.partitionBy(*within, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = src.withColumns({f"__r_{n}": F.sum(f"__v_{n}").over(inside) for n in names})
    cond = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in within + [bucket]]
    return running.join(offsets, cond, "left").select(
        *df.columns, *[(F.col(f"__o_{n}") + F.col(f"__r_{n}")).alias(n) for n in names]
    )


def hash_bucket(h: str, bits: int) -> Column:
    """Order-preserving bucket of a hash key; hashing spreads rows evenly."""
    return F.shiftright(F.col(h), HASH_BITS - bits).cast("int")


def hash_rank(
    df: DataFrame,
    ids: Sequence[str],
    seed: object = 42,
    within: Sequence[str] = (),
    name: str = "rank",
    key: Column | None = None,
) -> DataFrame:
    """0-based rank in a seeded random order (ties of the hash go by id)."""
    src = df.withColumn("__h", key if key is not None else hash_key(*ids, seed=seed))
    src = src.withColumn("__b", hash_bucket("__h", bucket_bits(df.sparkSession)))
    order = [F.col("__h"), *[F.col(i) for i in ids]]
    out = prefix_sums(src, "__b", order, {name: F.lit(1).cast("bigint")}, within)
    return out.withColumn(name, F.col(name) - 1).drop("__h", "__b")


def quantile_bucket(df: DataFrame, col: str, name: str = "__b", descending: bool = False) -> DataFrame:
    """Add an order-preserving bucket of a numeric column, cut at approximate
    quantiles.  Any cut points give right results; they only balance the work.
    Group equal values first, so that a value shared by many rows is one row."""
    n = 2 ** min(12, bucket_bits(df.sparkSession))
    cuts = df.approxQuantile(col, [i / n for i in range(1, n)], 1 / (4 * n))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bucketed = Bucketizer(
        splits=splits, inputCol="__x", outputCol="__bd", handleInvalid="keep"
    ).transform(df.withColumn("__x", F.col(col).cast("double")))
    b = F.col("__bd").cast("int")
    return bucketed.withColumn(name, -b if descending else b).drop("__x", "__bd")


def row_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Dense 0-based index over an explicit total order of any column types.

    A range-partitioned sort is materialised once; the row's position inside its
    partition comes from ``monotonically_increasing_id`` and the partition
    offsets from one count per partition.
    """
    low = (1 << 33) - 1
    ranged = cut_lineage(df.orderBy(*order).withColumn("__mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__mid", 33).cast("int"))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # one row per partition of the sort
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return ranged.join(F.broadcast(offsets), "__part").select(
        *df.columns, (F.col("__off") + F.col("__mid").bitwiseAND(F.lit(low))).cast("bigint").alias(name)
    )
