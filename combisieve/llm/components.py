"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from combisieve.session import cut_lineage


def _toward_lowest(around: DataFrame) -> DataFrame:
    """``(v, low)`` for every row ``(u, v)``, low = lowest of u and its partners.
    Minima are combined before the shuffle; where one ``u`` has very many
    partners the adaptive join splits its partition."""
    low = around.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("at"), F.least("u", "low").alias("low"))
    return around.join(low, F.col("u") == F.col("at")).select("u", "v", "low")


def _round(edges: DataFrame) -> DataFrame:
    """A large-star step, then a small-star step, on edges u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _toward_lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    small = _toward_lowest(large)
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct(F.col("u"), F.col("low").alias("v")))
    return small.select(F.inline(pairs)).filter("u <> v").distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(src, dst)``; the root is the
    lowest node that it reaches.

    Alternating large and small stars; every round is one job that writes its
    edges to the shared folder, and the fingerprint that ends the loop is
    observed by that job.
    """
    current = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    before = None
    while True:
        seen = Observation()
        key = F.xxhash64("u", "v")
        marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(key).alias("x"), F.sum(F.shiftright(key, 24)).alias("s")]
        current = cut_lineage(current.observe(seen, *marks))
        if seen.get == before:
            break
        before = seen.get
        current = _round(current)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
