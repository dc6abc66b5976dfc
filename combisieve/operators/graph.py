"""Co-occurrence graph of building blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combisieve.operators.ordering import row_index
from combisieve.operators.skew import attach_totals, scalar, spread_join
from combisieve.session import cut_lineage


def cooccurrence_edges(df: DataFrame, cols: Sequence[str] = ("bb1", "bb2", "bb3")) -> DataFrame:
    """``(src, dst)``, src <= dst: blocks that occur in one row.  Distinct
    combinations are formed before the pairs, so copies do not travel."""
    combo = df.select(F.array_sort(F.array(*cols)).alias("c")).distinct()
    n = len(cols)
    pairs = F.array(*[
        F.struct(F.col("c")[i].alias("src"), F.col("c")[j].alias("dst")) for i in range(n) for j in range(i + 1, n)
    ])
    return combo.select(F.inline(pairs)).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v), u > v: link neighbours to the lowest node
    around ``u``.  A node with very many edges is spread over tasks."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    low = around.groupBy("u").agg(F.count(F.lit(1)).alias("__n"), F.min("v").alias("__m")).select(
        "u", "__n", F.least("u", "__m").alias("__m")
    )
    linked = attach_totals(around, low, ["u"], "__n", ["v"])
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("__m").alias("v"))
    else:
        out = linked.filter(F.col("v") != F.col("__m")).select(F.col("v").alias("u"), F.col("__m").alias("v")).unionByName(
            low.select("u", F.col("__m").alias("v"))
        )
    return out.filter(F.col("u") != F.col("v")).distinct()


def component_roots(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, root)``, root = lowest node of the component, by alternating
    large and small star steps (about log2 of the diameter squared rounds)."""
    ordered = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    nodes = cut_lineage(ordered.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    current = cut_lineage(ordered.filter("u <> v").distinct())

    def mark(df: DataFrame) -> tuple:
        # order-free fingerprint of the edge set
        key = F.xxhash64("u", "v")
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(key), F.sum(F.shiftright(key, 20))).first())

    before = None
    while before != (now := mark(current)):
        before = now
        current = cut_lineage(_star(cut_lineage(_star(current, True)), False))
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component, size)``, components numbered by their lowest node."""
    rooted = cut_lineage(component_roots(edges, src, dst))
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    numbered = row_index(sizes, ["root"], "component")
    return attach_totals(rooted, numbered, ["root"], "size", ["node"]).select("node", "component", "size")


def component_coverage(df: DataFrame, components: DataFrame, cols: Sequence[str] = ("bb1", "bb2", "bb3")) -> DataFrame:
    """Rows and % of rows that touch each component through any block."""
    table = components.select(F.col("node").alias("block"), "component")
    combos = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    keyed = combos.withColumn("combo", F.struct(*cols)).select(
        "combo", "n", F.explode(F.array_distinct(F.array(*cols))).alias("block")
    )
    hit = spread_join(keyed, table, ["block"], "inner", ["combo"]).select("combo", "n", "component").distinct()
    total = scalar(df, F.count(F.lit(1)))
    blocks = components.groupBy("component").agg(F.count(F.lit(1)).alias("n_blocks"))
    rows = hit.groupBy("component").agg(F.sum("n").alias("n_rows"))
    return blocks.join(rows, "component", "left").select(
        "component", "n_blocks", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        (F.coalesce("n_rows", F.lit(0)) * 100 / total).alias("pct"),
    )
