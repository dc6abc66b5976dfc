"""Nested split and dictionary files as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items of a list on one line.
LINE_ITEMS = 100_000


def write_meta(rows: DataFrame, path: str) -> None:
    """``(name, position, value)`` rows as one JSON object of lists per line.

    ``position`` counts from 0 without gaps.  A list goes over as many lines as
    it needs; each tells the position of its first item.
    """
    line = (F.floor(F.col("position") / LINE_ITEMS) * LINE_ITEMS).cast("bigint").alias("first")
    lists = rows.groupBy("name", line).agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("items"))
    lists.select("name", "first", F.col("items.value").alias("values")).write.json(path)


def read_meta(spark: SparkSession, path: str, value: str = "bigint") -> DataFrame:
    """Rows of a file written by :func:`write_meta`."""
    lists = spark.read.schema(f"name string, first bigint, values array<{value}>").json(path)
    items = lists.select("name", "first", F.posexplode("values").alias("at", "value"))
    return items.select("name", (F.col("first") + F.col("at")).cast("int").alias("position"), "value")


def read_nested(spark: SparkSession, path: str, fields: Sequence[str], value: str = "bigint") -> DataFrame:
    """Rows of a JSON document that maps names to lists."""
    schema = ", ".join(f"`{f}` array<{value}>" for f in fields)
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    cells = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("values")) for f in fields])
    return doc.select(F.inline(cells)).select("name", F.posexplode("values").alias("position", "value"))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """``(grid_idx, side, position, bb, expected_rows)`` of a grid file."""
    cell = "struct<grid_idx:int,bb1_idxs:array<int>,bb23_idxs:array<int>,expected_num_samples:double>"
    doc = spark.read.schema(f"grid array<{cell}>").option("multiLine", True).json(path)
    cells = doc.select(F.inline("grid"))
    sides = F.array(
        F.struct(F.lit("bb1").alias("side"), F.col("bb1_idxs").alias("blocks")),
        F.struct(F.lit("bb23").alias("side"), F.col("bb23_idxs").alias("blocks")),
    )
    return cells.select("grid_idx", F.col("expected_num_samples").alias("expected_rows"), F.inline(sides)).select(
        "grid_idx", "side", F.posexplode("blocks").alias("position", "bb"), "expected_rows"
    )
