"""Datasets, feature tables, split tables, GBDT files and submissions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combisieve.operators.skew import scalar

# The group ids each named submission keeps.
SUBMISSION_GROUPS = {
    "all": tuple(range(12)),
    "share": (0, 1, 2),
    "public-nonshare": (6, 7, 8),
}


def save_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.partitionBy(*partition_by).parquet(path)


def concat_datasets(train: DataFrame, test: DataFrame, index: str = "index", tag: str = "is_test") -> DataFrame:
    """Train rows, then test rows with their index shifted by the train size."""
    n = scalar(train, F.count(F.lit(1)))
    shifted = test.withColumns({index: F.col(index) + n, tag: F.lit(1)})
    return train.withColumn(tag, F.lit(0)).unionByName(shifted)


def write_features(df: DataFrame, path: str, features: str = "features") -> DataFrame:
    """Write an array-column feature table; returns its manifest (name, type,
    rows, width), computed from what was written."""
    df.write.parquet(path)
    kind = df.schema[features].dataType.elementType.simpleString()
    back = df.sparkSession.read.parquet(path)
    return back.agg(
        F.lit(features).alias("name"),
        F.lit(kind).alias("dtype"),
        F.count(F.lit(1)).alias("rows"),
        F.min(F.size(features)).alias("min_width"),
        F.max(F.size(features)).alias("max_width"),
    )


def gbdt_description(labels: Sequence[str], categorical: Sequence[str], numeric: Sequence[str]) -> list[tuple]:
    """Column description: position, kind (Label, Categ or Num) and name."""
    kinds = [("Label", c) for c in labels] + [("Categ", c) for c in categorical] + [("Num", c) for c in numeric]
    return [(i, k, c) for i, (k, c) in enumerate(kinds)]


def export_gbdt(
    df: DataFrame, path: str, labels: Sequence[str], categorical: Sequence[str] = (), numeric: Sequence[str] = ()
) -> DataFrame:
    """Headerless TSV of label and feature columns; returns the description."""
    rows = gbdt_description(labels, categorical, numeric)
    df.select(*[name for _, _, name in rows]).write.option("sep", "\t").csv(path)
    return df.sparkSession.createDataFrame(rows, "position int, kind string, name string")


def spread_vector(df: DataFrame, vector: str, width: int, prefix: str = "f") -> DataFrame:
    """An array column as ``width`` plain columns."""
    return df.select(*[c for c in df.columns if c != vector], *[F.col(vector)[i].alias(f"{prefix}{i}") for i in range(width)])


def mask_outside_subset(df: DataFrame, groups: Sequence[int], group: str = "group_id", value: str = "binds") -> DataFrame:
    """Predictions outside the named groups become 0."""
    return df.withColumn(value, F.when(F.col(group).isin(list(groups)), F.col(value)).otherwise(F.lit(0.0)))


def write_submission(
    df: DataFrame, path: str, subsets: Mapping[str, Sequence[int]] = SUBMISSION_GROUPS, id_col: str = "id"
) -> dict[str, str]:
    """One headed ``(id, binds)`` CSV folder per named subset."""
    paths = {}
    for name, groups in subsets.items():
        paths[name] = f"{path}/{name}"
        mask_outside_subset(df, groups).select(id_col, "binds").write.option("header", True).csv(paths[name])
    return paths


def write_keyed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Fold, weight or split table keyed by row index."""
    writer = df.write
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def read_keyed(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
