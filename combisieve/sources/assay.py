"""Raw assay CSV."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.functions.checks import require

# Column names of the raw assay file and our names for them.
RAW_COLUMNS = {
    "id": "id",
    "buildingblock1_smiles": "bb1",
    "buildingblock2_smiles": "bb2",
    "buildingblock3_smiles": "bb3",
    "molecule_smiles": "molecule",
    "protein_name": "protein",
    "binds": "binds",
}


def read_assay(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str] = RAW_COLUMNS,
    types: Mapping[str, str] | None = None,
    kinds: Sequence[str] = TARGETS,
    unknown: str = "error",
) -> DataFrame:
    """Scan with a declared schema, rename, narrow the types and check the
    protein names: ``error`` fails on another name, ``drop`` rejects the row."""
    final = {"id": "bigint", "binds": "int", **(types or {})}
    schema = ", ".join(f"`{raw}` {final.get(name, 'string')}" for raw, name in columns.items())
    df = spark.read.schema(schema).option("header", True).csv(path).withColumnsRenamed(dict(columns))
    known = F.col("protein").isin(list(kinds))
    if unknown == "drop":
        return df.filter(known)
    # a filter, so that the check stays whatever columns are read
    return df.filter(require(known, F.lit(True), "protein outside the declared names"))


def write_assay(df: DataFrame, path: str, columns: Mapping[str, str] = RAW_COLUMNS) -> None:
    back = {name: raw for raw, name in columns.items()}
    df.select(*[F.col(n).alias(r) for n, r in back.items()]).write.option("header", True).csv(path)
