"""The same input views for Spark (functions) and DuckDB (CTE text).

They read whole tables and derive a combinatorial library from ``lineitem``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.functions.hashing import uniform

# Fixed fragment list of the fixture library (SMILES-alphabet strings).
FRAGMENTS = (
    "CCO", "c1ccccc1", "NC(=O)", "Clc1ccc(Br)cc1", "C[C@@H](N)C(=O)O", "c1ccncc1",
    "OB(O)c1ccccc1", "FC(F)(F)", "N#C", "[N+](=O)[O-]", "C/C=C/C", "SCC",
)

HELD_BB1 = tuple(range(0, 5))
HELD_BB23 = tuple(range(100, 120))


def _lib_sql(array_fn: str, base: int, table: str) -> str:
    frags = ",".join(f"'{f}'" for f in FRAGMENTS)
    at = f"+{base}" if base else ""
    return f"""
select mol_id, bb1, bb2, bb3, scaffold, BRD4, HSA, sEH,
  concat(frag[bb1%12{at}], frag[bb2%12{at}], frag[bb3%12{at}], 'N[Dy]') molecule
from (select ((l_orderkey*8+l_linenumber)*32768+l_partkey)*1024+l_suppkey mol_id,
  cast(l_suppkey%25 as int) bb1, cast(100+l_partkey%60 as int) bb2,
  cast(100+(l_partkey*7+l_orderkey)%60 as int) bb3,
  cast((l_orderkey%97)*(l_linenumber%3) as int) scaffold,
  case when l_returnflag='R' and l_discount>=0.09 then 1 else 0 end BRD4,
  case when l_suppkey%25<3 and l_quantity>=40 then 1 else 0 end HSA,
  case when l_partkey%60<6 and l_tax>=0.06 then 1 else 0 end sEH,
  {array_fn}({frags}) frag from {table})"""


# --- Spark ----------------------------------------------------------------

# Each driver table is one file with one row group, which a scan cannot split.
WIDE = {"lineitem": "l_orderkey", "documents": "doc_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # only an input with fewer splits than cores is spread; large inputs are
    # many files and keep their own partitions
    if name in WIDE and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, WIDE[name])
    return df


def lib(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_lib_sql("array", 0, "{li}"), li=table(spark, sf, "lineitem"))


def train(spark: SparkSession, sf: str) -> DataFrame:
    return lib(spark, sf).filter("bb1 < 18")


def test(spark: SparkSession, sf: str) -> DataFrame:
    return lib(spark, sf).filter("bb1 >= 15")


def assay_long(spark: SparkSession, sf: str) -> DataFrame:
    return lib(spark, sf).selectExpr(
        "mol_id", "bb1", "bb2", "bb3", "molecule",
        "stack(3, 'BRD4', BRD4, 'HSA', HSA, 'sEH', sEH) as (protein, binds)",
    )


def test_wide(spark: SparkSession, sf: str) -> DataFrame:
    ids = [f"case when (mol_id+{p})%4<>0 then mol_id*3+{p}+1 else 0 end id_{t}" for p, t in enumerate(TARGETS)]
    groups = [f"cast((bb1%4)*3+{p} as int) group_{t}" for p, t in enumerate(TARGETS)]
    return lib(spark, sf).selectExpr(
        "mol_id", "molecule", "bb1", "bb2", "bb3", "cast(bb1%4 as int) mol_group", *ids, *groups
    )


def score(model: int, target: str):
    u = uniform("mol_id", seed=f"{model}{target}")
    u2 = uniform("mol_id", seed=f"{model + 100}{target}")
    return F.round(0.7 * u + 0.3 * F.col(target) * u2, 3)


def predictions(spark: SparkSession, sf: str, model: int = 1) -> DataFrame:
    """Wide: mol_id, subset, pred_*, target_*."""
    return lib(spark, sf).select(
        "mol_id",
        F.when(F.col("mol_id") % 6 < 5, (F.col("mol_id") % 6).cast("int")).alias("subset"),
        *[score(model, t).alias(f"pred_{t}") for t in TARGETS],
        *[F.col(t).alias(f"target_{t}") for t in TARGETS],
    )


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    word = "aggregate(sequence(0,31), 0L, (a,i)->a + if(embedding[i+{o}]>0, shiftleft(1L,i), 0L))"
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id", f"array({word.format(o=0)}, {word.format(o=32)}) words"
    )


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """64 embedding values plus a constant, a NaN and an overflowing column."""
    extra = "array(cast(1 as float), if(vec_id%5=0, float('NaN'), cast(vec_id%2 as float)), cast(70000+vec_id as float))"
    return table(spark, sf, "embeddings").selectExpr("vec_id", "label", f"concat(embedding, {extra}) features")


# --- DuckDB ---------------------------------------------------------------

D_LIB = f"lib as ({_lib_sql('list_value', 1, 'lineitem')})"
D_TRAIN = "train as (select * from lib where bb1<18)"
D_TEST = "test as (select * from lib where bb1>=15)"
D_LONG = (
    "long as ("
    + " union all ".join(f"select mol_id, bb1, bb2, bb3, molecule, '{t}' protein, {t} binds from lib" for t in TARGETS)
    + ")"
)
D_WIDE = (
    "wide as (select mol_id, molecule, bb1, bb2, bb3, cast(bb1%4 as int) mol_group, "
    + ", ".join(f"case when (mol_id+{p})%4<>0 then mol_id*3+{p}+1 else 0 end id_{t}" for p, t in enumerate(TARGETS))
    + ", "
    + ", ".join(f"cast((bb1%4)*3+{p} as int) group_{t}" for p, t in enumerate(TARGETS))
    + " from lib)"
)


def d_hash(ids: str, seed: object = 42) -> str:
    """52-bit key of ``seed:ids``; ``ids`` is a SQL text expression."""
    return f"cast(('0x'||substr(md5('{seed}:'||{ids}),1,13)) as bigint)"


def d_uniform(ids: str, seed: object = 42) -> str:
    return f"({d_hash(ids, seed)}/4503599627370496::double)"


def d_score(model: int, target: str) -> str:
    u = d_uniform("mol_id::varchar", f"{model}{target}")
    u2 = d_uniform("mol_id::varchar", f"{model + 100}{target}")
    return f"round(0.7::double*{u}+0.3::double*{target}*{u2},3)"


def d_predictions(model: int = 1, name: str = "preds") -> str:
    return (
        f"{name} as (select mol_id, case when mol_id%6<5 then cast(mol_id%6 as int) end subset, "
        + ", ".join(f"{d_score(model, t)} pred_{t}" for t in TARGETS)
        + ", "
        + ", ".join(f"{t} target_{t}" for t in TARGETS)
        + " from lib)"
    )


def _d_word(o: int) -> str:
    return f"list_sum(list_transform(range(0,32), lambda i: case when embedding[i+{o}]>0 then (1::BIGINT << i) else 0 end))::BIGINT"


D_FP = f"fp as (select vec_id, {_d_word(1)} w0, {_d_word(33)} w1 from embeddings)"
D_DENSE = (
    "dense as (select vec_id, label, list_concat(embedding, [1::FLOAT, "
    "case when vec_id%5=0 then 'NaN'::FLOAT else (vec_id%2)::FLOAT end, (70000+vec_id)::FLOAT]) features from embeddings)"
)


def sql(*ctes: str, body: str, recursive: bool = False) -> str:
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(ctes) + "\n" + body


def union_all(parts: list[str]) -> str:
    return " union all ".join(parts)


def stack_rows(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
