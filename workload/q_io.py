"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.operators import ordering, predicates, reshape
from combisieve.session import scratch_path
from combisieve.sources import assay, meta, tables
from workload import fixtures as X
from workload.base import query, r6


@query("io1_read_assay", X.sql(X.D_LIB, X.D_LONG, body="""
select mol_id*3+case protein when 'BRD4' then 0 when 'HSA' then 1 else 2 end id, bb1::varchar bb1, bb2::varchar bb2,
 bb3::varchar bb3, molecule, protein, binds from long"""))
def read_assay(spark, sf):
    path = scratch_path(spark, "assay")
    place = F.when(F.col("protein") == "BRD4", 0).when(F.col("protein") == "HSA", 1).otherwise(2)
    raw = X.assay_long(spark, sf).withColumn("id", F.col("mol_id") * 3 + place)
    assay.write_assay(raw, path)
    return assay.read_assay(spark, path)


@query("io2_with_row_index", X.sql(X.D_LIB, body="""
select mol_id, molecule, row_number() over (order by molecule, mol_id)-1 as "index" from lib"""))
def with_row_index(spark, sf):
    return ordering.row_index(X.lib(spark, sf).select("mol_id", "molecule"), ["molecule", "mol_id"])


@query("io3_meta_json", X.sql(X.D_LIB, body="""
select name, row_number() over (partition by name order by value)-1 as position, value from (
 select distinct 'bb1' as name, bb1::bigint as value from lib union select 'bb23', bb2 from lib union select 'bb23', bb3 from lib)"""))
def meta_json(spark, sf):
    lib = X.lib(spark, sf)
    blocks = {"bb1": [(lib, "bb1")], "bb23": [(lib, "bb2"), (lib, "bb3")]}
    parts = [
        reshape.build_dictionary(cols, "value", "position").select(F.lit(n).alias("name"), "position", "value")
        for n, cols in blocks.items()
    ]
    path = scratch_path(spark, "meta")
    meta.write_meta(X.stack_rows(parts), path)
    return meta.read_meta(spark, path).withColumn("position", F.col("position").cast("bigint"))


@query("io4_concat_datasets", X.sql(X.D_LIB, X.D_TRAIN, X.D_TEST, body="""
select row_number() over (order by mol_id)-1 as "index", mol_id, 0 as is_test from train union all
select row_number() over (order by mol_id)-1+(select count(*) from train), mol_id, 1 from test"""))
def concat_datasets(spark, sf):
    parts = [ordering.row_index(t(spark, sf).select("mol_id"), ["mol_id"]) for t in (X.train, X.test)]
    path = scratch_path(spark, "dataset")
    tables.save_dataset(tables.concat_datasets(*parts), path, ["is_test"])
    return spark.read.parquet(path)


@query("io5_write_features", X.sql(X.D_DENSE, body="""
select 'features' as name, 'float' as dtype, count(*) as rows, min(len(features))::int as min_width,
 max(len(features))::int as max_width from dense"""))
def write_features(spark, sf):
    return tables.write_features(X.dense(spark, sf), scratch_path(spark, "features"))


@query("io7_export_gbdt", X.sql(X.D_LIB, body="""
select greatest(BRD4,HSA,sEH) as label, bb1, bb2, bb3, mol_id from lib"""))
def export_gbdt(spark, sf):
    path = scratch_path(spark, "gbdt")
    rows = X.lib(spark, sf).withColumn("label", predicates.any_positive())
    tables.export_gbdt(rows, path, ["label"], ["bb1", "bb2", "bb3"], ["mol_id"])
    return spark.read.schema("label int, bb1 int, bb2 int, bb3 int, mol_id bigint").option("sep", "\t").csv(path)


@query("io7_feature_columns", """
select vec_id, label, """ + ", ".join(f"(round(embedding[{i + 1}]::double,6)+0::double) f{i}" for i in range(64)) + " from embeddings")
def feature_columns(spark, sf):
    path = scratch_path(spark, "gbdt")
    names = [f"f{i}" for i in range(64)]
    df = X.table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    tables.export_gbdt(tables.spread_vector(df, "embedding", 64), path, ["label"], ["vec_id"], names)
    schema = "label int, vec_id bigint, " + ", ".join(f"{n} double" for n in names)
    back = spark.read.schema(schema).option("sep", "\t").csv(path)
    return back.withColumns({n: r6(n) for n in names})


_LONG_PREDS = X.union_all([
    f"select case when (mol_id+{p})%4<>0 then mol_id*3+{p}+1 else 0 end id, (bb1%4)*3+{p} g, {X.d_score(1, t)} s from lib"
    for p, t in enumerate(TARGETS)
])


@query("io8_write_submission", X.sql(
    X.D_LIB, f"p as (select id, g, s from ({_LONG_PREDS}) where id<>0)",
    "sub as (select * from (values ('all',0,11),('share',0,2),('public-nonshare',6,8)) v(subset,lo,hi))", body="""
select subset, id%1000 as id_mod, count(*) as n, sum(cast(round(case when g between lo and hi then s else 0 end*1000) as bigint))::bigint as milli
from p, sub group by all"""))
def write_submission(spark, sf):
    wide = X.test_wide(spark, sf).join(X.predictions(spark, sf), "mol_id")
    long = reshape.wide_to_long(wide, {"id": "id_", "binds": "pred_", "group_id": "group_"})
    paths = tables.write_submission(long.select("id", "binds", "group_id"), scratch_path(spark, "submission"))
    back = X.stack_rows([
        spark.read.schema("id bigint, binds double").option("header", True).csv(p).withColumn("subset", F.lit(n))
        for n, p in paths.items()
    ])
    milli = F.sum(F.round(F.col("binds") * 1000).cast("bigint"))
    return back.groupBy("subset", (F.col("id") % 1000).alias("id_mod")).agg(
        F.count(F.lit(1)).alias("n"), milli.alias("milli")
    )


@query("io9_write_split_tables", X.sql(X.D_LIB, body=f"""
select mol_id as "index", (row_number() over (order by {X.d_hash("mol_id::varchar")}, mol_id)-1)%5 as fold_idx from lib"""))
def write_split_tables(spark, sf):
    ranked = ordering.hash_rank(X.lib(spark, sf).select("mol_id"), ["mol_id"])
    folds = ranked.select(F.col("mol_id").alias("index"), (F.col("rank") % 5).alias("fold_idx"))
    path = scratch_path(spark, "folds")
    tables.write_keyed(folds, path, "csv")
    return tables.read_keyed(spark, path, "index bigint, fold_idx bigint", "csv")
