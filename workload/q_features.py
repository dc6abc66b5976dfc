"""Bit and dense feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from combisieve.operators import features as FE
from workload import fixtures as X
from workload.base import d6, joined, query, rounded

D_BITS = "bits as (select vec_id, list_transform(embedding[1:64], lambda v: (v>0)::int) b from embeddings)"
D_PACKED = """packed as (select vec_id, list_transform(range(0,8), lambda i: list_sum(list_transform(range(0,8), lambda j:
 b[i*8+j+1] * (1 << (7-j)::int)))::int) p from bits)"""


def _bits(spark, sf):
    return X.table(spark, sf, "embeddings").selectExpr("vec_id", "transform(embedding, v -> int(v>0)) bits")


def _packed(spark, sf):
    return _bits(spark, sf).select("vec_id", FE.pack_bits("bits").alias("packed"))


@query("ft1_pack_bits", X.sql(D_BITS, D_PACKED, body="select vec_id, array_to_string(p, ',') as packed from packed"))
def pack_bits(spark, sf):
    return _packed(spark, sf).select("vec_id", joined("packed").alias("packed"))


@query("ft2_unpack_bits", X.sql(D_BITS, D_PACKED, body="select vec_id, array_to_string(b, ',') as bits from bits"))
def unpack_bits(spark, sf):
    return _packed(spark, sf).withColumn("bits", FE.unpack_bits("packed")).select("vec_id", joined("bits").alias("bits"))


@query("ft3_bit_formats", X.sql(D_BITS, D_PACKED, body="""
select vec_id, array_to_string(list_filter(range(0,64), lambda i: b[i+1]=1), ',') as as_set, array_to_string(b, ',') as as_seq,
 array_to_string(list_transform(range(0,64), lambda i: 2*i+b[i+1]), ',') as as_seq_v2 from bits"""))
def bit_formats(spark, sf):
    df = _packed(spark, sf).select("vec_id", *[FE.bit_formats("packed", f).alias(f"as_{f}") for f in ("set", "seq", "seq_v2")])
    return df.select("vec_id", *[joined(c).alias(c) for c in ("as_set", "as_seq", "as_seq_v2")])


@query("ft4_bit_density", X.sql(D_BITS, D_PACKED, body=f"""
select {d6('(select sum(list_sum(b))::double/sum(len(b)) from bits)')} as bit_density,
 {d6('sum(len(list_filter(p, lambda x: x<>0)))::double/sum(len(p))')} as byte_density from packed"""))
def bit_density(spark, sf):
    return rounded(FE.bit_density(_packed(spark, sf), "packed"), "bit_density", "byte_density")


def _r6(c: str):
    return F.array_join(F.transform(c, lambda v: F.round(v.cast("double") * 1_000_000, 0).cast("bigint").cast("string")), ",")


def _d_micro(e: str) -> str:
    return f"array_to_string(list_transform({e}, lambda v: round(v::double*1000000,0)::bigint), ',')"


@query("ft5_keep_columns", f"""
select vec_id, {_d_micro('list_transform([3,0,17,63], lambda p: embedding[p+1])')} as kept, {_d_micro('embedding[6:64]')} as remaining from embeddings""")
def keep_columns(spark, sf):
    df = X.table(spark, sf, "embeddings").select(
        "vec_id", FE.keep_columns("embedding", [3, 0, 17, 63]).alias("kept"),
        FE.drop_columns("embedding", [0, 1, 2, 3, 4]).alias("remaining"),
    )
    return df.select("vec_id", _r6("kept").alias("kept"), _r6("remaining").alias("remaining"))


@query("ft6_concat_features", X.sql(D_BITS, body=f"""
select vec_id, {_d_micro('list_concat(embedding, list_transform(b, lambda x: x::float))')} as features from embeddings join bits using (vec_id)"""))
def concat_features(spark, sf):
    bits = _bits(spark, sf).withColumn("bits", F.col("bits").cast("array<float>"))
    out = FE.concat_features([(X.table(spark, sf, "embeddings"), "embedding"), (bits, "bits")], "vec_id")
    return out.select("vec_id", _r6("features").alias("features"))


_CELLS = "cells as (select vec_id, unnest(range(0,67))::int col, unnest(features) v from dense)"
_STATS = "st as (select col, min(v) as min, max(v) as max, avg(v) as mean from cells where not isnan(v) group by col)"


@query("ft7_minmax_stats", X.sql(X.D_DENSE, _CELLS, _STATS, body=f"select col, min, max, {d6('mean')} as mean from st"))
def minmax_stats(spark, sf):
    return rounded(FE.minmax_stats(X.dense(spark, sf), "features"), "mean")


@query("ft7_minmax_scale", X.sql(X.D_DENSE, _CELLS, _STATS, body="""
select vec_id, array_to_string(list(case when isnan(v) then -1 else round((v::double-min::double)/(max::double-min::double)*1000000,0)::bigint end order by col), ',') as features
from cells join st using (col) where max>min group by vec_id"""))
def minmax_scale(spark, sf):
    out = FE.minmax_scale(X.dense(spark, sf), "features")
    micro = F.transform("features", lambda v: F.when(F.isnan(v), F.lit(-1)).otherwise(F.round(v * 1_000_000, 0).cast("bigint")))
    return out.select("vec_id", F.array_join(micro.cast("array<string>"), ",").alias("features"))


@query("ft8_log_columns", X.sql(X.D_DENSE, body="""
select vec_id, array_to_string(list_transform(range(0,67), lambda i: case when isnan(features[i+1]) then 'nan'
 when i in (0,64,66) then case when features[i+1]<0 then 'nan' else (round(ln(features[i+1]::double)*1000000,0)::bigint)::varchar end
 when features[i+1]>65504 then 'inf' else (round(features[i+1]::double*1000000,0)::bigint)::varchar end), ',') as features from dense"""))
def log_columns(spark, sf):
    out = X.dense(spark, sf).withColumn("features", FE.log_columns("features", [0, 64, 66]))
    cell = F.transform("features", lambda v: F.when(F.isnan(v), F.lit("nan")).when(v == float("inf"), F.lit("inf"))
                       .otherwise(F.round(v * 1_000_000, 0).cast("bigint").cast("string")))
    return out.select("vec_id", F.array_join(cell, ",").alias("features"))


_IMP = "imp as (select label, vec_id, unnest(range(0,64))::int feature, abs(unnest(embedding)::double) importance from embeddings)"


@query("ft9_importance_rank", X.sql(_IMP, body=f"select feature, {d6('avg(importance)')} as importance from imp group by 1"))
def importance_rank(spark, sf):
    return rounded(FE.importance_rank(X.table(spark, sf, "embeddings"), "embedding"), "importance")


_FILES = "files as (select vec_id%5 as fold, label%3 as class, feature, avg(importance) importance from imp group by all)"
_SUM = f"{d6('avg(importance)')} as mean, {d6('quantile_cont(importance,0.5)')} as median, {d6('stddev_samp(importance)')} as std"


@query("ft10_importance_summary", X.sql(_IMP, _FILES, body=f"""
select class, feature, {_SUM} from files group by class, feature union all select -1, feature, {_SUM} from files group by feature"""))
def importance_summary(spark, sf):
    df = X.table(spark, sf, "embeddings").selectExpr("vec_id%5 fold", "label%3 class", "embedding")
    files = FE.importance_rank(df, "embedding", ["fold", "class"])
    per = FE.importance_summary(files, ["class"])
    both = per.unionByName(FE.importance_summary(files).withColumn("class", F.lit(-1)))
    return rounded(both, "mean", "median", "std")
