"""Profiles, group statistics, ordering by frequency."""

from __future__ import annotations

from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.functions.hashing import uniform
from combisieve.operators import features, metrics, predicates, profile
from workload import fixtures as X
from workload.base import d6, joined, query, r6, rounded

COLS = ("bb1", "bb2", "bb3", "scaffold", "molecule")
RATES = ", ".join(f"{d6(f'avg({t})')} as {t}" for t in TARGETS)


def _each(template: str, items) -> str:
    return X.union_all([template.format(c=c) for c in items])


@query("ag1_n_unique", X.sql(X.D_LIB, body=_each("select '{c}' as \"column\", count(distinct {c}) as n_unique from lib", COLS)))
def n_unique(spark, sf):
    return profile.n_unique(X.lib(spark, sf), COLS)


_DESCRIBE = """select '{c}' as "column", count({c}) as n, count(*)-count({c}) as n_null, %s as mean, %s as std,
 min({c})::double as min, max({c})::double as max, """ % ("(round(avg({c}), 7) + 0::double)", d6("stddev_samp({c})"))


def _percentiles(fn: str) -> str:
    return ", ".join(f"{d6(f'{fn}({{c}}::double,{p})::double')} as p{round(p * 100):02d}" for p in (0.01, 0.25, 0.5, 0.75, 0.99))


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount")


@query("ag2_describe_disc", _each(_DESCRIBE + _percentiles("quantile_disc") + " from lineitem", NUMERIC))
def describe_disc(spark, sf):
    out = profile.describe(X.table(spark, sf, "lineitem"), NUMERIC, kind="disc")
    # the mean of two-digit values can end in a 5 at the seventh digit
    out = out.withColumn("mean", F.round("mean", 7))
    return rounded(out, "std", "p01", "p25", "p50", "p75", "p99")


@query("ag2_describe_cont", _each(_DESCRIBE + _percentiles("quantile_cont") + " from lineitem", NUMERIC))
def describe_cont(spark, sf):
    out = profile.describe(X.table(spark, sf, "lineitem"), NUMERIC, kind="cont")
    # the mean of two-digit values can end in a 5 at the seventh digit
    out = out.withColumn("mean", F.round("mean", 7))
    return rounded(out, "std", "p01", "p25", "p50", "p75", "p99")


@query("ag3_positive_rate", X.sql(X.D_LIB, body=f"select bb1, count(*) as n, {RATES} from lib group by bb1"))
def positive_rate(spark, sf):
    return rounded(profile.positive_rate(X.lib(spark, sf), ["bb1"]), *TARGETS)


@query("ag4_positive_rate_union", X.sql(X.D_LIB, body=f"""
select bb23, count(*) as n, {RATES} from (
 select bb2 as bb23, BRD4, HSA, sEH from lib union all select bb3, BRD4, HSA, sEH from lib where bb3<>bb2) group by bb23"""))
def positive_rate_union(spark, sf):
    return rounded(profile.positive_rate_union(X.lib(spark, sf)), *TARGETS)


@query("ag5_overall_positives", X.sql(X.D_LIB, body=_each(
    "select '{c}' as target, sum({c})::bigint as positives, " + d6("avg({c})") + " as rate from lib", TARGETS)
    + f" union all select 'micro', sum(BRD4+HSA+sEH)::bigint, {d6('sum(BRD4+HSA+sEH)/(3*count(*))::double')} from lib"))
def overall_positives(spark, sf):
    return rounded(profile.overall_positives(X.lib(spark, sf)), "rate")


@query("ag6_set_overlap", X.sql(X.D_LIB, X.D_TRAIN, X.D_TEST, body=_each(f"""
select '{{c}}' as "column", a as n_a, b as n_b, o as n_overlap, b-o as n_b_only, a+b-o as n_union,
 {d6('o/a::double')} as overlap_of_a, {d6('o/b::double')} as overlap_of_b, {d6('o/(a+b-o)::double')} as overlap_of_union from
(select (select count(distinct {{c}}) from train) a, (select count(distinct {{c}}) from test) b,
 (select count(*) from (select {{c}} from train intersect select {{c}} from test)) o)""", ("bb1", "molecule", "scaffold"))))
def set_overlap(spark, sf):
    parts = [profile.set_overlap(X.train(spark, sf), X.test(spark, sf), c) for c in ("bb1", "molecule", "scaffold")]
    return rounded(X.stack_rows(parts), "overlap_of_a", "overlap_of_b", "overlap_of_union")


@query("ag7_value_counts", X.sql(X.D_LIB, body="""
select scaffold, count(*) as n, arg_min(molecule, mol_id) as first_molecule from lib group by scaffold"""))
def value_counts(spark, sf):
    return profile.value_counts(X.lib(spark, sf), ["scaffold"], "molecule", "mol_id")


@query("ag8_group_size_distribution", X.sql(X.D_LIB, "s as (select bb2, bb3, count(*) size from lib group by all)", body=f"""
select count(*) as n_groups, sum(size)::bigint as n_rows, count(*) filter (size=1) as n_single, {d6('avg(size)')} as mean_size,
 max(size) as max_size, quantile_disc(size,0.5)::bigint as p50, quantile_disc(size,0.9)::bigint as p90,
 quantile_disc(size,0.99)::bigint as p99, count(*) filter (size>10) as over_10, count(*) filter (size>100) as over_100,
 count(*) filter (size>1000) as over_1000 from s"""))
def group_size_distribution(spark, sf):
    lib = X.lib(spark, sf).withColumn("pair", F.concat_ws("-", "bb2", "bb3"))
    out = profile.group_size_distribution(lib, "pair").withColumn("mean_size", r6("mean_size"))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("p50", "p90", "p99")})


@query("ag9_concentration", X.sql(X.D_LIB, """
h as (select size, count(*) n_groups from (select scaffold, count(*) size from lib group by 1) group by 1),
c as (select *, sum(n_groups) over w groups_up_to, sum(size*n_groups) over w rows_up_to,
 sum(n_groups) over () ag, sum(size*n_groups) over () ar from h window w as (order by size))""", body=f"""
select size, n_groups, groups_up_to::bigint groups_up_to, rows_up_to::bigint rows_up_to,
 {d6('(ag-groups_up_to+n_groups)/ag::double')} as top_group_share, {d6('(ar-rows_up_to+size*n_groups)/ar::double')} as top_row_share,
 (rows_up_to>=0.6::double*ar and rows_up_to-size*n_groups<0.6::double*ar) as is_cut from c"""))
def concentration(spark, sf):
    return rounded(profile.concentration(X.lib(spark, sf), "scaffold", 0.6), "top_group_share", "top_row_share")


def _d_hist(x: str, bins: int, tag: str) -> str:
    return f"""select '{tag}' as scale, least({bins - 1}, floor((x-lo)/((hi-lo)/{bins})))::int as bin, count(*) as n
 from (select x, min(x) over () lo, max(x) over () hi from (select {x} x from lineitem)) group by all"""


@query("ag10_histogram", X.union_all([_d_hist("l_extendedprice", 20, "linear"), _d_hist("log10(l_extendedprice)", 20, "log")]))
def histogram(spark, sf):
    li = X.table(spark, sf, "lineitem")
    return X.stack_rows([
        profile.histogram(li, "l_extendedprice", 20, log).withColumn("scale", F.lit(n))
        for log, n in ((False, "linear"), (True, "log"))
    ])


@query("ag11_binned_mean", X.sql(X.D_LIB, body=f"""
select floor(x/0.05::double)::bigint as bin, count(*) as n, {d6('avg(BRD4)')} as mean from
(select {X.d_uniform("mol_id::varchar")} x, BRD4 from lib) group by 1"""))
def binned_mean(spark, sf):
    df = X.lib(spark, sf).withColumn("x", uniform("mol_id"))
    return rounded(profile.binned_mean(df, "x", "BRD4", 0.05), "mean")


_Q = ", ".join(f"quantile_cont({t},0.75)+{{k}}::double*(quantile_cont({t},0.75)-quantile_cont({t},0.25)) c_{t}" for t in TARGETS)
_RAW = ", ".join(f"avg({t}) {t}" for t in TARGETS)


@query("ag12_iqr_outliers", X.sql(X.D_LIB, f"r as (select bb2, {_RAW} from lib group by 1)", body=f"""
select * from (select bb2, {", ".join(f"cast(r.{t}>c_{t} as int) as over_{t}" for t in TARGETS)}
 from r, (select {_Q.format(k=2.65)} from r)) where over_BRD4+over_HSA+over_sEH>0"""))
def iqr_outliers(spark, sf):
    rates = profile.positive_rate(X.lib(spark, sf), ["bb2"])
    return profile.iqr_outliers(rates, "bb2", 2.65)


_W = "lw as (select *, 1::double/count(*) over (partition by scaffold) w, greatest(BRD4,HSA,sEH) anyp from lib)"


@query("ag13_weighted_positive_share", X.sql(X.D_LIB, _W, body=X.union_all([
    f"select '{n}' as target, {d6(f'sum(case when {c}>0 then w else 0 end)/sum(w)')} as share from lw"
    for n, c in [*((t, t) for t in TARGETS), ("any", "anyp")]])))
def weighted_positive_share(spark, sf):
    sized = profile.with_group_stats(X.lib(spark, sf), "scaffold", ["mol_id"], {})
    out = profile.weighted_positive_share(sized.withColumn("w", 1.0 / F.col("group_size")), "w")
    return rounded(out, "share")


_PCT = ", ".join(f"{d6(f'avg({t})*100')} as pct_{t}" for t in TARGETS)


def _split(mode: str, op: str) -> str:
    cond = f"bb1 between 0 and 4 {op} bb2 between 100 and 119 {op} bb3 between 100 and 119"
    return f"""select '{mode}' as mode, count(*) as n, count(distinct bb1) as n_unique_bb1, count(distinct molecule) as n_unique_molecule,
 {_PCT}, {d6('count(*)*100/(select count(*) from lib)::double')} as pct from lib where {cond}"""


@query("ag14_split_stats", X.sql(X.D_LIB, body=_split("all_in", "and") + " union all " + _split("any_in", "or")))
def split_stats(spark, sf):
    flags = [predicates.member("bb1", X.HELD_BB1), *[predicates.member(c, X.HELD_BB23) for c in ("bb2", "bb3")]]
    out = profile.split_stats(X.lib(spark, sf), *flags, unique=["bb1", "molecule"])
    return rounded(out, "pct", *[f"pct_{t}" for t in TARGETS])


_SMALL = """cells as (select unnest(range(0,64)) col, unnest(list_transform(embedding, lambda v: case when v>0.1 then 2 when v>0 then 1 else 0 end)) v
 from embeddings union all select 64, 1 from embeddings),
vals as (select col::int col, v, count(*) n from cells group by all)"""


def _small(spark, sf):
    code = "concat(transform(embedding, v -> case when v>0.1 then 2 when v>0 then 1 else 0 end), array(1))"
    return X.table(spark, sf, "embeddings").selectExpr("vec_id", f"{code} features")


_PROFILE = """
select col, count(*) as n_values, sum(n)::bigint as n_rows, count(*)=1 as is_constant, arg_min(n, v) as n_lowest,
 case when count(*)>1 then arg_max(n, v) end as n_highest, case when count(*)=3 then (sum(n)-arg_min(n,v)-arg_max(n,v))::bigint end as n_middle
from vals group by col"""


@query("ag15_column_profile", X.sql(_SMALL, body=_PROFILE))
def column_profile(spark, sf):
    return profile.column_profile(_small(spark, sf), "features")


@query("ag16_column_profile_chunked", X.sql(_SMALL, body=_PROFILE))
def column_profile_chunked(spark, sf):
    chunked = _small(spark, sf).withColumn("chunk", F.col("vec_id") % 3)
    return profile.profile_from_values(
        profile.merge_column_values(profile.column_values(chunked, "features", ["chunk"]))
    )


_CELLS = "cells as (select unnest(range(0,67))::int col, unnest(features) v from dense)"


@query("ag17_nan_rate", X.sql(X.D_DENSE, _CELLS, body=f"""
select col, {d6('avg(isnan(v)::int)')} as nan_rate, count(distinct v) filter (not isnan(v)) as n_values,
 count(distinct v) filter (not isnan(v))<=2 as few_values from cells group by col"""))
def nan_rate(spark, sf):
    return rounded(profile.nan_rate(X.dense(spark, sf), "features"), "nan_rate")


@query("ag17_unparseable", """
select 'props' as "column", count(*) filter (try_cast(regexp_extract(props,'[0-9]+') as double) is null) as n_bad from events
union all select 'event_type', count(*) filter (try_cast(event_type as double) is null) from events""")
def unparseable(spark, sf):
    ev = X.table(spark, sf, "events").withColumn("props", F.regexp_extract("props", "[0-9]+", 0))
    return profile.unparseable(ev, ["props", "event_type"])


@query("ag18_half_overflow", X.sql(X.D_DENSE, _CELLS, body="""
select col, min(v) as min, max(v) as max from cells where not isnan(v) group by col having max(v)>65504 or min(v)<-65504"""))
def half_overflow(spark, sf):
    return profile.half_overflow(X.dense(spark, sf), "features")


@query("ag19_one_sided_columns", X.sql(X.D_DENSE, "cells as (select vec_id, label, unnest(range(0,67))::int col, unnest(features) v from dense)",
    "m as (select max(vec_id) hi from embeddings)",
    "a as (select col, min(v) train_min, max(v) train_max from cells, m where vec_id*2<hi and not isnan(v) group by 1)",
    "b as (select col, min(v) test_min, max(v) test_max from cells, m where vec_id*2>=hi and not isnan(v) group by 1)", body="""
select a.*, test_min, test_max, case when test_min>train_max then 'above' else 'below' end as side from a join b using (col)
where test_min>train_max or test_max<train_min"""))
def one_sided_columns(spark, sf):
    df = X.dense(spark, sf)
    half = profile.scalar(df, F.max("vec_id"))
    late = F.col("vec_id") * 2 >= half
    return profile.one_sided_columns(df.filter(~late), df.filter(late), "features")


@query("ag20_integrity_checks", X.sql(X.D_LIB, X.D_LONG, "p as (select mol_id, count(*) n, count(distinct protein) k from long group by 1)",
    X.D_TRAIN, X.D_TEST, body="""
select 'every_kind_present' as "check", count(*) filter (k<>3)=0 as ok, count(*) filter (k<>3) as n_bad from p union all
select 'one_row_per_kind', count(*) filter (n<>3)=0, count(*) filter (n<>3) from p union all
select 'key_in_range', count(*) filter (mol_id<0)=0, count(*) filter (mol_id<0) from p union all
select 'counts_add_up', sum(n)=3*count(*), abs(sum(n)-3*count(*))::bigint from p union all
select 'disjoint_bb1', count(*)=0, count(*) from (select bb1 from train intersect select bb1 from test)"""))
def integrity_checks(spark, sf):
    return profile.integrity_checks(X.assay_long(spark, sf)).unionByName(
        profile.disjoint_check(X.train(spark, sf), X.test(spark, sf), "bb1")
    )


@query("wn1_count_over_key", X.sql(X.D_LIB, body="select mol_id, count(*) over (partition by scaffold) as mol_per_scaf from lib"))
def count_over_key(spark, sf):
    lib = X.lib(spark, sf).select("mol_id", "scaffold")
    return profile.with_group_stats(lib, "scaffold", ["mol_id"], {}, "mol_per_scaf").select("mol_id", "mol_per_scaf")


@query("wn2_sum_over_key", X.sql(X.D_LIB, body="""
select mol_id, """ + ", ".join(f"(sum({c}) over w)::bigint as pos_{n}" for n, c in [*((t, t) for t in TARGETS), ("any", "greatest(BRD4,HSA,sEH)")]) + " from lib window w as (partition by scaffold)"))
def sum_over_key(spark, sf):
    lib = X.lib(spark, sf).select("mol_id", "scaffold", *TARGETS)
    stats = {f"pos_{t}": F.sum(t) for t in TARGETS} | {"pos_any": F.sum(predicates.any_positive())}
    return profile.with_group_stats(lib, "scaffold", ["mol_id"], stats).select("mol_id", *stats)


@query("sl1_sort_by_frequency", X.sql(X.D_LIB, body="""
select bb2, grp, count(*) over (partition by grp) as frequency from (select distinct bb2, bb2%7 as grp from lib)"""))
def sort_by_frequency(spark, sf):
    blocks = X.lib(spark, sf).selectExpr("bb2", "bb2%7 grp").distinct()
    return profile.by_frequency(blocks, "grp", "bb2")


_IMP = """imp as (select label%3 as class, col::int as feature, avg(abs(v)) importance from
 (select label, unnest(range(0,64)) col, unnest(embedding)::double v from embeddings) group by all)"""


def _importance(spark, sf):
    cells = X.table(spark, sf, "embeddings").select(
        (F.col("label") % 3).alias("class"), F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "v")
    )
    return cells.groupBy("class", "feature").agg(F.avg(F.abs("v")).alias("importance"))


@query("sl2_top_k_features", X.sql(_IMP, body=f"""
select class, feature, {d6('importance')} as importance from
(select *, row_number() over (partition by class order by importance desc, feature) rn from imp) where rn<=10"""))
def top_k_features(spark, sf):
    return rounded(profile.top_k_features(_importance(spark, sf), 10, ["class"]), "importance")


@query("sl2_projected_features", X.sql(
    _IMP, "top as (select class, feature, rn from (select *, row_number() over (partition by class order by importance desc, feature) rn from imp) where rn<=10)",
    "tl as (select class, list(feature order by rn) fs from top group by 1)", body="select vec_id, " + ", ".join(
        f"(select array_to_string(list_transform(fs, lambda f: (embedding[f+1]>0)::int), ',') from tl where class={c}) as top_{c}" for c in range(3)) + " from embeddings"))
def projected_features(spark, sf):
    """Sign bits of the ten best positions per class, out of packed bytes."""
    packed = X.table(spark, sf, "embeddings").selectExpr("vec_id", "transform(embedding, v -> int(v>0)) bits")
    packed = packed.select("vec_id", features.pack_bits("bits").alias("packed"))
    out = features.project_top_features(packed, "packed", _importance(spark, sf), 10, "class")
    return out.select("vec_id", *[joined(f"top_{c}").alias(f"top_{c}") for c in range(3)])


_LOG = "log as (select event_type as metric, (user_id%4)::int as model, (event_id//100)::bigint as step, (event_id//1000)::bigint as epoch, value from events)"


@query("sl3_best_metrics", X.sql(_LOG, """
one as (select * from (select *, row_number() over (partition by metric, step order by
 case when metric in ('error','view') then value else -value end, model) r from log) where r=1)""", body="""
select metric, model, step, epoch, value, rank::int as rank from (
 select metric, model, step, epoch, value, row_number() over (partition by metric order by
 case when metric in ('error','view') then value else -value end, epoch desc, step desc) as rank from one) where rank<=5"""))
def best_metrics(spark, sf):
    log = X.table(spark, sf, "events").selectExpr(
        "event_type metric", "cast(user_id%4 as int) model", "event_id div 100 step", "event_id div 1000 epoch", "value"
    )
    return metrics.best_metrics(log, {"error": "min", "view": "min"}, default="max", top_k=5)
