"""Predicates, reshaping, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.operators import joins, predicates, profile, reshape
from workload import fixtures as X
from workload.base import d6, query, rounded

HELD = "bb1 between 0 and 4 {op} bb2 between 100 and 119 {op} bb3 between 100 and 119"
SETS = {"bb1": X.HELD_BB1, "bb2": X.HELD_BB23, "bb3": X.HELD_BB23}


@query("pf1_in_set", X.sql(X.D_LIB, body=X.union_all([
    f"select '{m}' as mode, mol_id, bb1, bb2, bb3 from lib where {neg}({HELD.format(op=op)})"
    for m, neg, op in (("all", "", "and"), ("any", "", "or"), ("none", "not ", "or"))])))
def in_set(spark, sf):
    lib = X.lib(spark, sf).select("mol_id", "bb1", "bb2", "bb3")
    return X.stack_rows([
        lib.filter(predicates.in_sets(SETS, m)).withColumn("mode", F.lit(m)) for m in ("all", "any", "none")
    ])


@query("pf1_in_set_table", X.sql(X.D_LIB, X.D_TRAIN, X.D_TEST, body="""
select mol_id, bb1, bb2 from lib where bb1 in (select bb1 from test where bb2<110) or bb2 in (select bb3 from train where HSA=1 and BRD4=1)"""))
def in_set_table(spark, sf):
    lib = X.lib(spark, sf).select("mol_id", "bb1", "bb2")
    left = X.test(spark, sf).filter("bb2<110").select("bb1")
    right = X.train(spark, sf).filter("HSA=1 and BRD4=1").select("bb3")
    return predicates.filter_in_set(lib, {"bb1": left, "bb2": right}, "any")


@query("pf2_size_between", X.sql(X.D_LIB, body="""
select mol_id, scaffold, group_size from (select mol_id, scaffold, count(*) over (partition by scaffold) group_size from lib)
where group_size between 1 and 300"""))
def size_between(spark, sf):
    sized = profile.with_group_stats(X.lib(spark, sf).select("mol_id", "scaffold"), "scaffold", ["mol_id"], {})
    return predicates.size_between(sized, "group_size", 1, 300)


@query("pf3_bitmask_label", X.sql(X.D_LIB, body="select mol_id, BRD4*4+HSA*2+sEH as label from lib"))
def bitmask_label(spark, sf):
    return X.lib(spark, sf).select("mol_id", predicates.bitmask_label().alias("label"))


@query("pf4_any_positive", X.sql(X.D_LIB, body="select mol_id, case when BRD4+HSA+sEH>0 then 1 else 0 end as label from lib"))
def any_positive(spark, sf):
    return X.lib(spark, sf).select("mol_id", predicates.any_positive().alias("label"))


@query("pf5_compact", X.sql(X.D_LIB, body="select mol_id, bb1::smallint bb1, bb2::smallint bb2, bb3::smallint bb3, scaffold from lib"))
def compact(spark, sf):
    return predicates.compact(
        X.lib(spark, sf), ["molecule", *TARGETS], {"bb1": "smallint", "bb2": "smallint", "bb3": "smallint"}
    )


_GROUPS = "groups as (select distinct bb1%4 as group_id, bb1 as member from lib union select distinct 4+bb2%7, bb2 from lib where bb2<140)"


@query("pf6_assign_group", X.sql(X.D_LIB, _GROUPS, body="""
select mol_id, cast(coalesce(greatest(a.g, b.g), -1) as int) as mol_group from lib
left join (select member, max(group_id) g from groups group by 1) a on a.member=bb2
left join (select member, max(group_id) g from groups group by 1) b on b.member=bb3"""))
def assign_group(spark, sf):
    lib = X.lib(spark, sf)
    groups = lib.selectExpr("bb1%4 group_id", "bb1 member").union(
        lib.filter("bb2<140").selectExpr("4+bb2%7", "bb2")
    ).distinct()
    return predicates.assign_group(lib.select("mol_id", "bb2", "bb3"), groups, ["bb2", "bb3"]).select("mol_id", "mol_group")


@query("pf7_segment_ids", X.sql(X.D_LIB, X.D_WIDE, body="select mol_id, group_BRD4, group_HSA, group_sEH from wide"))
def segment_ids(spark, sf):
    wide = X.test_wide(spark, sf)
    return wide.select("mol_id", *[predicates.segment_id("mol_group", p).alias(f"group_{t}") for p, t in enumerate(TARGETS)])


@query("rs1_long_to_wide", X.sql(X.D_LIB, X.D_LONG, body="""
select mol_id, max(case when protein='BRD4' then binds end) BRD4, max(case when protein='HSA' then binds end) HSA,
 max(case when protein='sEH' then binds end) sEH from long group by mol_id"""))
def long_to_wide(spark, sf):
    return reshape.long_to_wide(X.assay_long(spark, sf), ["mol_id"])


@query("rs2_ids_to_wide", X.sql(X.D_LIB, X.D_WIDE, body="""
select mol_id, id_BRD4, id_HSA, id_sEH, bb1, molecule, greatest(id_BRD4,id_HSA,id_sEH) as max_id from wide"""))
def ids_to_wide(spark, sf):
    long = reshape.wide_to_long(
        X.test_wide(spark, sf).drop("group_BRD4", "group_HSA", "group_sEH"), {"id": "id_"}
    )
    return reshape.ids_to_wide(long, "mol_id", carry=["bb1", "molecule"])


@query("rs3_wide_to_long", X.sql(X.D_LIB, X.D_WIDE, body=X.union_all([
    f"select mol_id, '{t}' protein, id_{t} id, group_{t} group_id from wide where id_{t}<>0" for t in TARGETS])))
def wide_to_long(spark, sf):
    long = reshape.wide_to_long(X.test_wide(spark, sf), {"id": "id_", "group_id": "group_"})
    return long.select("mol_id", "protein", "id", "group_id")


@query("rs4_attach_by_index", X.sql(X.D_LIB, body='select mol_id as "index", molecule, scaffold, BRD4 from lib'))
def attach_by_index(spark, sf):
    lib = X.lib(spark, sf).withColumnRenamed("mol_id", "index")
    return reshape.attach_by_index(lib.select("index", "molecule", "BRD4"), lib.select("index", "scaffold"))


_DICT = """dict as (select value, row_number() over (order by value)-1 as id from (
 select molecule as value from train union select molecule from test))"""


@query("rs5_build_dictionary", X.sql(X.D_LIB, X.D_TRAIN, X.D_TEST, _DICT, body="select * from dict"))
def build_dictionary(spark, sf):
    return reshape.build_dictionary([(X.train(spark, sf), "molecule"), (X.test(spark, sf), "molecule")])


@query("rs5_encode", X.sql(X.D_LIB, X.D_TRAIN, X.D_TEST, _DICT, body="""
select mol_id, id as molecule from lib join dict on molecule=value"""))
def encode(spark, sf):
    dictionary = build_dictionary(spark, sf)
    return reshape.encode(X.lib(spark, sf).select("mol_id", "molecule"), dictionary, ["molecule"])


@query("rs6_map_values", X.sql(X.D_LIB, X.D_TRAIN, body="""
select mol_id, coalesce(id,-1) as bb1 from lib left join
(select bb1 as value, row_number() over (order by bb1)-1 as id from (select distinct bb1 from train)) on bb1=value"""))
def map_values(spark, sf):
    known = reshape.build_dictionary([(X.train(spark, sf), "bb1")])
    return reshape.map_values(X.lib(spark, sf).select("mol_id", "bb1"), known, ["bb1"])


@query("rs6_unmapped_report", X.sql(X.D_LIB, body="""
select 'bb1' as "column", count(*) filter (bb1>=18) as n_unmapped from lib"""))
def unmapped_report(spark, sf):
    return reshape.unmapped_report(map_values(spark, sf), ["bb1"])


@query("rs7_replicate_by_group", X.sql(X.D_LIB, body="""
select mol_id, grp, unnest(range(1, 1+case grp when 0 then 1 when 1 then 2 when 2 then 3 else 5 end))::int as copy
from (select mol_id, cast(bb1%4 as int) grp from lib)"""))
def replicate_by_group(spark, sf):
    lib = X.lib(spark, sf).selectExpr("mol_id", "cast(bb1%4 as int) grp")
    return reshape.replicate_by_group(lib, "grp", {0: 1, 1: 2, 2: 3, 3: 5})


@query("rs8_swap_pair", X.sql(X.D_LIB, body=f"""
select mol_id, case when hit then bb3 else bb2 end bb2, case when hit then bb2 else bb3 end bb3 from
(select mol_id, bb2, bb3, {X.d_uniform("mol_id::varchar")}<0.5::double as hit from lib)"""))
def swap_pair(spark, sf):
    return reshape.swap_pair(X.lib(spark, sf).select("mol_id", "bb2", "bb3"), ["mol_id"])


@query("rs9_canonical_combo", X.sql(X.D_LIB, body="""
select mol_id, least(bb2,bb3)::varchar||'_'||greatest(bb2,bb3)::varchar as pair,
 array_to_string(list_sort([bb1,bb2,bb3]),'_') as combo from lib"""))
def canonical_combo(spark, sf):
    return X.lib(spark, sf).select(
        "mol_id",
        reshape.pair_key("bb2", "bb3").alias("pair"),
        reshape.canonical_combo("bb1", "bb2", "bb3").alias("combo"),
    )


@query("rs9_mirrored_combos", X.sql(X.D_LIB, body="""
select bb1, least(bb2,bb3) as low, greatest(bb2,bb3) as high, count(*) as n_rows from lib group by all
having bool_or(bb2<bb3) and bool_or(bb2>bb3)"""))
def mirrored_combos(spark, sf):
    return reshape.mirrored_combos(X.lib(spark, sf))


@query("rs10_combo_coverage", X.sql(X.D_LIB, body=f"""
select n_first, n_a, n_b, n_pair_blocks, observed, observed_unordered, n_first*n_a*n_b as possible,
 (n_first*(n_pair_blocks*(n_pair_blocks+1)//2)) as possible_unordered,
 {d6('observed/(n_first*n_a*n_b)::double')} as coverage,
 {d6('observed_unordered/(n_first*(n_pair_blocks*(n_pair_blocks+1)//2))::double')} as coverage_unordered from (
select count(distinct bb1) n_first, count(distinct bb2) n_a, count(distinct bb3) n_b,
 count(distinct (bb1,bb2,bb3)) observed, count(distinct (bb1,least(bb2,bb3),greatest(bb2,bb3))) observed_unordered,
 (select count(*) from (select bb2 from lib union select bb3 from lib)) n_pair_blocks from lib)"""))
def combo_coverage(spark, sf):
    return rounded(reshape.combo_coverage(X.lib(spark, sf)), "coverage", "coverage_unordered")


@query("jn1_left_join_m1", X.sql(X.D_LIB, X.D_TRAIN, body=f"""
select mol_id, l.bb1, {d6('r.BRD4')} as rate, r.n from lib l left join
(select bb1, avg(BRD4) BRD4, count(*) n from train group by bb1) r on l.bb1=r.bb1"""))
def left_join_m1(spark, sf):
    rates = X.train(spark, sf).groupBy("bb1").agg(F.avg("BRD4").alias("rate"), F.count(F.lit(1)).alias("n"))
    return rounded(joins.left_join_m1(X.lib(spark, sf).select("mol_id", "bb1"), rates, ["bb1"]), "rate")


@query("jn2_semi_join", X.sql(X.D_LIB, X.D_TRAIN, X.D_TEST, body="""
select mol_id, scaffold, 'seen' as part from test where scaffold in (select scaffold from train where BRD4=1) union all
select mol_id, scaffold, 'new' from test where scaffold not in (select scaffold from train where BRD4=1)"""))
def semi_join(spark, sf):
    test = X.test(spark, sf).select("mol_id", "scaffold")
    keys = X.train(spark, sf).filter("BRD4=1").select("scaffold")
    return X.stack_rows([
        joins.keep_keys(test, keys, ["scaffold"], inside).withColumn("part", F.lit(p))
        for inside, p in ((True, "seen"), (False, "new"))
    ])


@query("so1_union_tagged", X.sql(X.D_LIB, X.D_TRAIN, X.D_TEST, body="""
select mol_id, scaffold, 1 as is_train from train union all select mol_id, scaffold, 0 from test"""))
def union_tagged(spark, sf):
    return joins.union_tagged(X.train(spark, sf), X.test(spark, sf)).select("mol_id", "scaffold", "is_train")


@query("so2_set_algebra", X.sql(X.D_LIB, X.D_TRAIN, X.D_TEST, body="""
select bb1, (a*b) as in_both, (a*(1-b)) as only_a, (b*(1-a)) as only_b from (
select bb1, max(a)::int a, max(b)::int b from (select bb1, 1 a, 0 b from train union all select bb1, 0, 1 from test) group by bb1)"""))
def set_algebra(spark, sf):
    return joins.set_algebra(X.train(spark, sf).select("bb1"), X.test(spark, sf).select("bb1"))


@query("so2_sets_equal", X.sql(X.D_LIB, body="""
select not exists ((select bb2 from lib except select bb3 from lib) union all (select bb3 from lib except select bb2 from lib)) as equal"""))
def sets_equal(spark, sf):
    lib = X.lib(spark, sf)
    return joins.sets_equal(lib.select("bb2"), lib.select("bb3"))
