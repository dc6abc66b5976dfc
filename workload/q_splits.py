"""Cross-validation splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.operators import predicates, profile, reshape, splits
from workload import fixtures as X
from workload.base import d6, query, rounded

HELD = {"bb1": X.HELD_BB1, "bb2": X.HELD_BB23, "bb3": X.HELD_BB23}
D_ALL = "(bb1 between 0 and 4 and bb2 between 100 and 119 and bb3 between 100 and 119)"
D_ANY = "(bb1 between 0 and 4 or bb2 between 100 and 119 or bb3 between 100 and 119)"
H = X.d_hash("mol_id::varchar")
LABEL = "BRD4*4+HSA*2+sEH"


def _lib(spark, sf):
    return X.lib(spark, sf).select("mol_id", "bb1", "bb2", "bb3", "scaffold", *TARGETS).withColumn(
        "label", predicates.bitmask_label()
    )


def d_lpt(groups: str, k: str, pre: str = "") -> str:
    """Sequential largest-first assignment of ``groups(key, size)`` to ``k``
    folds, as CTEs that end in ``{pre}gf(key, size, fold)``."""
    pick = "list_position(loads, list_min(loads))"
    return f"""
{pre}o as (select key, size, row_number() over (order by size desc, h, key) i, row_number() over (partition by size order by h, key)-1 r
 from (select key, size, {X.d_hash("key::varchar")} h from {groups})),
{pre}rec as (select 0::bigint i, list_transform(range(0,{k}), lambda x: 0::bigint) loads, -1::bigint fold, 0::bigint size union all
 select o.i, list_transform(range(1,{k}+1), lambda j: loads[j]+case when j={pick} then o.size else 0 end), ({pick}-1)::bigint, o.size
 from {pre}rec r join {pre}o o on o.i=r.i+1),
{pre}cum as (select size, fold, c, sum(c) over (partition by size order by fold) e from
 (select size, fold, count(*) c from {pre}rec where i>0 group by all)),
{pre}gf as (select o.key, o.size, c.fold from {pre}o o join {pre}cum c on o.size=c.size and o.r>=e-c.c and o.r<e)"""


@query("sp1_kfold", X.sql(X.D_LIB, body=f"""
select mol_id, ((row_number() over (order by {H}, mol_id)-1)%5)::int as fold_idx from lib"""))
def kfold(spark, sf):
    return splits.kfold(_lib(spark, sf).select("mol_id"), ["mol_id"], 5)


@query("sp2_stratified_kfold", X.sql(X.D_LIB, body=f"""
select mol_id, {LABEL} as label, ((row_number() over (partition by {LABEL} order by {H}, mol_id)-1)%5)::int as fold_idx from lib"""))
def stratified_kfold(spark, sf):
    return splits.stratified_kfold(_lib(spark, sf).select("mol_id", "label"), ["mol_id"], ["label"], 5)


_GROUPS = "g as (select scaffold as key, count(*) as size from lib group by 1)"


@query("sp3_group_kfold", X.sql(X.D_LIB, _GROUPS, d_lpt("g", "5"), recursive=True, body="""
select mol_id, scaffold, fold::int as fold_idx from lib join gf on key=scaffold"""))
def group_kfold(spark, sf):
    return splits.group_kfold(_lib(spark, sf).select("mol_id", "scaffold"), "scaffold", ["mol_id"], 5)


@query("sp3_group_fold_loads", X.sql(
    X.D_LIB, "g as (select concat(bb2::varchar,'-',bb3::varchar) as key, count(*) as size from lib group by 1)",
    d_lpt("g", "7"), recursive=True, body="select fold::int as fold_idx, sum(size)::bigint as load, count(*) as n_groups from gf group by 1"))
def group_fold_loads(spark, sf):
    lib = _lib(spark, sf).withColumn("pair", F.concat_ws("-", "bb2", "bb3"))
    folds, _ = splits.group_folds(lib, "pair", 7)
    return folds.groupBy("fold_idx").agg(F.sum("group_size").alias("load"), F.count(F.lit(1)).alias("n_groups"))


def d_mix(cells: str, k: int, pre: str = "") -> str:
    """Group after group of ``cells(p, key, label, n)`` in the order (uneven
    labels, size, mix, hash) to the fold of its part ``p`` where it adds least to
    the squared label shares, as CTEs that end in ``{pre}gf(p, key, fold)``."""
    cost = "list_sum(list_transform(range(1, len(o.v)+1), lambda j: loads[f][j]*o.v[j]*o.w[j]))"
    return f"""
{pre}l as (select p, label, 1000000000000000000000000000000000000::hugeint // (sum(n)*sum(n))::hugeint w from {cells} group by all),
{pre}m as (select p, key, list_sort(list(n::varchar||':'||label::varchar)) mix from {cells} group by all),
{pre}u as (select l.p, g.key, list(coalesce(n,0)::hugeint order by l.label) v, list(w order by l.label) w, sum(coalesce(n,0))::bigint size,
 count(*)*sum(coalesce(n,0)*coalesce(n,0))-sum(coalesce(n,0))*sum(coalesce(n,0)) uneven
 from {pre}l l join (select distinct p, key from {cells}) g on g.p=l.p left join {cells} c on c.p=l.p and c.key=g.key and c.label=l.label group by all),
{pre}o as (select u.*, mix, row_number() over (partition by u.p order by uneven desc, size desc, mix, {X.d_hash("u.key::varchar")}, u.key) i,
 row_number() over (partition by u.p, mix order by {X.d_hash("u.key::varchar")}, u.key)-1 r from {pre}u u join {pre}m m on m.p=u.p and m.key=u.key),
{pre}rec as (select p, 0::bigint i, list_transform(range(0,{k}), lambda x: list_transform(any_value(v), lambda y: 0::hugeint)) loads,
 list_transform(range(0,{k}), lambda x: 0::bigint) tot, 0::bigint fold, []::varchar[] mix from {pre}o where i=1 group by p union all
 select p, i, list_transform(range(1,{k}+1), lambda f: case when f=pick then list_transform(range(1, len(v)+1), lambda j: loads[f][j]+v[j]) else loads[f] end),
 list_transform(range(1,{k}+1), lambda f: tot[f]+case when f=pick then size else 0 end), pick-1, mix from (
 select o.p, o.i, loads, tot, o.v, o.size, o.mix, list_sort(list_transform(range(1,{k}+1), lambda f:
 {{'c': {cost}, 't': tot[f], 'f': f}}))[1].f pick from {pre}rec r join {pre}o o on o.p=r.p and o.i=r.i+1)),
{pre}cum as (select p, mix, fold, c, sum(c) over (partition by p, mix order by fold) e from
 (select p, mix, fold, count(*) c from {pre}rec where i>0 group by all)),
{pre}gf as (select o.p, o.key, c.fold from {pre}o o join {pre}cum c on o.p=c.p and o.mix=c.mix and o.r>=e-c.c and o.r<e)"""


@query("sp4_stratified_group_kfold", X.sql(
    X.D_LIB, f"cells as (select 0 as p, scaffold as key, {LABEL} as label, count(*) as n from lib group by all)",
    d_mix("cells", 5), recursive=True, body="""
select mol_id, scaffold, fold::int as fold_idx from lib join gf on key=scaffold"""))
def stratified_group_kfold(spark, sf):
    lib = _lib(spark, sf)
    return splits.stratified_group_kfold(lib, "scaffold", ["mol_id"], "label", 5).select("mol_id", "scaffold", "fold_idx")


@query("sp5_two_level_block_folds", X.sql(
    X.D_LIB, f"cells as (select 0 as p, bb1 as key, {LABEL} as label, count(*) as n from lib group by all)", d_mix("cells", 4),
    f"""held as (select fold as p, bb2 as key, {LABEL} as label from lib join gf on gf.key=bb1 union all
 select fold, bb3, {LABEL} from lib join gf on gf.key=bb1 where bb3<>bb2)""",
    "cells2 as (select p, key, label, count(*) as n from held group by all)", d_mix("cells2", 6, "b"), recursive=True, body="""
select fold::int as bb1_fold, 'bb1' as side, key as block, fold::int as fold_idx from gf union all
select p::int, 'bb23', key, fold::int from bgf"""))
def two_level_block_folds(spark, sf):
    return splits.two_level_block_folds(_lib(spark, sf), "label", 4, 6)


_CHUNKS = """c23 as (select block, case when i<(n%8)*(n//8+1) then i//(n//8+1) else n%8+(i-(n%8)*(n//8+1))//(n//8) end::int as chunk from
 (select block, row_number() over (order by block)-1 i, count(*) over () n from (select bb2 as block from lib union select bb3 from lib)))"""


def _bb23_chunks(spark, sf, n=8):
    blocks = reshape.build_dictionary([(X.lib(spark, sf), "bb2"), (X.lib(spark, sf), "bb3")], "block", "i")
    return splits.ntile_chunks(blocks.select("block"), ["block"], n)


@query("sp6_ntile_chunks", X.sql(X.D_LIB, _CHUNKS, body="select * from c23"))
def ntile_chunks(spark, sf):
    return _bb23_chunks(spark, sf)


@query("sp7_cyclic_windows", X.sql(X.D_LIB, _CHUNKS, body="""
select block, chunk, slot::int as slot, ((chunk-slot+8)%8)::int as cell from c23, (select unnest(range(0,3)) slot)"""))
def cyclic_windows(spark, sf):
    return splits.cyclic_windows(_bb23_chunks(spark, sf), "chunk", 8, 3)


_GRID_PARTS = [
    X.D_LIB, _CHUNKS,
    "b1 as (select bb1 as block, count(*) as size from lib group by 1)", "g as (select block//3 as key, count(*) as size from b1 group by 1)",
    d_lpt("g", "5"),
    "c1 as (select block, fold::int chunk from b1 join gf on key=block//3)",
    *[f"p{s} as (select c::int chunk, row_number() over (order by {X.d_hash('c::varchar', '42' + n)}, c)-1 pos from (select unnest(range(0,{k})) c))"
      for s, n, k in ((1, "bb1", 5), (23, "bb23", 8))],
    "w1 as (select block, ((pos-slot+5)%5)::int cell from c1 join p1 using (chunk), (select unnest(range(0,2)) slot))",
    "w23 as (select block, ((pos-slot+8)%8)::int cell from c23 join p23 using (chunk), (select unnest(range(0,3)) slot))",
    """cells as (select 'bb1' as side, block, cell*8+o as grid_idx from w1, (select unnest(range(0,8)) o) union all
 select 'bb23', block, o*8+cell from w23, (select unnest(range(0,5)) o))""",
]


@query("sp8_block_grid", X.sql(*_GRID_PARTS, recursive=True, body="""
select side, block, grid_idx::int as grid_idx, (n1*n23*(n23+1)/2)::double as expected_rows from cells join
(select grid_idx, count(*) filter (side='bb1') n1, count(*) filter (side='bb23') n23 from cells group by 1) using (grid_idx)"""))
def block_grid(spark, sf):
    # first blocks by scaffold group folds, pair blocks by chunks
    blocks = X.lib(spark, sf).select(F.col("bb1").alias("block")).distinct()
    blocks = blocks.withColumn("grp", F.expr("block div 3"))
    first = splits.group_kfold(blocks, "grp", ["block"], 5, name="chunk").select("block", "chunk")
    return splits.block_grid(first, _bb23_chunks(spark, sf), 5, 8, 2, 3)


@query("jn3_grid_cells", X.sql(*_GRID_PARTS, recursive=True, body="""
select grid_idx::int as grid_idx, count(*) filter (side='bb1') as n_bb1, count(*) filter (side='bb23') as n_bb23 from cells group by 1"""))
def grid_cells(spark, sf):
    return block_grid(spark, sf).groupBy("grid_idx").agg(
        F.count_if(F.col("side") == "bb1").alias("n_bb1"), F.count_if(F.col("side") == "bb23").alias("n_bb23")
    )


_S9 = [
    X.D_LIB,
    f"""s as (select *, {LABEL} as label, count(*) over (partition by scaffold) as sz, {D_ALL} as all_in, {D_ANY} as any_in from lib)""",
    "n as (select count(*) filter (all_in) n0, count(*) filter (not any_in) n_open, count(*) filter (not any_in and sz between 1 and 6116) n_small from s)",
    f"""par as (select *, round_even({splits.STAGE2_RATIO!r}::double*n0,0)::bigint size2, round_even({splits.STAGE23_RATIO!r}::double*n0,0)::bigint size23,
 round_even(1/(round_even({splits.STAGE2_RATIO!r}::double*n0,0)/n_small),0)::bigint k2 from n)""",
    "g as (select scaffold as key, count(*) as size from s where not any_in and sz between 1 and 6116 group by 1)",
    d_lpt("g", "(select k2 from par)"),
    "f0 as (select coalesce(sum(size),0)::bigint load from gf where fold=0)",
    "k3 as (select round_even(1/((size23-load)/(n_open-load)::double),0)::bigint k from par, f0)",
    "t as (select s.*, coalesce(not any_in and sz between 1 and 6116 and gf.fold=0, false) as s2 from s left join gf on gf.key=s.scaffold)",
    f"r as (select *, row_number() over (partition by not any_in and not s2, label order by {H}, mol_id)-1 as rk from t)",
]


@query("sp9_three_stage_split", X.sql(*_S9, recursive=True, body="""
select mol_id, (case when all_in then 0 when any_in then 1 when s2 then 2 when rk%(select k from k3)=0 then 3 end)::int as subset from r"""))
def three_stage_split(spark, sf):
    sized = profile.with_group_stats(_lib(spark, sf), "scaffold", ["mol_id"], {}, "mol_per_scaf")
    out = splits.three_stage_split(sized, ["mol_id"], HELD, "scaffold", "mol_per_scaf", "label")
    return out.select("mol_id", "subset")


@query("sp10_sample_blocks", X.sql(X.D_LIB, "b as (" + X.union_all([
    f"select distinct '{c}' as position, {c} as block, {f}::double as f from lib" for c, f in (("bb1", 0.2053), ("bb2", 0.3921), ("bb3", 0.373))])
    + ")", body=f"""
select position, block from (select *, row_number() over (partition by position order by {X.d_hash("position||':'||block::varchar")}, block)-1 rk,
 count(*) over (partition by position) n from b) where rk<round_even(f*n,0)"""))
def sample_blocks(spark, sf):
    return splits.sample_blocks(X.lib(spark, sf), {"bb1": 0.2053, "bb2": 0.3921, "bb3": 0.373})


_FOLDS = f"folds as (select mol_id as \"index\", ((row_number() over (order by {H}, mol_id)-1)%5)::int as fold_idx from lib)"
_VAL = f"val as (select mol_id as \"index\", case when {D_ALL} then 0 when {D_ANY} then 1 else 2+mol_id%2 end as subset from lib)"


def _val(spark, sf):
    return _lib(spark, sf).select(
        F.col("mol_id").alias("index"),
        F.when(predicates.in_sets(HELD, "all"), 0).when(predicates.in_sets(HELD, "any"), 1)
        .otherwise(2 + F.col("mol_id") % 2).alias("subset"),
    )


@query("sp11_select_stage", X.sql(X.D_LIB, _FOLDS, _VAL, body=X.union_all([
    f"select 'grid {s}' as what, mol_id as \"index\", 3 as subset from lib where {D_ALL}" for s in ("train", "val")]) + f"""
 union all select 'nonshare train', mol_id, 3 from lib where not {D_ANY}
 union all select 'nonshare val', mol_id, 3 from lib where {D_ALL}
 union all select 'overfit train', mol_id, 3 from lib where {D_ALL}
 union all select 'kf train', "index", 3 from folds where fold_idx<>2
 union all select 'kf val', "index", 3 from folds where fold_idx=2
 union all select 'kf all', "index", 3 from folds
 union all select 'named train', "index", 3 from folds where fold_idx<>1
 union all select 'named val', "index", subset::int from val where subset<>1"""))
def select_stage(spark, sf):
    df = _lib(spark, sf).withColumnRenamed("mol_id", "index")
    folds = splits.kfold(df.select("index"), ["index"], 5)
    calls = {
        "grid train": ("bb_grid-scaffold", "train", {"blocks": HELD}),
        "grid val": ("bb_grid-scaffold", "val", {"blocks": HELD}),
        "nonshare train": ("nonshare-split", "train", {"blocks": HELD}),
        "nonshare val": ("nonshare-split", "val", {"blocks": HELD}),
        "overfit train": ("nonshare-overfit-split", "train", {"blocks": HELD}),
        "kf train": ("skf5", "train", {"folds": folds, "fold_idx": 2}),
        "kf val": ("skf5", "val", {"folds": folds, "fold_idx": 2}),
        "kf all": ("skf5", "train", {"folds": folds, "fold_idx": 2, "train_on_all": True}),
        "named train": ("pseudo", "train", {"train_rows": folds.filter("fold_idx <> 1")}),
        "named val": ("pseudo", "val", {"val_rows": _val(spark, sf)}),
    }
    return X.stack_rows([
        splits.select_stage(df, s, g, **kw).withColumn("what", F.lit(n)) for n, (s, g, kw) in calls.items()
    ])


@query("sp12_complement_split", X.sql(X.D_LIB, _VAL, body="""
select mol_id as "index" from lib where mol_id not in (select "index" from val where subset in (2,3))"""))
def complement_split(spark, sf):
    df = _lib(spark, sf).select(F.col("mol_id").alias("index"))
    return splits.complement_split(df, _val(spark, sf))


@query("sp13_fold_report", X.sql(X.D_LIB, f"f as (select *, {LABEL} as label, ((row_number() over (order by {H}, mol_id)-1)%5)::int as fold_idx from lib)",
    body="select fold_idx, count(*) as n, " + ", ".join(f"count(*) filter (label={v}) as label_{v}" for v in range(8))
    + ", " + ", ".join(f"{d6(f'avg({t})')} as rate_{t}" for t in TARGETS) + " from f group by 1"))
def fold_report(spark, sf):
    folded = splits.kfold(_lib(spark, sf), ["mol_id"], 5)
    return rounded(splits.fold_report(folded, "label"), *[f"rate_{t}" for t in TARGETS])
