"""Subsampling, weights and batch plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.functions.hashing import uniform
from combisieve.operators import predicates, sampling
from workload import fixtures as X
from workload.base import d6, query, rounded

H = X.d_hash("mol_id::varchar")
ANY = "greatest(BRD4,HSA,sEH)"


def _lib(spark, sf):
    return X.lib(spark, sf).select("mol_id", "scaffold", *TARGETS).withColumn("label", predicates.any_positive())


@query("sa1_subsample", X.sql(X.D_LIB, body=f"""
select mol_id, scaffold from (select *, row_number() over (order by {H}, mol_id) r, count(*) over () n from lib) where r<=n//3"""))
def subsample(spark, sf):
    lib = _lib(spark, sf).select("mol_id", "scaffold")
    return sampling.subsample(lib, ["mol_id"], lib.count() // 3)


@query("sa2_group_size_weights", X.sql(X.D_LIB, body="select mol_id, " + ", ".join(
    f"{d6(f'1/pow((count(*) over (partition by scaffold))::double,{p})')} as w{i}" for i, p in enumerate((1.0, 0.5, 2.0))) + " from lib"))
def group_size_weights(spark, sf):
    lib, out = _lib(spark, sf).select("mol_id", "scaffold"), None
    for i, p in enumerate((1.0, 0.5, 2.0)):
        part = sampling.group_size_weights(lib, "scaffold", ["mol_id"], p, f"w{i}").drop("scaffold")
        out = part if out is None else out.join(part, "mol_id")
    return rounded(out, "w0", "w1", "w2")


def _d_weights(damped: str, limit: str) -> str:
    return X.sql(
        X.D_LIB,
        f"s as (select scaffold, count(*)::double m, sum({ANY})::double pos from lib group by 1)",
        f"b as (select {limit} as base)",
        f"""g as (select scaffold, m, pos, case when pos=0 then case when m<=base then m else {damped} end
 else pos/case when pos=m then 1 else least(greatest(pos/m,0.1::double),0.9::double) end end as w,
 case when pos=0 then 0 when pos=m then 1 else least(greatest(pos/m,0.1::double),0.9::double) end as c from s, b)""",
        body=f"""select mol_id, {d6(f"case when {ANY}=1 then w*c/pos else w*(1-c)/(m-pos) end")} as sample_weight from lib join g using (scaffold)""",
    )


@query("sa3_balanced_group_weights", _d_weights("base*pow(m/base,0.5::double)", "7.890688942998526::double"))
def balanced_group_weights(spark, sf):
    out = sampling.balanced_group_weights(_lib(spark, sf), "scaffold", ["mol_id"], base=7.890688942998526)
    return rounded(out.select("mol_id", "sample_weight"), "sample_weight")


@query("sa3_balanced_group_weights_log", _d_weights("base*(ln(m/base)+1)", "(select coalesce(avg(m) filter (pos=0), 5) from s)"))
def balanced_group_weights_log(spark, sf):
    lib = _lib(spark, sf)
    # the fixture may have no all-negative group to take a base from
    has = lib.groupBy("scaffold").agg(F.max("label").alias("y")).filter("y = 0").limit(1).count()
    out = sampling.balanced_group_weights(lib, "scaffold", ["mol_id"], base=None if has else 5.0, mode="log")
    return rounded(out.select("mol_id", "sample_weight"), "sample_weight")


@query("sa3_balanced_group_weights_log_base", _d_weights("base*(ln(m/base)/ln(3::double)+1)", "7.890688942998526::double"))
def balanced_group_weights_log_base(spark, sf):
    out = sampling.balanced_group_weights(_lib(spark, sf), "scaffold", ["mol_id"], base=7.890688942998526, mode="log", log_base=3.0)
    return rounded(out.select("mol_id", "sample_weight"), "sample_weight")


# weights in units of 2**-40 of the largest, then about 2**52 units for the whole line
_D_DRAWS = [
    "un as (select id, h, ceil(x/(select max(x) from wt)*1099511627776::double)::hugeint w from wt where x>0)",
    "it as (select id, h, ((w*4503599627370496+(select sum(w) from un)-1)//(select sum(w) from un))::bigint w from un)",
    "tot as (select sum(w)::bigint t, (select count(*) from lib) n from it)",
    "line as (select id, sum(w) over (order by (w*1024>t) desc, h, id)-w as s from it, tot)",
    f"draws as (select draw, floor({X.d_uniform('draw::varchar', 'draw42')}*t::double)::bigint v from tot, lateral (select unnest(range(0,n)) draw))",
]


@query("sa4_weighted_sample", X.sql(X.D_LIB,
    f"wt as (select mol_id as id, 1/({X.d_uniform('mol_id::varchar', 'w')}+0.00001::double) x, {H} h from lib)", *_D_DRAWS,
    body="select draw, id from draws asof join line on v>=s"))
def weighted_sample(spark, sf):
    lib = _lib(spark, sf).withColumn("w", 1.0 / (uniform("mol_id", seed="w") + F.lit(0.00001)))
    return sampling.weighted_sample(lib, "mol_id", "w", lib.count())


@query("sa4_group_size_sample", X.sql(X.D_LIB,
    f"wt as (select mol_id as id, 1/pow(count(*) over (partition by scaffold)::double, 2) x, {H} h from lib)", *_D_DRAWS,
    body="select draw, id from draws asof join line on v>=s"))
def group_size_sample(spark, sf):
    lib = _lib(spark, sf)
    return sampling.weighted_sample(sampling.group_size_weights(lib, "scaffold", ["mol_id"], 2.0), "mol_id", "sample_weight", lib.count())


_D_POISSON = [
    f"wt as (select mol_id, 7::double*(1/({X.d_uniform('mol_id::varchar', 'w')}+0.1::double)) mean from lib)",
    "pt as (select mol_id, ceil(mean/16)::bigint parts, mean/ceil(mean/16) own from wt)",
    f"us as (select mol_id, own, {X.d_uniform(chr(39) + chr(39) + '||mol_id::varchar||' + chr(39) + ':' + chr(39) + '||part::varchar')} u from (select *, unnest(range(parts)) part from pt))",
    """kn as (select mol_id, list_reduce(list_concat([[exp(-own), exp(-own), 0::double]], list_transform(range(1, 121), lambda i: [i::double, 0, 0])),
 lambda a, x: [a[1]*own/x[1], a[2]+a[1]*own/x[1], a[3]+case when a[2]<=u then 1 else 0 end])[3]::bigint k from us)""",
]


@query("sa4_poisson_sample", X.sql(X.D_LIB, *_D_POISSON, body="select mol_id, sum(k)::bigint as n from kn group by 1 having sum(k)>0"))
def poisson_sample(spark, sf):
    lib = _lib(spark, sf).withColumn("w", 1.0 / (uniform("mol_id", seed="w") + F.lit(0.1)))
    return sampling.poisson_sample(lib.select("mol_id", "w"), ["mol_id"], "w", 7.0).select("mol_id", "n")


@query("sa5_epoch_shards", X.sql(X.D_LIB, f"""p as (select mol_id, e*(select count(*) from lib)+row_number() over
 (partition by e order by {X.d_hash("e::varchar||':'||mol_id::varchar")}, mol_id)-1 as pos from lib, (select unnest(range(0,2)) e))""",
    body="select mol_id, (pos%4)::int as shard, pos//4 as step from p"))
def epoch_shards(spark, sf):
    return sampling.epoch_shards(_lib(spark, sf), ["mol_id"], 4, 2)


RATIOS = (0.25, 0.15, 0.05, None)
BATCH = 64


def _d_epoch(e: int, ratio) -> list[str]:
    def key(seed):
        return X.d_hash("p::varchar||':'||mol_id::varchar", seed)

    if ratio is None:
        return [f"""e{e} as (select mol_id, r//{BATCH} as batch, r%{BATCH} as slot from
 (select mol_id, row_number() over (order by {X.d_hash("'0:'||mol_id::varchar", 42 + e)}, mol_id)-1 r from lib))"""]
    return [
        f"a{e} as (select n_pos, n_neg, ceil((floor({ratio!r}::double/(1-{ratio!r}::double)*n_neg)+n_neg)/{BATCH})::bigint b from n)",
        f"c{e} as (select *, b*{BATCH}-n_neg asked, greatest((b*{BATCH}-n_neg)//b,1) per, case when (b*{BATCH}-n_neg)//b<1 then b else b*{BATCH}-n_neg end pos from a{e})",
        f"""q{e} as (select *, pos-per*b extra, {BATCH}-per wide, {BATCH}-per-1 narrow, ('0x'||substr(md5('42:batch:{e}'),1,15))::bigint raw from c{e})""",
        f"""s{e} as (select *, (select min(x) from (select unnest(range(greatest(raw%b,1),greatest(raw%b,1)+1000)) x) where gcd(x,b)=1)%b step, (raw//b)%b shift from q{e})""",
        f"""x{e} as (select mol_id, p*n_pos+row_number() over (partition by p order by {key(42 + e)}, mol_id)-1 k
 from lib, s{e}, lateral (select unnest(range(0, ceil(pos/n_pos::double)::bigint)) p) where {ANY}=1)""",
        f"y{e} as (select mol_id, row_number() over (order by {X.d_hash(chr(39) + '0:' + chr(39) + '||mol_id::varchar', 42 + e)}, mol_id)-1 k from lib where {ANY}=0)",
        f"""e{e} as (select mol_id, (l*step+shift)%b as batch, slot from (
 select mol_id, case when k<per*b then k//per else k-per*b end l, case when k<per*b then k%per else per end slot from x{e}, s{e} where k<pos union all
 select mol_id, case when k<extra*narrow then k//narrow else extra+(k-extra*narrow)//wide end,
  case when k<extra*narrow then per+1+k%narrow else per+(k-extra*narrow)%wide end from y{e}, s{e} where k<extra*narrow+(b-extra)*wide), s{e})""",
    ]


@query("sa6_balanced_batches", X.sql(
    X.D_LIB, f"n as (select sum({ANY})::bigint n_pos, (count(*)-sum({ANY}))::bigint n_neg from lib)",
    *[c for e, r in enumerate(RATIOS) for c in _d_epoch(e, r)],
    body=X.union_all([f"select {e} as epoch, batch, slot, mol_id from e{e}" for e in range(len(RATIOS))])))
def balanced_batches(spark, sf):
    ratios = sampling.epoch_ratios(1, 9, 4, 2, 1, 0.25, 0.15, 0.05)
    return sampling.balanced_batches(_lib(spark, sf), ["mol_id"], "label", BATCH, ratios)


def _d_chunk(value: int) -> str:
    n = "n_pos" if value else "n_neg"
    take = "tp" if value else "tn"
    return f"""z{value} as (select k//{take} as chunk, mol_id, k, {take}*c as used from (select mol_id, tp, tn, c,
 p*{n}+row_number() over (partition by p order by {X.d_hash("p::varchar||':'||mol_id::varchar", f"42{value}")}, mol_id)-1 k
 from lib, t, lateral (select unnest(range(0, ceil({take}*c/{n}::double)::bigint)) p) where {ANY}={value}))"""


@query("sa7_pos_neg_chunks", X.sql(
    X.D_LIB, f"n as (select sum({ANY})::bigint n_pos, (count(*)-sum({ANY}))::bigint n_neg from lib)",
    "t0 as (select *, floor(n_pos*0.4::double)::bigint tp, floor(floor(n_pos*0.4::double)*5.0::double)::bigint tn from n)",
    "t as (select *, greatest(n_pos//tp, n_neg//tn)+1 c from t0)", _d_chunk(1), _d_chunk(0), body=X.union_all([
        f"select chunk::int as chunk, {v} as label, mol_id from z{v} where k<used" for v in (1, 0)])))
def pos_neg_chunks(spark, sf):
    return sampling.pos_neg_chunks(_lib(spark, sf), ["mol_id"], "label", 5.0, 0.4)


@query("sa8_keep_positives_downsample", X.sql(X.D_LIB, body=f"""
select mol_id, {ANY} as label from (select *, count(*) over () n, sum({ANY}) over () np,
 row_number() over (partition by {ANY} order by {H}, mol_id) r from lib) where {ANY}=1 or r<=n//2-np"""))
def keep_positives_downsample(spark, sf):
    lib = _lib(spark, sf)
    return sampling.keep_positives_downsample(lib, ["mol_id"], lib.count() // 2).select("mol_id", "label")
