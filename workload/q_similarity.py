"""Similarity, matching, clusters and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from combisieve.operators import graph, matching, similarity, tokens
from combisieve.operators.similarity import similarity_pairs
from workload import fixtures as X
from workload.base import d6, query, rounded

D_DISTINCT = "v as (select w0, w1, min(vec_id) id, max(vec_id) last_id, count(*) copies, (bit_count(w0)+bit_count(w1))::int n from fp group by all)"
D_PAIR = "ab as (select a.id l, b.id r, a.copies lc, b.copies rc, a.n an, b.n bn, (bit_count(a.w0&b.w0)+bit_count(a.w1&b.w1))::int c from v a join v b on a.id<b.id)"
FORMULA = {
    "tanimoto": ("c/(an+bn-c)::double", 0.5),
    "dice": ("c*2.0::double/(an+bn)", 0.68),
    "cosine": ("c/sqrt((an*bn)::double)", 0.7),
    "tversky": ("c/(c+0.9::double*(an-c)+0.3::double*(bn-c))", 0.65),
}


def _pairs(spark, sf, metric="tanimoto"):
    return similarity_pairs(
        X.fingerprints(spark, sf), threshold=FORMULA[metric][1], id_col="vec_id", n_bits=64, metric=metric, alpha=0.9, beta=0.3
    )


def _register(metric: str):
    formula, t = FORMULA[metric]

    @query(f"sg1_similarity_pairs_{metric}", X.sql(X.D_FP, D_DISTINCT, D_PAIR, body=f"""
select l as left_id, r as right_id, {d6(formula)} as similarity, lc as left_copies, rc as right_copies from ab where {formula}>={t}::double"""))
    def run(spark, sf):
        return rounded(_pairs(spark, sf, metric), "similarity")


for _m in FORMULA:
    _register(_m)


def _d_text_fp(table: str, key: str) -> str:
    h = "(('0x'||substr(md5(x),1,13))::bigint >> 42)%1024"
    return f"""{table}_c as (select {key} id, string_split(text,'') c from {table}),
{table}_b as (select id, list_distinct(list_transform(list_transform(range(1, len(c)-2), lambda i: c[i]||c[i+1]||c[i+2]||c[i+3]), lambda x: {h})) b from {table}_c)"""


D_TEXT = [
    _d_text_fp("documents", "doc_id"), _d_text_fp("benchmark", "item_id"),
    """sizes as (select q.id query_id, t.id target_id, len(q.b) a, len(t.b) b, len(list_intersect(q.b, t.b)) c from benchmark_b q cross join documents_b t)""",
    "sims as (select query_id, target_id, case when a+b-c=0 then 0 else c/(a+b-c)::double end s from sizes)",
]


def _text_fp(spark, sf, table, key):
    df = X.table(spark, sf, table).withColumnRenamed(key, "id")
    return tokens.qgram_fingerprint(df, ["id"], "text", 4, 1024)


@query("sg1_similarity_pairs_two_tables", X.sql(*D_TEXT, body=f"""
select left_id, right_id, {d6('s')} as similarity, left_copies, right_copies from (
 select min(query_id) left_id, min(target_id) right_id, any_value(s) s, count(distinct query_id) left_copies, count(distinct target_id) right_copies
 from sims join benchmark_b q on q.id=query_id join documents_b t on t.id=target_id where s>=0.35::double group by list_sort(q.b), list_sort(t.b))"""))
def similarity_pairs_two_tables(spark, sf):
    left, right = _text_fp(spark, sf, "benchmark", "item_id"), _text_fp(spark, sf, "documents", "doc_id")
    return rounded(similarity_pairs(left, right, threshold=0.35, n_bits=1024), "similarity")


@query("sg2_similarity_summary", X.sql(*D_TEXT, body=f"""
select query_id, {d6('max(s)')} as best, {d6('min(s)')} as worst, {d6('max(s)-min(s)')} as spread from sims group by 1"""))
def similarity_summary(spark, sf):
    out = similarity.similarity_summary(_text_fp(spark, sf, "benchmark", "item_id"), _text_fp(spark, sf, "documents", "doc_id"))
    return rounded(out, "best", "worst", "spread")


@query("sg3_nearest", X.sql(*D_TEXT, body=f"""
select query_id, rank::int as rank, target_id, {d6('s')} as similarity from (
 select *, row_number() over (partition by query_id order by s desc, target_id) as rank from sims) where rank<=5"""))
def nearest(spark, sf):
    out = similarity.nearest(_text_fp(spark, sf, "benchmark", "item_id"), _text_fp(spark, sf, "documents", "doc_id"), 5)
    return rounded(out, "similarity")


def d_greedy(edges: str) -> str:
    """Edges ``(a, b, copy, cost)`` taken in the order (cost, hash, a, b, copy)."""
    h = X.d_hash("a::varchar||':'||b::varchar||':'||copy::varchar")
    return f"""eo as (select *, row_number() over (order by cost, {h}, a, b, copy) i from {edges}),
gr as (select 0::bigint i, []::bigint[] ua, []::varchar[] ub, false ok, -1::bigint a, -1::bigint b, 0 copy, 0::double cost union all
 select e.i, case when f then list_append(ua, e.a) else ua end, case when f then list_append(ub, e.bk) else ub end, f, e.a, e.b, e.copy, e.cost from (
 select e.*, g.ua, g.ub, not list_contains(g.ua, e.a) and not list_contains(g.ub, e.bk) f from gr g join
 (select i, a::bigint a, b::bigint b, copy::int copy, cost, b::varchar||'/'||copy::varchar bk from eo) e on e.i=g.i+1) e)"""


@query("sg4_one_to_one_match", X.sql(
    X.D_FP, D_DISTINCT, D_PAIR, "e as (select l a, r b, 1 as copy, 1-c/(an+bn-c)::double cost from ab where c/(an+bn-c)::double>=0.5::double)",
    d_greedy("e"), recursive=True, body=f"select a, b, copy, {d6('cost')} as cost from gr where ok"))
def one_to_one_match(spark, sf):
    return rounded(matching.one_to_one_match(matching.match_edges(_pairs(spark, sf))), "cost")


@query("sg4_unmatched", X.sql(
    X.D_FP, D_DISTINCT, D_PAIR, "e as (select l a, r b, 1 as copy, 1-c/(an+bn-c)::double cost from ab where c/(an+bn-c)::double>=0.5::double)",
    d_greedy("e"), recursive=True, body="""
select 'a' as side, l as id from (select distinct l from ab) where l not in (select a from gr where ok) union all
select 'b', r from (select distinct r from ab) where r not in (select b from gr where ok)"""))
def unmatched(spark, sf):
    vectors = similarity.distinct_vectors(X.fingerprints(spark, sf), "vec_id", "words").select("id")
    top, low = vectors.agg(F.max("id")).first()[0], vectors.agg(F.min("id")).first()[0]
    matches = one_to_one_match(spark, sf)
    sides = {"a": vectors.filter(F.col("id") < top), "b": vectors.filter(F.col("id") > low)}
    return X.stack_rows([matching.unmatched(n, matches, s).withColumn("side", F.lit(s)) for s, n in sides.items()])


def d_rounds(cost: str, where: str) -> list[str]:
    """All pairs of distinct vectors of the even and the odd rows, taken in the
    order (cost, hash, ids) as often as both have rows: rounds of pairs that are
    first on both sides, as CTEs that end in ``flow(u, v, cost, fu, fv, m)``, and
    the rows of each vector in hash order, ``ra(u, a, i)`` and ``rb(v, b, j)``."""
    sides = []
    for t, odd, n, who, r in (("na", 0, "u", "a", "i"), ("nb", 1, "v", "b", "j")):
        key = "vec_id::varchar" if n == "u" else "vec_id::varchar||':1'"
        sides.append(f"""{t} as (select *, {X.d_hash(f"{n}::varchar")} h from (select w0, w1, min(vec_id) {n}, count(*)::bigint c from fp where vec_id%2={odd} group by w0, w1)),
r{who} as (select {n}, vec_id {who}, row_number() over (partition by {n} order by {X.d_hash(key)}, vec_id)-1 {r} from fp join {t} using (w0, w1) where vec_id%2={odd})""")
    sim = "(bit_count(na.w0&nb.w0)+bit_count(na.w1&nb.w1))/(bit_count(na.w0|nb.w0)+bit_count(na.w1|nb.w1))::double"
    mine = "row_number() over (partition by {0} order by cost, h, u, v)=1"
    return [
        *sides,
        f"eg as (select u, v, {cost.format(sim)} cost, xor(na.h, nb.h) h, na.c cu, nb.c cv from na, nb)",
        f"""rec as (select 0 round, *, 0::bigint m from eg where {where} union all
 select round+1, u, v, cost, h, cu-uu, cv-uv, n from (select *, sum(n) over (partition by u)::bigint uu, sum(n) over (partition by v)::bigint uv from (
 select *, case when {mine.format("u")} and {mine.format("v")} then least(cu, cv) else 0 end n from rec where m=0)) where n>0 or (cu>uu and cv>uv))""",
        """flow as (select u, v, cost, m, coalesce(sum(m) over (partition by u order by cost, h, v rows between unbounded preceding and 1 preceding), 0) fu,
 coalesce(sum(m) over (partition by v order by cost, h, u rows between unbounded preceding and 1 preceding), 0) fv from rec where m>0)""",
        "unit as (select u, v, cost, fu+x i, fv+x j from (select *, unnest(range(m)) x from flow))",
        "done as (select a, b, cost from unit join ra using (u, i) join rb using (v, j))",
    ]


def d_by_rank(table: str, node: str, key: str, taken: str) -> str:
    return f"(select {node}, row_number() over (order by {X.d_hash(key)}, {node}) r from {table} where {node} not in (select {node} from {taken}))"


def _halves(spark, sf):
    fp = X.fingerprints(spark, sf).withColumnRenamed("vec_id", "id")
    return fp.filter("id%2=0"), fp.filter("id%2=1")


@query("sg4_match_table", X.sql(X.D_FP, *d_rounds("1-{}", "cost<1"), recursive=True, body=f"""
select a, b, 1 as copy, {d6('cost')} as cost from done union all
select a, b, 1, 1::double from {d_by_rank("ra", "a", "a::varchar", "done")} join {d_by_rank("rb", "b", "b::varchar||':1'", "done")} using (r)"""))
def match_table(spark, sf):
    """Every embedding of an even id with one of an odd id, as alike as can be had."""
    return rounded(matching.match_tables(*_halves(spark, sf)), "cost")


@query("sg4_inverse_match", X.sql(X.D_FP, *d_rounds("{}", "true"), recursive=True, body=f"""
select a, b, 1 as copy, {d6('cost')} as cost from done"""))
def inverse_match(spark, sf):
    """The same rows with the least alike partners."""
    return rounded(matching.match_tables(*_halves(spark, sf), inverse=True), "cost")


def _blocks(spark, sf, col, held):
    """Vectors of the blocks of one side: the embedding with the block's id."""
    lib = X.train(spark, sf) if not held else X.lib(spark, sf).filter("bb1 >= 18")
    blocks = lib.select(F.col(col).cast("bigint").alias("id")).distinct()
    fp = X.fingerprints(spark, sf).withColumnRenamed("vec_id", "id")
    return blocks.join(fp, "id")


_SG5 = []
for _n, _c, _lo in (("m1", "bb1", ""), ("m2", "bb2", "2")):
    _SG5.append(f"""tr{_n} as (select distinct fp.* from train join fp on vec_id={_c}),
te{_n} as (select distinct fp.* from lib join fp on vec_id={_c} where bb1>=18),
ed{_n} as (select a.vec_id a, b.vec_id b, copy, 1-(bit_count(a.w0&b.w0)+bit_count(a.w1&b.w1))/(bit_count(a.w0)+bit_count(a.w1)+bit_count(b.w0)+bit_count(b.w1)-bit_count(a.w0&b.w0)-bit_count(a.w1&b.w1))::double cost
 from tr{_n} a cross join te{_n} b cross join (select 1 as copy) where cost<1),
""" + d_greedy(f"ed{_n}").replace("eo as", f"eo{_n} as").replace("from eo)", f"from eo{_n})").replace("gr as", f"gr{_n} as").replace("from gr g", f"from gr{_n} g")
 + f""", up{_n} as (select a from gr{_n} where ok union all select a from
 (select vec_id a, row_number() over (order by {X.d_hash("vec_id::varchar")}, vec_id) r from tr{_n} where vec_id not in (select a from gr{_n} where ok)) join
 (select vec_id b, row_number() over (order by {X.d_hash("vec_id::varchar||':1'")}, vec_id) r from te{_n} where vec_id not in (select b from gr{_n} where ok)) using (r))""")


@query("sg5_validation_from_matches", X.sql(
    X.D_LIB, X.D_TRAIN, X.D_FP, *_SG5,
    """s as (select * from train where bb1 in (select a from upm1) and bb2 in (select a from upm2) and bb3 in (select a from upm2))""",
    recursive=True, body=X.union_all([
        f"select '{t}' as target, sum({e})::bigint as positives, {d6(f'sum({e})*100/({n}*count(*))::double')} as pct from s"
        for t, e, n in (("BRD4", "BRD4", 1), ("HSA", "HSA", 1), ("sEH", "sEH", 1), ("micro", "BRD4+HSA+sEH", 3))])))
def validation_from_matches(spark, sf):
    kept = []
    for col in ("bb1", "bb2"):
        seen, held = _blocks(spark, sf, col, False), _blocks(spark, sf, col, True)
        # a pair of 64-bit vectors with a common bit has at least 1/64
        pairs = matching.member_pairs(similarity_pairs(seen, held, threshold=0.01, n_bits=64), seen, held)
        kept.append(matching.match_everyone(matching.match_edges(pairs), seen, held).select("a"))
    return rounded(matching.validation_from_matches(X.train(spark, sf), *kept), "pct")


_D_CLUSTER = [
    X.D_FP, "s as (select a.vec_id a, b.vec_id b from fp a join fp b on a.vec_id<>b.vec_id where (bit_count(a.w0&b.w0)+bit_count(a.w1&b.w1))"
    "/(bit_count(a.w0|b.w0)+bit_count(a.w1|b.w1))::double>=0.5::double)",
    "pr as (select vec_id, coalesce(n,0) n, coalesce(nb, []::bigint[]) nb, row_number() over (order by coalesce(n,0) desc, vec_id desc) i from fp left join (select a, count(*) n, list(b) nb from s group by 1) on a=vec_id)",
    """ce as (select 0::bigint i, []::bigint[] cs union all select p.i, case when list_has_any(p.nb, cs) then cs else list_append(cs, p.vec_id) end
 from ce join pr p on p.i=ce.i+1)""",
    "fin as (select unnest(cs) c from ce where i=(select max(i) from ce))",
]


@query("sg6_threshold_clusters", X.sql(*_D_CLUSTER, recursive=True, body="""
select vec_id, case when vec_id in (select c from fin) then vec_id else
 (select arg_min(p2.vec_id, p2.i) from s join fin on s.b=fin.c join pr p2 on p2.vec_id=fin.c where s.a=pr.vec_id) end as cluster,
 vec_id in (select c from fin) as is_centroid from pr"""))
def threshold_clusters(spark, sf):
    return matching.threshold_clusters(X.fingerprints(spark, sf), 0.5, "vec_id", n_bits=64)


_D_SIM7 = "(bit_count(x.w0&i.w0)+bit_count(x.w1&i.w1))/(bit_count(x.w0)+bit_count(x.w1)+bit_count(i.w0)+bit_count(i.w1)-bit_count(x.w0&i.w0)-bit_count(x.w1&i.w1))::double"


@query("sg7_diverse_pick", X.sql(
    *_D_CLUSTER, """cl as (select vec_id, case when vec_id in (select c from fin) then vec_id else
 (select arg_min(p2.vec_id, p2.i) from s join fin on s.b=fin.c join pr p2 on p2.vec_id=fin.c where s.a=pr.vec_id) end as cluster from pr)""",
    "it as (select cluster, vec_id, w0, w1, greatest(1, count(*) over (partition by cluster)//10) want from cl join fp using (vec_id))",
    f"""pk as (select cluster, 1 pick, vec_id id, want, [vec_id] ids, [{{'w0': w0, 'w1': w1}}] ws from it where vec_id=cluster union all
 select cluster, pick+1, vec_id, want, list_append(ids, vec_id), list_append(ws, {{'w0': w0, 'w1': w1}}) from (
 select p.cluster, p.pick, p.want, p.ids, p.ws, i.vec_id, i.w0, i.w1, row_number() over (partition by p.cluster order by
 list_reduce(list_concat([0::double], list_transform(p.ws, lambda x: {_D_SIM7})), lambda a, y: a+1-y) desc, i.vec_id) rn
 from pk p join it i on i.cluster=p.cluster and not list_contains(p.ids, i.vec_id) where p.pick<p.want) where rn=1)""",
    recursive=True, body="select cluster, id, pick from pk"))
def diverse_pick(spark, sf):
    clusters = threshold_clusters(spark, sf)
    items = clusters.join(X.fingerprints(spark, sf), "vec_id")
    return matching.diverse_pick(items, F.greatest(F.lit(1), F.floor(F.col("size") / 10)), "vec_id")




@query("sg8_cooccurrence_edges", X.sql(X.D_LIB, body="""
select bb1 as src, bb2 as dst from lib union select bb1, bb3 from lib union select least(bb2,bb3), greatest(bb2,bb3) from lib"""))
def cooccurrence_edges(spark, sf):
    return graph.cooccurrence_edges(X.lib(spark, sf))


# orders around their customer, and customers in chains of ten: hubs and chains
# over whole keys, so that nodes, edges and components grow with the tables
D_CC = [
    """ed as (select 2*o_orderkey a, 2*o_custkey+1 b from orders union
 select 2*c_custkey+1, 2*c_custkey+3 from customer where c_custkey%10<>9)""",
    "un as (select a, b from ed union select b, a from ed)",
    "reach as (select distinct a node, a as root from un union select un.b, reach.root from reach join un on un.a=reach.node)",
    "cc as (select node, min(root) as root from reach group by 1)",
]


def _cc_edges(spark, sf):
    around = X.table(spark, sf, "orders").selectExpr("2*o_orderkey src", "2*o_custkey+1 dst")
    chain = X.table(spark, sf, "customer").filter("c_custkey%10<>9").selectExpr("2*c_custkey+1 src", "2*c_custkey+3 dst")
    return around.unionByName(chain).distinct()


@query("sg9_connected_components", X.sql(*D_CC, recursive=True, body="""
select node, dense_rank() over (order by root)-1 as component, count(*) over (partition by root) as size from cc"""))
def connected_components(spark, sf):
    return graph.connected_components(_cc_edges(spark, sf))


@query("sg10_component_coverage", X.sql(*D_CC, recursive=True, body=f"""
select component, n_blocks, n_rows, {d6('n_rows*100/(select count(*) from lineitem)::double')} as pct from (
 select component, max(size) as n_blocks, count(*) as n_rows from lineitem join
 (select node, dense_rank() over (order by root)-1 as component, count(*) over (partition by root) as size from cc) on node=2*l_orderkey group by 1)"""))
def component_coverage(spark, sf):
    rows = X.table(spark, sf, "lineitem").selectExpr("2*l_orderkey a")
    comps = graph.connected_components(_cc_edges(spark, sf))
    return rounded(graph.component_coverage(rows, comps, ["a"]), "pct")
