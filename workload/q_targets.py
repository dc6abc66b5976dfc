"""Targets, metrics, ensembles, streaming, batch functions and the flagship."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from combisieve import TARGETS
from combisieve.functions import batch
from combisieve.operators import ensemble, metrics, reshape, targets, tokens
from combisieve.plans import baseline
from combisieve.session import scratch_path
from combisieve.sources import tables
from combisieve.streaming import counters
from workload import fixtures as X
from workload.base import d6, query, r6, rounded
from workload.q_profile import _PROFILE as D_PROFILE
from workload.q_profile import _SMALL as D_SMALL
from workload.q_profile import _small as small_features
from workload.q_tokens import D_WORDS

HELD = {"bb1": X.HELD_BB1, "bb2": X.HELD_BB23, "bb3": X.HELD_BB23}

D_RATES = [
    "r1 as (select bb1, " + ", ".join(f"avg({t}) {t}" for t in TARGETS) + " from lib group by 1)",
    "r23 as (select b, " + ", ".join(f"avg({t}) {t}" for t in TARGETS)
    + " from (select bb2 b, BRD4, HSA, sEH from lib union all select bb3, BRD4, HSA, sEH from lib where bb3<>bb2) group by 1)",
]
_FORMS = {
    "product": "r1.{t}*r2.{t}*r3.{t}",
    "at_least_one": "1-(1-r1.{t})*(1-r2.{t})*(1-r3.{t})",
    "first_and_any": "r1.{t}*(1-(1-r2.{t})*(1-r3.{t}))",
    "first_times_sum": "r1.{t}*(r2.{t}+r3.{t})",
    "first_times_min": "r1.{t}*least(r2.{t},r3.{t})",
    "first_times_max": "r1.{t}*greatest(r2.{t},r3.{t})",
}
_JOIN = "from lib l join r1 on r1.bb1=l.bb1 join r23 r2 on r2.b=l.bb2 join r23 r3 on r3.b=l.bb3"


@query("tm1_rate_baseline", X.sql(X.D_LIB, *D_RATES, body="select mol_id, " + ", ".join(
    f"{d6(e.format(t=t))} as {n}_{t}" for n, e in _FORMS.items() for t in TARGETS) + f" {_JOIN}"))
def rate_baseline(spark, sf):
    lib = X.lib(spark, sf)
    out = targets.rate_baseline(lib, lib.select("mol_id", "bb1", "bb2", "bb3"), list(targets.FORMS)).drop("bb1", "bb2", "bb3")
    return rounded(out, *[c for c in out.columns if c != "mol_id"])


def _preds(spark, sf, model=1):
    return X.predictions(spark, sf, model)


PREDS = [X.D_LIB, X.d_predictions()]
PCOLS = [f"pred_{t}" for t in TARGETS]


@query("tm2_minmax_columns", X.sql(*PREDS, body="select mol_id, " + ", ".join(
    f"{d6(f'({c}-min({c}) over ())/(max({c}) over ()-min({c}) over ())')} as {c}" for c in PCOLS) + " from preds"))
def minmax_columns(spark, sf):
    return rounded(targets.minmax_columns(_preds(spark, sf).select("mol_id", *PCOLS), PCOLS), *PCOLS)


_CUT = X.union_all([f"select '{t}' as protein, target_{t} as label, quantile_disc(pred_{t},0.99) as cutoff from preds group by target_{t}" for t in TARGETS])


@query("tm3_class_cutoffs", X.sql(*PREDS, body=_CUT))
def class_cutoffs(spark, sf):
    return targets.class_cutoffs(_preds(spark, sf))


def _d_smooth(t: str) -> str:
    c0, c1 = (f"(select cutoff from cut where protein='{t}' and label={v})" for v in (0, 1))
    return f"""{d6(f"case when target_{t}=0 then 0.05::double+least(pred_{t},{c0})*(0.15::double/{c0}) else (1-0.05::double-0.15::double)+least(pred_{t},{c1})*(0.15::double/{c1}) end")} as smooth_{t}"""


@query("tm4_smooth_labels", X.sql(*PREDS, f"cut as ({_CUT})", body="select mol_id, " + ", ".join(_d_smooth(t) for t in TARGETS) + " from preds"))
def smooth_labels(spark, sf):
    preds = _preds(spark, sf)
    out = targets.smooth_labels(preds, targets.class_cutoffs(preds))
    return rounded(out.select("mol_id", *[f"smooth_{t}" for t in TARGETS]), *[f"smooth_{t}" for t in TARGETS])


def d_long(rel: str, extra: str = "", subset: str = "subset") -> str:
    return X.union_all([
        f"select {extra}{subset} as subset, '{t}' protein, pred_{t} score, (target_{t}>0.5)::int target from {rel}" for t in TARGETS
    ])


PARTS = "parts as (select * from (values ('nonshare',0),('share',null),('share1',1),('share2',2),('share2',3)) p(part,subset))"


def d_ap(rel: str, keys: str) -> str:
    """CTEs ending in ``ap`` from ``rel(keys, score, target)``."""
    return f"""sc as (select {keys}, score, count(*) n, sum(target) pos from {rel} group by all),
cu as (select *, sum(n) over w cn, sum(pos) over w cp from sc window w as (partition by {keys} order by score desc)),
ap as (select {keys}, sum(n)::bigint n, sum(pos)::bigint positives, case when sum(pos)>0 then sum(pos*(cp/cn::double))/sum(pos) end ap from cu group by {keys})"""


AP = [*PREDS, f"ln as ({d_long('preds')})", PARTS, "nm as (select part, protein, score, target from ln join parts p on case when part='share' then ln.subset is distinct from 0 else ln.subset=p.subset end)", d_ap("nm", "part, protein")]


@query("tm5_average_precision", X.sql(*AP, body=f"select part, protein, n, positives, {d6('ap')} as ap from ap"))
def average_precision(spark, sf):
    return rounded(metrics.average_precision(_preds(spark, sf)), "ap")


_ROLL = "roll as (select * from (values " + ", ".join(f"('{m}','{p}')" for m, ps in metrics.ROLLUPS.items() for p in ps) + ") r(metric,part))"


@query("tm6_metric_rollup", X.sql(*AP, _ROLL, body=f"select metric, {d6('avg(ap)')} as value from ap join roll using (part) group by metric"))
def metric_rollup(spark, sf):
    return rounded(metrics.metric_rollup(metrics.average_precision(_preds(spark, sf))), "value")


@query("tm7_micro_average_precision", X.sql(*PREDS, f"ln as ({d_long('preds')})", """
nm as (select 'all' as part, score, target from ln union all select case when subset=0 then 'nonshare' else 'share' end, score, target from ln)""",
    d_ap("nm", "part"), body=f"select part, n, positives, {d6('ap')} as ap from ap"))
def micro_average_precision(spark, sf):
    return rounded(metrics.micro_average_precision(_preds(spark, sf)), "ap")


def _d_loss(pw: float, s: float, t: float | None = None) -> str:
    cut, terms = t, []
    for t in TARGETS:
        x, y = f"(pred_{t}*4-2)", f"target_{t}"
        if s:
            y = f"(case when target_{t}>0.5 then {1 - s / 2}::double else {s / 2}::double end)"
        if cut is not None:
            y = f"(case when {y}>{cut} then 1 else 0 end)"
        terms.append(f"((1-{y})*{x}+(1+{pw - 1}::double*{y})*(ln(1+exp(-abs({x})))+greatest(-{x},0)))")
    return "+".join(terms)


_LOSSES = {
    "plain": (1.0, 0.0, "mean", None), "weighted": (3.0, 0.0, "batch_mean", None), "smooth": (1.0, 0.1, "sum", None),
    "hard": (2.0, 0.1, "mean", 0.5), "all_on": (1.0, 0.1, "mean", 0.01),
}
_DIV = {"mean": "/(3*count(*))", "batch_mean": "/count(*)", "sum": ""}


@query("tm8_log_loss", X.sql(*PREDS, body=X.union_all([
    f"select '{n}' as kind, {d6(f'sum({_d_loss(pw, s, t)}){_DIV[r]}')} as loss from preds" for n, (pw, s, r, t) in _LOSSES.items()])))
def log_loss(spark, sf):
    logits = _preds(spark, sf).withColumns({c: F.col(c) * 4 - 2 for c in PCOLS})
    return rounded(X.stack_rows([
        metrics.log_loss(logits, pos_weight=pw, smoothing=s, reduction=r, target_threshold=t).withColumn("kind", F.lit(n))
        for n, (pw, s, r, t) in _LOSSES.items()
    ]), "loss")


_BAD = "(mol_id%997=0)"


@query("tm9_clean_predictions", X.sql(*PREDS, body="select mol_id, " + f"{_BAD}::int as had_nan, " + ", ".join(
    f"case when {_BAD} then 0 else {c} end as {c}" for c in PCOLS) + " from preds"))
def clean_predictions(spark, sf):
    nan = F.when(F.col("mol_id") % 997 == 0, F.lit(float("nan"))).otherwise(F.col("pred_HSA"))
    out = metrics.clean_predictions(_preds(spark, sf).withColumn("pred_HSA", nan), PCOLS)
    return out.select("mol_id", "had_nan", *PCOLS)


@query("tm9_ordered_predictions", X.sql(*PREDS, body=f"select mol_id, row_number() over (order by mol_id)-1 as position, {_BAD}::int as had_nan, sum({_BAD}::int) over ()::bigint as n_nan from preds"))
def ordered_predictions(spark, sf):
    nan = F.when(F.col("mol_id") % 997 == 0, F.lit(float("nan"))).otherwise(F.col("pred_HSA"))
    out, counts = metrics.ordered_predictions(_preds(spark, sf).withColumn("pred_HSA", nan), PCOLS, "mol_id")
    return out.select("mol_id", "position", "had_nan", counts.select("n_nan").scalar().alias("n_nan"))


@query("tm10_staged_scores", X.sql(X.D_LIB, *[X.d_predictions(m, f"p{m}") for m in (1, 2, 3, 4)],
    "ln as (" + X.union_all([d_long(f"p{m}", f"{(m - 1) * 500} as step, ") for m in (1, 2, 3, 4)]) + ")", PARTS,
    "nm as (select step, part, protein, score, target from ln join parts p on case when part='share' then ln.subset is distinct from 0 else ln.subset=p.subset end)", d_ap("nm", "step, part, protein"), _ROLL,
    body=f"select step, metric, {d6('avg(ap)')} as value from ap join roll using (part) group by step, metric"))
def staged_scores(spark, sf):
    steps = X.stack_rows([_preds(spark, sf, m).withColumn("step", F.lit((m - 1) * 500)) for m in (1, 2, 3, 4)])
    return rounded(metrics.metric_rollup(metrics.average_precision(steps, ["step"]), ["step"]), "value")


def _long_models(spark, sf, models=(1, 2, 3, 4)):
    return X.stack_rows([
        reshape.wide_to_long(_preds(spark, sf, m).select("mol_id", *PCOLS), {"binds": "pred_"}, drop_zero=None).withColumn("model", F.lit(m))
        for m in models
    ])


_MODELS = [X.D_LIB, *[X.d_predictions(m, f"p{m}") for m in (1, 2, 3, 4)], "ml as (" + X.union_all([
    f"select {m} as model, mol_id, '{t}' protein, pred_{t} binds from p{m}" for m in (1, 2, 3, 4) for t in TARGETS]) + ")"]


@query("tm11_mean_ensemble", X.sql(*_MODELS, body=f"select mol_id, protein, {d6('avg(binds)')} as binds from ml group by all"))
def mean_ensemble(spark, sf):
    return rounded(ensemble.mean_ensemble(_long_models(spark, sf), ["mol_id", "protein"]), "binds")


_WEIGHTS = [(m, s, w) for s, ws in ((0, (1.0, 0.5, 0.2, 3.0)), (1, (1.0, 1.0, 0.0, 0.8))) for m, w in zip((1, 2, 3, 4), ws)]


@query("tm12_weighted_ensemble", X.sql(*_MODELS, "w as (select * from (values " + ", ".join(f"({m},{s},{w}::double)" for m, s, w in _WEIGHTS)
    + ") t(model,segment,weight))", body=f"""
select mol_id*3+case protein when 'BRD4' then 0 when 'HSA' then 1 else 2 end as id, segment, {d6('sum(weight*binds)/sum(weight)')} as binds
 from (select *, case when mol_id%4=0 then 0 else 1 end segment from ml) join w using (model, segment) group by all"""))
def weighted_ensemble(spark, sf):
    place = F.when(F.col("protein") == "BRD4", 0).when(F.col("protein") == "HSA", 1).otherwise(2)
    preds = _long_models(spark, sf).select(
        "model", "binds", (F.col("mol_id") * 3 + place).alias("id"), F.when(F.col("mol_id") % 4 == 0, 0).otherwise(1).alias("segment")
    )
    weights = spark.createDataFrame(_WEIGHTS, "model int, segment int, weight double")
    return rounded(ensemble.weighted_ensemble(preds, weights), "binds")


@query("tm13_fill_missing_targets", X.sql(*PREDS, body="select mol_id, pred_BRD4, 0::double as pred_HSA, case when mol_id%7=0 then 0 else pred_sEH end as pred_sEH from preds"))
def fill_missing_targets(spark, sf):
    part = _preds(spark, sf).select("mol_id", "pred_BRD4", F.when(F.col("mol_id") % 7 != 0, F.col("pred_sEH")).alias("pred_sEH"))
    return ensemble.fill_missing_targets(part).select("mol_id", *PCOLS)


@query("tm14_mask_outside_subset", X.sql(X.D_LIB, X.D_WIDE, X.d_predictions(), body=X.union_all([
    f"select id_{t} as id, group_{t} as group_id, case when group_{t} between 6 and 8 then pred_{t} else 0 end as binds from wide join preds using (mol_id) where id_{t}<>0"
    for t in TARGETS])))
def mask_outside_subset(spark, sf):
    wide = X.test_wide(spark, sf).join(_preds(spark, sf), "mol_id")
    long = reshape.wide_to_long(wide, {"id": "id_", "binds": "pred_", "group_id": "group_"})
    return tables.mask_outside_subset(long, tables.SUBMISSION_GROUPS["public-nonshare"]).select("id", "group_id", "binds")


@query("tm15_compare_predictions", X.sql(X.D_LIB, X.d_predictions(1, "p1"), X.d_predictions(2, "p2"), body=X.union_all([
    f"select '{t}' as protein, count(*) as n, count(*) filter (p1.pred_{t}=p2.pred_{t}) as n_equal, 0::bigint as n_missing, {d6(f'max(abs(p1.pred_{t}-p2.pred_{t}))')} as max_diff from p1 join p2 using (mol_id)"
    for t in TARGETS])))
def compare_predictions(spark, sf):
    a, b = _preds(spark, sf, 1), _preds(spark, sf, 2)
    return rounded(X.stack_rows([
        ensemble.compare_predictions(a, b, ["mol_id"], f"pred_{t}").withColumn("protein", F.lit(t)) for t in TARGETS
    ]), "max_diff")


# --- streaming -----------------------------------------------------------------

@query("st1_stream_token_counts", X.sql(D_WORDS, body="select lang, token, count(*) as n from (select lang, unnest(tokens) token from words) group by all"))
def stream_token_counts(spark, sf):
    source, out = scratch_path(spark, "arriving"), scratch_path(spark, "counts")
    docs = X.table(spark, sf, "documents").select("doc_id", "lang", "text")
    docs.repartition(4, "doc_id").write.parquet(source)
    stream = counters.read_arriving(spark, source, docs.schema)
    counts = counters.stream_token_counts(stream, tokens.tokenize_words("text"), ["lang"])
    counters.run_counter(counts, out).awaitTermination()
    return counters.latest_counts(spark, out, ["lang", "token"])


@query("st1_compacted_token_counts", X.sql(D_WORDS, body="select lang, token, count(*) as n from (select lang, unnest(tokens) token from words) group by all"))
def compacted_token_counts(spark, sf):
    source, out = scratch_path(spark, "arriving"), scratch_path(spark, "counts")
    docs = X.table(spark, sf, "documents").select("doc_id", "lang", "text")
    docs.repartition(5, "doc_id").write.parquet(source)
    counts = counters.stream_token_counts(counters.read_arriving(spark, source, docs.schema), tokens.tokenize_words("text"), ["lang"])
    counters.run_counter(counts, out, compact_every=2, keys=["lang", "token"]).awaitTermination()
    return counters.latest_counts(spark, out, ["lang", "token"])


@query("st2_stream_column_profile", X.sql(D_SMALL, body=D_PROFILE))
def stream_column_profile(spark, sf):
    from combisieve.operators.profile import profile_from_values

    source, out = scratch_path(spark, "arriving"), scratch_path(spark, "profile")
    df = small_features(spark, sf)
    df.repartition(4, "vec_id").write.parquet(source)
    stream = counters.read_arriving(spark, source, df.schema)
    counters.run_counter(counters.stream_column_profile(stream, "features"), out).awaitTermination()
    return profile_from_values(counters.latest_counts(spark, out, ["col", "value"]))


# --- batch functions --------------------------------------------------------------

@query("ud1_extract_features", X.sql(X.D_LIB, body="select mol_id, " + ", ".join(
    f"(len(molecule)-len(replace(molecule,'{c}','')))::int as n_{c}" for c in "CNO") + ", (len(molecule)*2)::int as twice from lib"))
def extract_features(spark, sf):
    def double_length(out: np.ndarray) -> np.ndarray:
        return np.hstack([out[:, :3], out[:, 3:] * 2])

    # by value: the function may live in a module that workers do not have
    count = lambda texts: np.array([[t.count("C"), t.count("N"), t.count("O"), len(t)] for t in texts], dtype=float)
    out = batch.extract_features(X.lib(spark, sf), count, "molecule", ["mol_id"], batch_size=512, hook=double_length)
    names = ["n_C", "n_N", "n_O", "twice"]
    return out.select("mol_id", *[F.col("features")[i].cast("int").alias(n) for i, n in enumerate(names)])


@query("ud3_predict_batches", f"""
select vec_id, {d6('1/(1+exp(-list_sum(list_transform(range(0,64), lambda i: embedding[i+1]::double*(i%5-2)))))')} as p0,
 {d6('1/(1+exp(-list_sum(list_transform(range(0,64), lambda i: embedding[i+1]::double*(i%3-1)))))')} as p1 from embeddings""")
def predict_batches(spark, sf):
    def load():
        i = np.arange(64)
        w = np.stack([i % 5 - 2, i % 3 - 1], axis=1).astype(float)
        return lambda x: x.astype(float) @ w

    out = batch.predict_batches(X.table(spark, sf, "embeddings"), load, "embedding", ["vec_id"], sigmoid=True)
    return out.select("vec_id", *[r6(F.col("pred")[i]).alias(f"p{i}") for i in range(2)])


# --- flagship ------------------------------------------------------------------------

_SUBSET = "case when bb1 between 0 and 4 and bb2 between 100 and 119 and bb3 between 100 and 119 then 0 when bb1 between 0 and 4 or bb2 between 100 and 119 or bb3 between 100 and 119 then 1 else 2 end"


@query("flagship_baseline_report", X.sql(
    X.D_LIB, *D_RATES,
    f"preds as (select {_SUBSET.replace('bb', 'l.bb')} as subset, " + ", ".join(f"{_FORMS['product'].format(t=t)} pred_{t}, l.{t} target_{t}" for t in TARGETS) + f" {_JOIN})",
    f"ln as ({d_long('preds')})", PARTS, "nm as (select part, protein, score, target from ln join parts p on case when part='share' then ln.subset is distinct from 0 else ln.subset=p.subset end)", d_ap("nm", "part, protein"), _ROLL,
    body=f"""select part||'_'||protein||'_AP' as metric, {d6('ap')} as value from ap where ap is not null union all
select metric, {d6('avg(ap)')} from ap join roll using (part) where ap is not null group by metric"""))
def flagship(spark, sf):
    lib = X.lib(spark, sf).select("mol_id", "bb1", "bb2", "bb3", *TARGETS)
    return rounded(baseline.baseline_report(lib, baseline.held_out_subset(lib, HELD)), "value")
