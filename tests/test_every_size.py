"""One answer on both sides of every size check, and checks that stay."""

import hashlib
import random
import shutil

import pytest
from pyspark.sql import functions as F

from combisieve.functions.hashing import hash_key
from combisieve.operators import features, joins, matching, predicates, reshape, sampling, similarity, skew, splits, tokens
from combisieve.session import scratch_path
from combisieve.sources import assay, meta
from combisieve.streaming import counters
from workload import q_similarity
from workload.base import ORACLES


def listed(df):
    return df.columns, sorted(map(str, df.collect()))


def both(monkeypatch, module, name, run):
    """Results of the small and the large path."""
    small = listed(run())
    with monkeypatch.context() as m:
        m.setattr(module, name, 0 if name.startswith("INLINE") else lambda *_, **__: False)
        return small, listed(run())


SEQUENCES = [(1, ["a", "b", None]), (1, ["b", "b"]), (1, ["b", "b"]), (2, None), (3, []), (None, ["z"]), (2, [])]


def test_lookups(spark, monkeypatch):
    df = spark.createDataFrame(SEQUENCES, "id int, tokens array<string>")
    vocab = spark.createDataFrame([("a", 5), ("b", 6), ("b", 9), (None, 7)], "token string, id bigint")
    small, large = both(monkeypatch, tokens, "INLINE_TOKENS", lambda: tokens.encode(df, vocab, ["id"]))
    assert small == large and len(small[1]) == len(SEQUENCES)
    assert "Row(id=1, input_ids=[5, 6, 1])" in small[1] and "Row(id=2, input_ids=None)" in small[1]
    none = vocab.filter("false")
    assert listed(tokens.encode(df, none, ["id"]))[1].count("Row(id=1, input_ids=[1, 1])") == 2


def test_unseen(spark, monkeypatch):
    df = spark.createDataFrame(SEQUENCES, "id int, tokens array<string>")
    unseen = spark.createDataFrame([("a",), ("z",), (None,)], "token string")
    small, large = both(monkeypatch, tokens, "INLINE_TOKENS", lambda: tokens.rows_with_unseen(df, unseen, ["id"]))
    assert small == large and sum("True" in r for r in small[1]) == 2 and len(small[1]) == len(SEQUENCES)


@pytest.mark.parametrize("mode", ["all", "any", "none"])
def test_sets(spark, monkeypatch, mode):
    df = spark.createDataFrame([(1, "x", 7), (1, None, 7), (2, "y", None), (2, "y", None), (None, None, None)], "id int, s string, n int")
    members = {"s": spark.createDataFrame([("x",), (None,), ("x",)], "v string"), "n": spark.createDataFrame([(7,), (None,)], "v int")}
    small, large = both(monkeypatch, predicates, "INLINE_VALUES", lambda: predicates.filter_in_set(df, members, mode))
    assert small == large and len(small[1]) == {"all": 1, "any": 2, "none": 3}[mode]


def test_groups(spark, monkeypatch):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, None), (None, None)], "a int, b int")
    groups = spark.createDataFrame([(0, 1), (4, 2), (2, 1), (9, None)], "group_id int, member int").filter("member is not null")
    small, large = both(monkeypatch, predicates, "INLINE_VALUES", lambda: predicates.assign_group(df, groups, ["a", "b"]))
    assert small == large and sum("mol_group=4" in r for r in small[1]) == 2


@pytest.mark.parametrize("inside", [True, False])
def test_key_lists(spark, monkeypatch, inside):
    df = spark.createDataFrame([(1, 5), (2, 5), (2, None), (3, 6)], "v int, k int")
    keys = spark.createDataFrame([(5,), (5,), (None,)], "k int")
    small, large = both(monkeypatch, joins, "fits", lambda: joins.keep_keys(df, keys, ["k"], inside))
    assert small == large and small[0] == ["v", "k"] and len(small[1]) == 2


def test_broadcasts_are_bounded_in_bytes(spark):
    wide = spark.range(2000).select(F.repeat(F.lit("x"), 50_000).alias("t"))
    assert skew.fits(spark.range(2000)) and not skew.fits(wide) and not skew.fits(spark.range(2000), 1999)


def test_hot_keys_follow_the_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        # a key with 1/65 of the rows is hot with 211 partitions
        df = spark.range(6500).select("id", F.when(F.col("id") < 100, -1).otherwise(F.col("id")).alias("k"))
        sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        out = skew.attach_totals(df, sizes, ["k"], "n", ["id"])
        assert skew.hot_parts(spark) == 211 and out.filter("k = -1 and n = 100").count() == 100
        assert out.count() == 6500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_light_weights_can_be_drawn(spark):
    df = spark.createDataFrame([(1, 1 / 3000**2), (2, 1 / 2000**2), (3, 0.0), (4, None), (5, 1e-300)], "id bigint, w double")
    got = {r["id"]: r["n"] for r in sampling.weighted_sample(df, "id", "w", 2000).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) <= {1, 2, 5} and 500 < got[1] < 720 and sum(got.values()) == 2000
    heavy = spark.createDataFrame([(1, 1e30), (2, 3e30)], "id bigint, w double")
    assert sampling.weighted_sample(heavy, "id", "w", 100).filter("id = 2").count() > 60
    with pytest.raises(ValueError):
        sampling.weighted_sample(df.filter("id = 3"), "id", "w", 5)


def fails(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def test_checks_are_not_pruned(spark):
    left = spark.createDataFrame([(0, "a"), (1, "b")], "index int, x string")
    for bad in ([(0, "p")], [(0, "p"), (1, "q"), (1, "r")], [(0, "p"), (1, "q"), (2, "r")]):
        right = spark.createDataFrame(bad, "index int, y string")
        for cols in (["x"], ["y"], ["index"]):
            fails(reshape.attach_by_index(left, right).select(*cols), "same index values")
        fails(features.concat_features([(left.withColumn("f", F.array("x")), "f"), (right.withColumn("g", F.array("y")), "g")], "index", None).select("index"), "same index values")
    good = spark.createDataFrame([(1, "q"), (0, "p")], "index int, y string")
    assert sorted(map(tuple, reshape.attach_by_index(left, good).collect())) == [(0, "a", "p"), (1, "b", "q")]
    repeated = spark.createDataFrame([(0, "p"), (0, "q")], "index int, y string")
    fails(joins.left_join_m1(left, repeated, ["index"]).select("x"), "repeats")
    path = scratch_path(spark, "assay")
    assay.write_assay(spark.createDataFrame([(2, "a", "b", "c", "m", "XYZ", 1)], "id bigint, bb1 string, bb2 string, bb3 string, molecule string, protein string, binds int"), path)
    fails(assay.read_assay(spark, path).select("id"), "outside the declared names")


def test_lists_over_many_lines(spark, monkeypatch):
    monkeypatch.setattr(meta, "LINE_ITEMS", 7)
    rows = spark.range(40).select(F.lit("a").alias("name"), F.col("id").cast("int").alias("position"), (F.col("id") * 3).alias("value"))
    path = scratch_path(spark, "meta")
    meta.write_meta(rows, path)
    assert spark.read.json(path).count() == 6
    assert listed(meta.read_meta(spark, path)) == listed(rows)


def test_a_stopped_stream_resumes(spark):
    source, out = scratch_path(spark, "source"), scratch_path(spark, "out")
    rows = spark.createDataFrame([(["a", "b"],), (["b"],)], "tokens array<string>")
    for times in (1, 2):
        rows.write.mode("append").parquet(source)
        stream = counters.read_arriving(spark, source, rows.schema)
        counters.run_counter(counters.stream_token_counts(stream, "tokens"), out).awaitTermination()
        got = {r["token"]: r["n"] for r in counters.latest_counts(spark, out, ["token"]).collect()}
        assert got == {"a": times, "b": 2 * times}


def test_odd_bit_lengths(spark):
    df = spark.createDataFrame([(1, [1] * 10), (2, [0, 1]), (3, [])], "id int, bits array<int>")
    got = {r["id"]: list(r["p"]) for r in df.select("id", features.pack_bits("bits").alias("p")).collect()}
    assert got == {1: [255, 192], 2: [64], 3: []}


def test_unknown_tokens_are_refused(spark):
    known = spark.createDataFrame([(1, [5, None]), (2, None), (3, []), (3, [])], "id int, input_ids array<bigint>")
    assert listed(tokens.assert_no_unk(known, unk=7)) == listed(known)
    bad = known.unionByName(spark.createDataFrame([(4, [5, 7])], known.schema))
    fails(tokens.assert_no_unk(bad, unk=7).select("id"), "unknown token")


def strata_folds(groups, k):
    """Groups by the label of which they hold the largest share, one after the
    other; groups per fold for each (label, rows of it, rows)."""
    text = lambda label: (label is not None, str(label))
    totals = {}
    for cells in groups.values():
        for label, n in cells.items():
            totals[label] = totals.get(label, 0) + n
    kind, strata = {}, {}
    for g, cells in groups.items():
        label = min(cells, key=lambda x: (-(cells[x] * splits.SHARE_SCALE // totals[x]), text(x)))
        kind[g] = (label, cells[label], sum(cells.values()))
        strata.setdefault(label, []).append(kind[g][1:])
    dealt = {}
    for label, members in strata.items():
        turn = int(hashlib.md5(f"42:{'' if label is None else label}".encode()).hexdigest()[:13], 16) % k
        loads, rows = [0] * k, [0] * k
        for own, size in sorted(members, reverse=True):
            f = min(range(k), key=lambda i: (loads[i], rows[i], i))
            loads[f], rows[f] = loads[f] + own, rows[f] + size
            dealt.setdefault((label, own, size), [0] * k)[(f + turn) % k] += 1
    return dealt, kind


@pytest.mark.parametrize(("n", "labels", "size"), [(400, 3, 40), (30_000, 2, 4), (24_000, 300, 4)])
def test_stratified_groups_of_any_number(spark, n, labels, size):
    rows = spark.range(n).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(0), F.xxhash64("id") % size)).alias("i"))
    rows = rows.filter("i >= 0").withColumn("label", F.pmod(F.xxhash64("g", F.col("i") * 7), F.lit(labels)))
    rows = rows.withColumns({"label": F.when(F.col("label") > 0, F.col("label")), "g": F.when(F.col("g") > 0, F.col("g"))})
    groups = {}
    for r in rows.groupBy("g", "label").count().collect():
        groups.setdefault(r["g"], {})[r["label"]] = r["count"]
    want, kind = strata_folds(groups, 5)
    got, folds = {}, splits.stratified_group_folds(rows, "g", "label", 5).collect()
    for r in folds:
        got.setdefault(kind[r["g"]], [0] * 5)[r["fold_idx"]] += 1
        assert r["group_size"] == sum(groups[r["g"]].values())
    assert got == want and len(folds) == len(groups)


def test_blocks_without_a_common_bit_are_matched(spark, sf, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    pick = random.Random(3)
    sparse = [(i, [1.0 if x in on else -1.0 for x in range(64)]) for i in range(200) for on in [[i % 23] if i < 25 else pick.sample(range(64), pick.choice((1, 1, 2, 3)))]]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", sparse)
    con.execute(f"copy embeddings to '{tmp_path}/embeddings.parquet'")
    # the smallest table has no held-out blocks
    shutil.copy(f"{sf.replace('sf0.001', 'sf0.01')}/lineitem.parquet", tmp_path)
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = con.execute(ORACLES["sg5_validation_from_matches"]).fetchall()
    got = q_similarity.validation_from_matches(spark, str(tmp_path)).select("target", "positives", "pct").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("copies", [1, 2])
def test_everyone_is_matched_in_order(spark, copies):
    pick = random.Random(4)
    left, right = ({i: 1 << pick.randrange(12) | 1 << pick.randrange(12) for i in range(lo, lo + n)} for lo, n in ((0, 25), (100, 25 // copies)))
    a, b = (spark.createDataFrame([(i, [w]) for i, w in side.items()], "id bigint, words array<bigint>") for side in (left, right))
    pairs = matching.member_pairs(similarity.similarity_pairs(a, b, threshold=0.01, n_bits=32), a, b)
    got = matching.match_everyone(matching.match_edges(pairs, copies=copies), a, b, copies).collect()
    edges = spark.createDataFrame(
        [(x, y, c, 1 - (v & w).bit_count() / (v | w).bit_count()) for x, v in left.items() for y, w in right.items() for c in range(1, copies + 1)],
        "a bigint, b bigint, copy int, cost double",
    )
    order = edges.filter("cost < 1").withColumn("h", hash_key("a", "b", "copy")).orderBy("cost", "h", "a", "b", "copy").collect()
    used, want = set(), []
    for e in order:
        if not {("a", e.a), (e.b, e.copy)} & used:
            used |= {("a", e.a), (e.b, e.copy)}
            want.append((e.a, e.b, e.copy, e.cost))
    ranked = [
        [tuple(r)[1:] for r in edges.select(*ids).distinct().select(hash_key(*ids).alias("h"), *ids).orderBy("h", *ids).collect()]
        for ids in (["a"], ["b", "copy"])
    ]
    free = [[x for x in ranked[0] if ("a", x[0]) not in used], [x for x in ranked[1] if x not in used]]
    want += [(*x, *y, 1.0) for x, y in zip(*free)]
    assert sorted(map(tuple, got)) == sorted(want) and any(e.cost == 1 for e in got)


def _taken(left, right, copies, inverse):
    """Vectors in the order (cost, hash, ids), as often as both have rows; rows
    in hash order: one after the other."""
    key = lambda *ids: int(hashlib.md5(":".join(["42", *map(str, ids)]).encode()).hexdigest()[:13], 16)
    sides = []
    for rows, n in ((left, 1), (right, copies)):
        groups = {}
        for i, w in rows:
            groups.setdefault(w, []).append(i)
        units = lambda ids: sorted([(i,) for i in ids] if n == 1 and rows is left else [(i, c) for i in ids for c in range(1, n + 1)], key=lambda x: (key(*x), *x))
        sides.append({min(ids): (w, units(ids)) for w, ids in groups.items()})
    alike = lambda v, w: (v & w).bit_count() / (v | w).bit_count() if v and w else 0.0
    edges = []
    for u, (v, _) in sides[0].items():
        for x, (w, _) in sides[1].items():
            cost = alike(v, w) if inverse else 1 - alike(v, w)
            if inverse or cost < 1:
                edges.append((cost, key(u) ^ key(x), u, x))
    out = []
    for cost, _, u, x in sorted(edges):
        a, b = sides[0][u][1], sides[1][x][1]
        while a and b:
            out.append((*a.pop(0), *b.pop(0), cost))
    if not inverse:
        free = [sorted((y for _, ys in s.values() for y in ys), key=lambda x: (key(*x), *x)) for s in sides]
        out += [(*x, *y, 1.0) for x, y in zip(*free)]
    return sorted((a, b, c, round(cost, 9)) for a, b, c, cost in out)


@pytest.mark.parametrize(("copies", "inverse"), [(1, False), (3, False), (1, True)])
def test_tables_are_matched_in_order(spark, copies, inverse, monkeypatch):
    """Vectors with many rows, empty ones and such that share no bit."""
    monkeypatch.setattr(similarity, "GRID_ROWS", 8)
    pick = random.Random(7)
    word = lambda: sum(1 << b for b in pick.sample(range(16), pick.randrange(1, 4)))
    hub = word()
    left = [(i, hub if i % 3 == 0 else word()) for i in range(45)] + [(98, 0), (99, 0)]
    right = [(100 + i, hub ^ 1 if i % 4 == 0 else word()) for i in range(40 // copies)] + [(200, 0)]
    a, b = (spark.createDataFrame([(i, [w]) for i, w in rows] + [(-1, None)], "id bigint, words array<bigint>") for rows in (left, right))
    got = matching.match_tables(a, b, copies, inverse=inverse).collect()
    assert sorted((r.a, r.b, r.copy, round(r.cost, 9)) for r in got) == _taken(left, right, copies, inverse)
    if copies == 1 and not inverse:
        near = matching.match_tables(a, b, max_cost=0.5).collect()
        assert sorted((r.a, r.b, r.copy, round(r.cost, 9)) for r in near) == [x for x in _taken(left, right, 1, False) if x[3] <= 0.5]
        assert matching.match_tables(a.limit(0), b).count() == matching.match_tables(a, b.limit(0), inverse=True).count() == 0
