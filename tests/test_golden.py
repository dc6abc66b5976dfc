"""Worked examples."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from combisieve.functions import batch
from combisieve.operators import (
    features, graph, joins, matching, metrics, ordering, predicates, profile, reshape, sampling, similarity, splits, targets, tokens,
)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_chunks_of_nineteen(spark):
    out = splits.ntile_chunks(spark.range(19), ["id"], 4)
    assert [r[1] for r in rows(out.groupBy("chunk").count())] == [5, 5, 5, 4]


def test_cyclic_windows(spark):
    chunks = spark.range(4).select(F.col("id").cast("int").alias("chunk"))
    for m, want in ((2, [[0, 1], [1, 2], [2, 3], [3, 0]]), (3, [[0, 1, 2], [1, 2, 3], [2, 3, 0], [3, 0, 1]])):
        out = rows(splits.cyclic_windows(chunks, "chunk", 4, m), "cell", "slot", "chunk")
        assert [[c for cell, _, c in out if cell == j] for j in range(4)] == want


def test_tokenizer(spark):
    df = spark.createDataFrame([("CCl[Dy]@@Br1",)], "s string")
    got = df.select(tokens.tokenize_longest("s")).first()[0]
    assert got == ["C", "Cl", "[Dy]", "@@", "Br", "1"]
    # part of the saved vocabulary
    vocab = spark.createDataFrame(
        [("C", 8), ("Cl", 14), ("[Dy]", 43), ("@@", 32), ("Br", 7), ("1", 34)], "token string, id bigint"
    )
    ids = tokens.encode(df.select("s", tokens.tokenize_longest("s").alias("tokens")), vocab, ["s"])
    assert ids.first()["input_ids"] == [8, 14, 43, 32, 7, 34]


def test_specials_inside_words(spark):
    df = spark.createDataFrame([("ab[MASK]cd  e\n[PAD]",)], "s string")
    assert df.select(tokens.tokenize_words("s")).first()[0] == ["ab", "[MASK]", "cd", "e", "[PAD]"]


def test_large_and_small_vocabularies_agree(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", "b", "a", "z"]), (2, []), (3, ["b"])], "id int, tokens array<string>")
    vocab = spark.createDataFrame([("a", 7), ("b", 8)], "token string, id bigint")
    small = rows(tokens.encode(df, vocab, ["id"]))
    monkeypatch.setattr(tokens, "INLINE_TOKENS", 0)
    assert rows(tokens.encode(df, vocab, ["id"])) == small == [(1, [7, 8, 7, 1]), (2, []), (3, [8])]


def test_group_kfold_loads():
    plan, loads = splits.largest_first_plan([(5, 1), (4, 1), (3, 2), (2, 1), (1, 1)], 2)
    assert loads == [9, 9]


@pytest.mark.parametrize("seed", range(5))
def test_histogram_plan_equals_sequential(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 12, 200).tolist() + [500]
    k = int(rng.integers(2, 8))
    loads = [0] * k
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    hist = [(s, sizes.count(s)) for s in set(sizes)]
    assert splits.largest_first_plan(hist, k)[1] == loads


def test_average_precision_with_ties(spark):
    data = [(0, 0.9, 1), (0, 0.8, 0), (0, 0.8, 1), (0, 0.1, 0)]
    df = spark.createDataFrame(data, "subset int, pred_HSA double, target_HSA int")
    ap = metrics.average_precision(df, targets=["HSA"]).filter("part = 'nonshare'").first()["ap"]
    assert round(ap, 6) == 0.833333


def test_average_precision_without_positives(spark):
    df = spark.createDataFrame([(0, 0.9, 0)], "subset int, pred_HSA double, target_HSA int")
    out = metrics.average_precision(df, targets=["HSA"])
    assert out.first()["ap"] is None
    assert metrics.metric_rollup(out).count() == 0


def test_label_smoothing(spark):
    df = spark.createDataFrame([(0.25, 0), (0.25, 1), (9.0, 1)], "x double, y int")
    got = df.select(targets.smooth_label(F.col("x"), F.col("y"), F.lit(0.5), F.lit(0.5))).collect()
    assert [round(r[0], 6) for r in got] == [0.125, 0.875, 0.95]


def test_block_rate_counts_a_row_once(spark):
    df = spark.createDataFrame([(7, 7, 1, 0, 0), (7, 8, 0, 0, 0)], "bb2 int, bb3 int, BRD4 int, HSA int, sEH int")
    got = {r["bb23"]: (r["n"], r["BRD4"]) for r in profile.positive_rate_union(df).collect()}
    assert got == {7: (2, 0.5), 8: (1, 0.0)}


def test_balanced_batches_raise_the_positives(spark):
    assert sampling.batch_counts(95, 0.05, 10, True) == (10, 10, 1)
    df = spark.range(101).select("id", (F.col("id") < 6).cast("int").alias("y"))
    plan = sampling.balanced_batches(df, ["id"], "y", 10, [0.05])
    per = plan.join(df, "id").groupBy("batch").agg(F.count(F.lit(1)), F.sum("y"), F.countDistinct("slot"))
    assert rows(per) == [(b, 10, 1, 10) for b in range(10)]
    negatives = plan.join(df, "id").filter("y = 0")
    assert negatives.count() == negatives.select("id").distinct().count() == 90


def test_balanced_batches_use_all_negatives(spark):
    df = spark.range(500).select("id", (F.col("id") % 25 == 0).cast("int").alias("y"))
    plan = sampling.balanced_batches(df, ["id"], "y", 16, [0.3, None]).join(df, "id")
    first = plan.filter("epoch = 0")
    shape = first.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.countDistinct("slot").alias("s"))
    assert shape.agg(F.min("n"), F.max("n"), F.min("s"), F.max("p") - F.min("p")).first()[:3] == (16, 16, 16)
    assert shape.agg(F.max("p") - F.min("p")).first()[0] <= 1
    assert first.filter("y = 0").select("id").distinct().count() == 480 == first.filter("y = 0").count()
    assert plan.filter("epoch = 1").select("id").distinct().count() == 500


def test_epoch_ratios():
    got = sampling.epoch_ratios(5, 95, 5, 3, 1, 0.25, 0.05, 0.02)
    assert got[:4] == pytest.approx([0.25, 0.15, 0.05, 0.02]) and got[4] is None


def test_batch_permutation_is_a_bijection():
    for n in (1, 2, 7, 10, 97, 360):
        step, shift = sampling.spread_step(n, 42, 3)
        assert sorted((b * step + shift) % n for b in range(n)) == list(range(n))


def test_pack_bits_like_numpy(spark):
    rng = np.random.default_rng(0)
    data = [(i, [int(x) for x in rng.integers(0, 2, n)]) for i, n in enumerate((0, 1, 7, 8, 13, 64))]
    df = spark.createDataFrame(data, "id int, bits array<int>")
    got = {r[0]: r[1] for r in df.select("id", features.pack_bits("bits")).collect()}
    for i, bits in data:
        assert got[i] == np.packbits(np.array(bits, dtype=np.uint8)).tolist()


def test_mask_rates(spark):
    df = spark.range(400).select("id", F.array_repeat(F.lit(20).cast("bigint"), 50).alias("input_ids"))
    out = tokens.mlm_mask(df, ["id"], 45)
    cells = out.select(F.explode(F.arrays_zip("input_ids", "labels")).alias("c")).select("c.*")
    picked = cells.filter("labels <> -1")
    assert abs(picked.count() / 20000 - 0.15) < 0.01
    assert abs(picked.filter("input_ids = 3").count() / picked.count() - 0.8) < 0.03
    assert cells.filter("labels = -1 and input_ids <> 20").count() == 0


def test_errors_are_raised(spark):
    left = spark.createDataFrame([(1, "a")], "k int, v string")
    dup = spark.createDataFrame([(1, 2), (1, 3)], "k int, w int")
    with pytest.raises(PySparkException):
        joins.left_join_m1(left, dup, ["k"]).collect()
    with pytest.raises(PySparkException):
        reshape.attach_by_index(left, dup.filter("w = 9"), "k").collect()
    dictionary = spark.createDataFrame([("b", 0)], "value string, id bigint")
    with pytest.raises(PySparkException):
        reshape.encode(left, dictionary, ["v"]).collect()
    with pytest.raises(PySparkException):
        left.select(tokens.pad_fixed(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")), 1)).collect()


def test_last_group_wins(spark):
    groups = spark.createDataFrame([(0, 1), (2, 5), (1, 5)], "group_id int, member int")
    df = spark.createDataFrame([(1, 9), (1, 5), (9, 9)], "a int, b int")
    assert [r["mol_group"] for r in predicates.assign_group(df, groups, ["a", "b"]).collect()] == [0, 2, -1]


def test_feature_function_by_name_and_hook(spark):
    batch.register_feature("lengths")(lambda texts: np.array([[len(t), t.count("C")] for t in texts], dtype=float))
    df = spark.createDataFrame([(1, "CCO"), (2, "N")], "id int, s string")
    out = batch.extract_features(df, "lengths", "s", ["id"], batch_size=1, hook=lambda a: a + 1)
    assert rows(out) == [(1, [4.0, 3.0]), (2, [2.0, 1.0])]


def test_global_rank_with_a_hot_stratum(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 7).alias("k"))
    out = ordering.hash_rank(df, ["id"], 1, ["k"])
    bad = out.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m"))
    assert bad.filter("n <> d or m <> n - 1").count() == 0


def test_row_index_of_strings(spark):
    df = spark.range(1000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("s"))
    got = [r["s"] for r in ordering.row_index(df, ["s"]).orderBy("index").collect()]
    assert got == sorted(got) and len(got) == 1000


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(60)] + [(500, 500)]
    df = spark.createDataFrame(edges, "src int, dst int")
    out = graph.connected_components(df)
    assert rows(out.select("component", "size").distinct()) == [(0, 41), (1, 61), (2, 1)]


def _vectors(spark, n=120, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**16, 12)
    words = [int(base[rng.integers(0, 12)]) ^ (1 << int(rng.integers(0, 16))) for _ in range(n)]
    words = [w or 1 for w in words]
    return words, spark.createDataFrame([(i, [w]) for i, w in enumerate(words)], "id bigint, words array<bigint>")


def _sim(a, b):
    return (a & b).bit_count() / (a | b).bit_count()


def test_similarity_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELL_ROWS", 5)  # force the grid of cells
    words, df = _vectors(spark)
    got = {(r["left_id"], r["right_id"]) for r in similarity.similarity_pairs(df, threshold=0.6, n_bits=16).collect()}
    first = {w: words.index(w) for w in words}
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and _sim(words[a], words[b]) >= 0.6}
    assert got == want and want


def test_nearest_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "GRID_ROWS", 30)
    words, df = _vectors(spark)
    got = {(r["query_id"], r["rank"]): r["target_id"] for r in similarity.nearest(df, df, 3, exclude_self=True).collect()}
    for q in range(len(words)):
        best = sorted((i for i in range(len(words)) if i != q), key=lambda i: (-_sim(words[q], words[i]), i))[:3]
        assert [got[q, r] for r in (1, 2, 3)] == best


def test_clusters_equal_sequential(spark):
    words, df = _vectors(spark)
    near = [[j for j in range(len(words)) if j != i and 1 - _sim(words[i], words[j]) <= 0.3] for i in range(len(words))]
    seen, want = set(), {}
    for i in sorted(range(len(words)), key=lambda i: (len(near[i]), i), reverse=True):
        if i not in seen:
            for j in [i, *near[i]]:
                if j not in seen:
                    want[j] = i
                    seen.add(j)
    got = {r["id"]: r["cluster"] for r in matching.threshold_clusters(df, 0.3, n_bits=16).collect()}
    assert got == want


def test_diverse_picks_equal_sequential(spark):
    words, df = _vectors(spark, 40)
    items = df.withColumn("cluster", (F.col("id") % 2)).withColumn("is_centroid", F.col("id") < 2)
    got = {}
    for r in matching.diverse_pick(items, F.lit(5)).orderBy("pick").collect():
        got.setdefault(r["cluster"], []).append(r["id"])
    for c in (0, 1):
        members = [i for i in range(40) if i % 2 == c]
        picked = [c]
        while len(picked) < 5:
            rest = [i for i in members if i not in picked]
            total = lambda i: sum(1 - _sim(words[i], words[p]) for p in picked)
            picked.append(max(rest, key=lambda i: (round(total(i), 9), -i)))
        assert got[c] == picked


def test_matching_is_one_to_one_and_maximal(spark):
    words, df = _vectors(spark, 60)
    edges = matching.match_edges(similarity.similarity_pairs(df, threshold=0.3, n_bits=16), copies=2)
    out = matching.one_to_one_match(edges, 0.7).collect()
    a, b = [r["a"] for r in out], [(r["b"], r["copy"]) for r in out]
    assert len(set(a)) == len(a) and len(set(b)) == len(b)
    left = [e for e in edges.collect() if e["cost"] <= 0.7 and e["a"] not in set(a) and (e["b"], e["copy"]) not in set(b)]
    assert not left
