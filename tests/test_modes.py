"""Modes of operators against plain Python."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from combisieve.functions.hashing import uniform
from combisieve.operators import features, metrics, sampling, tokens
from combisieve.session import scratch_path
from combisieve.streaming import counters

ODD = ["", None, "a", "abc", "abcd", "aaaaaa", "naïve 😀😀x\ny", "\n\n\n\n\n", "é" * 9]


def test_qgrams_and_words(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id int, text string")
    got = {r["id"]: r["g"] for r in df.select("id", tokens.qgrams("text", 4).alias("g")).collect()}
    for i, t in enumerate(ODD):
        assert got[i] == [(t or "")[k : k + 4] for k in range(len(t or "") - 3)]
    pick = random.Random(1)
    sets = [[], [0], [1023], [31, 32], list(range(1024)), *[pick.sample(range(1024), pick.randrange(1, 90)) for _ in range(20)]]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, bits array<bigint>")
    rows = df.select("id", tokens.bits_to_words(F.col("bits"), 1024).alias("w"), tokens.multi_hot("bits", 1000).alias("hot")).collect()
    for r in rows:
        own = set(sets[r["id"]])
        assert r["w"] == [sum(1 << b for b in range(32) if 32 * w + b in own) for w in range(32)]
        assert r["hot"] == [int(i in own) for i in range(1, 1000)]


def test_batches_of_several_sequences(spark):
    rows = [(1, 0, [1, 2, 3], [True, False, True], [0.5, 1.5, 2.5]), (2, 0, [9], [False], [1.0]), (3, 1, [], [], []), (4, 1, [7] * 9, [True] * 9, [2.0] * 9)]
    df = spark.createDataFrame(rows, "id int, batch int, ids array<bigint>, mask array<boolean>, x array<double>")
    pads = {"ids": 5, "mask": True, "x": -1.0}
    for padding, lengths in ((True, {0: 3, 1: 6}), (False, {0: 1, 1: 0})):
        got = {r["id"]: r for r in tokens.pad_batch(df, "batch", ["id"], pads, 6, padding=padding).collect()}
        for i, b, *seqs in rows:
            n = lengths[b]
            for (name, pad), s in zip(pads.items(), seqs):
                assert got[i][name] == (s + [pad] * n)[:n] if len(s) < n else got[i][name] == s[:n]


def test_projection(spark):
    pick = random.Random(2)
    bits = [[pick.randrange(2) for _ in range(24)] for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(bits)), "id int, bits array<int>").select("id", "bits", features.pack_bits("bits").alias("packed"))
    ranks = [(c, f, pick.randrange(5) / 4) for c in ("x", "y") for f in range(24)]
    importance = spark.createDataFrame(ranks, "cls string, feature int, importance double")
    out = features.project_top_features(df, "packed", importance, 7, "cls").collect()
    for c in ("x", "y"):
        best = [f for _, f in sorted((-v, f) for k, f, v in ranks if k == c)][:7]
        assert all(r[f"top_{c}"] == [r["bits"][f] for f in best] for r in out)
    assert {tuple(r["p"]) for r in df.limit(1).select(features.project_bits("packed", [400]).alias("p")).collect()} == {(0,)}


def test_poisson_draws(spark):
    weights = [0.0, -1.0, None, 0.3, 4.0, 16.0, 16.5, 90.0]
    df = spark.range(16_000).select("id", F.array(*[F.lit(w) for w in weights])[F.col("id") % 8].alias("w")).repartition(7)
    got = sampling.poisson_sample(df, ["id"], "w", 1.0)
    counts = {}
    for r in got.collect():
        counts.setdefault(weights[r["id"] % 8], {})[r["id"]] = r["n"]
    assert set(counts) == {0.3, 4.0, 16.0, 16.5, 90.0}
    for w, drawn in counts.items():
        ns = list(drawn.values()) + [0] * (2000 - len(drawn))
        mean = sum(ns) / 2000
        assert abs(mean - w) < 5 * math.sqrt(w / 2000) and 0.8 * w < sum((n - mean) ** 2 for n in ns) / 2000 < 1.2 * w
    # one row by hand
    number = {r["id"]: r["u"] for r in df.filter("w = 4.0").select("id", uniform("id", F.lit(0)).alias("u")).collect()}
    for i, u in list(number.items())[:200]:
        p = below = math.exp(-4.0)
        n = 0
        while below <= u:
            n += 1
            p *= 4.0 / n
            below += p
        assert counts[4.0].get(i, 0) == n
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_many_epochs_are_one_plan(spark):
    rows = spark.range(600).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    start = time.perf_counter()
    plan = sampling.balanced_batches(rows, ["id"], "y", 32, [0.2 + i / 1000 for i in range(199)] + [None])
    plan.explain()
    assert time.perf_counter() - start < 30
    got = plan.groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"), F.sum((F.col("id") % 10 == 0).cast("int")).alias("pos")).collect()
    assert len({r["epoch"] for r in got}) == 200
    assert all(r["n"] == r["slots"] <= 32 and (r["epoch"] == 199 or r["pos"] >= 1) for r in got)


def test_hard_targets_and_order(spark):
    df = spark.createDataFrame([(3, 0.2, 1.0), (1, float("nan"), 0.0), (2, -0.4, 1.0)], "idx int, pred_a double, target_a double")
    for smoothing, cut in ((0.1, 0.5), (0.1, 0.01), (0.0, 0.99)):
        want = []
        for _, x, y in [(3, 0.2, 1.0), (2, -0.4, 1.0)]:
            y = (1 - smoothing / 2 if y > 0.5 else smoothing / 2) if smoothing else y
            y = float(y > cut)
            want.append(math.log(1 + math.exp(-x)) if y else math.log(1 + math.exp(x)))
        got = metrics.log_loss(df.filter("idx > 1"), ["a"], smoothing=smoothing, target_threshold=cut).first()["loss"]
        assert got == pytest.approx(sum(want) / 2)
    out, counts = metrics.ordered_predictions(df, ["pred_a"], "idx")
    assert [(r["idx"], r["pred_a"], r["had_nan"]) for r in out.orderBy("position").collect()] == [(1, 0.0, 1), (2, -0.4, 0), (3, 0.2, 0)]
    assert tuple(counts.first()) == (3, 1)


def test_compaction_survives_a_failure_in_the_middle(spark, monkeypatch):
    source, out = scratch_path(spark, "in"), scratch_path(spark, "log")
    rows = spark.createDataFrame([(["a", "b"],), (["b"],)], "tokens array<string>")
    for _ in range(5):
        rows.coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = counters.read_arriving(spark, source, rows.schema)
        counters.run_counter(counters.stream_token_counts(stream, "tokens"), out, compact_every=2, keys=["token"]).awaitTermination()

    def got():
        return {r["token"]: r["n"] for r in counters.latest_counts(spark, out, ["token"]).collect()}

    whole, tried = counters._switch, []

    def broken(*args):
        tried.append(args[2])
        if len(tried) == 2:
            raise OSError("lost in the middle")
        whole(*args)

    monkeypatch.setattr(counters, "_switch", broken)
    with pytest.raises(Exception, match="lost in the middle"):
        go()
    # the second snapshot is whole but not in force; its batch is in the log
    assert tried == [1, 3] and counters._switched(spark, out)[0] == 1 and got() == {"a": 4, "b": 8}
    go()
    assert counters._switched(spark, out)[0] == 3 and got() == {"a": 5, "b": 10}
    changes, folder = counters._changes(spark, out, ["token"])
    assert "-snapshot-3-" in folder and changes.count() == 4  # two keys of the snapshot, two of the last batch
