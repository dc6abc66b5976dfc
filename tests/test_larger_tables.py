"""What only larger tables bring about, on rows built here."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from combisieve.functions import grams
from combisieve.operators import matching, sampling, similarity, splits, tokens
from combisieve.session import cut_lineage


@pytest.mark.parametrize("n_small", [0, 6])
def test_split_without_small_scaffolds(spark, n_small):
    """Too few rows of small scaffolds: no second stage, the third takes its share."""
    rows = spark.range(4000).select(
        "id", (F.col("id") % 3).alias("scaffold"), F.when(F.col("id") < 10 * n_small, 5).otherwise(9000).alias("size"),
        (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 10).cast("int").alias("bb1"),
    )
    got = dict(splits.three_stage_split(rows, ["id"], {"bb1": [0]}, "scaffold", "size", "label").groupBy("subset").count().collect())
    # 400 rows are held out, which asks for 290 others of 3,600: every 12th of either label, begun ones too
    assert got == {0: 400, 3: 301, None: 3299}


def vectors(spark, n, seed, first=0):
    """Dense vectors of 64 bits in two words: families, copies and an empty one."""
    pick = random.Random(seed)
    seeds = [pick.getrandbits(64) for _ in range(9)]
    rows = [(first + i, pick.choice(seeds) ^ (1 << pick.randrange(64)) if i % 3 else pick.getrandbits(64)) for i in range(n)]
    rows += [(first + n, 0), (first + n + 1, rows[1][1]), (first + n + 2, rows[0][1])]
    return spark.createDataFrame([(i, [x & 0xFFFFFFFF, x >> 32]) for i, x in rows] + [(first + n + 3, None)], "id bigint, words array<bigint>")


@pytest.mark.parametrize("metric", similarity.METRICS)
def test_dense_pairs_are_compared_in_blocks(spark, monkeypatch, metric):
    """Where the lists of bits are longer than all pairs, and the same pairs as by them."""
    left, right = vectors(spark, 70, 1), vectors(spark, 50, 1, 1000)

    def found():
        kw = {"threshold": 0.55, "n_bits": 64, "metric": metric, "alpha": 0.9, "beta": 0.3}
        return [sorted(map(tuple, similarity.similarity_pairs(*sides, **kw).collect())) for sides in ((left,), (left, right))]

    with monkeypatch.context() as m:
        m.setattr(similarity, "LIST_COST", 0)
        m.setattr(similarity, "JOIN_COST", 0)
        by_lists = found()
    monkeypatch.setattr(similarity, "_ranked", None)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", (8, 8))
    monkeypatch.setattr(similarity, "BATCH_PAIRS", 5)
    assert found() == by_lists and min(map(len, by_lists)) > 20


def test_grams_by_batch(spark, monkeypatch):
    """The same hashes as of each q-gram by itself, over slices of any size."""
    pick = random.Random(4)
    texts = [None, "", "abc", "abcd", "日本語テキスト", "a\U0001F600b\U0001F600cd", "x" * 300]
    texts += ["".join(pick.choice("ab cé\U0001F600\n") for _ in range(pick.randrange(60))) for _ in range(60)]
    rows = [(i % 50 if i % 7 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    monkeypatch.setattr(grams, "KNOWN_GRAMS", 10)
    monkeypatch.setattr(grams, "SLICE_CHARS", 40)

    def h(g, bits):
        return int(hashlib.md5(g.encode()).hexdigest()[:13], 16) >> (52 - bits)

    per_row, cells = [], Counter()
    for i, t in rows:
        bits = [h(t[j : j + 4], 7) % 100 for j in range(len(t) - 3)] if t else []
        per_row.append((i, [sum(1 << (b - 32 * w) for b in set(bits) if b // 32 == w) for w in range(4)]))
        cells.update((i, b) for b in bits)
    got = tokens.qgram_fingerprint(df, ["id"], "text", 4, 100)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, per_row))
    got = tokens.qgram_fingerprint(df, ["id"], "text", 4, 100, counts=True)
    assert {(r.id, r.bit): r.n for r in got.collect()} == dict(cells) and got.count() == len(cells)
    # ids that come once have no cells to add up
    once = tokens.qgram_fingerprint(df.filter("id is not null").dropDuplicates(["id"]), ["id"], "text", 4, 100, counts=True)
    plans = [x._jdf.queryExecution().analyzed().toString() for x in (once, got)]
    assert ["sum(n" in p for p in plans] == [False, True]
    for i, signature in df.select("text", tokens.minhash_signature("text", 4, 5).alias("s")).collect():
        hs = {h(i[j : j + 4], 31) % tokens.MERSENNE for j in range(len(i) - 3)} if i else set()
        assert signature == [min(((a * x + b) % tokens.MERSENNE for x in hs), default=tokens.MERSENNE) for a, b in tokens.hash_family(5, 42)]


def test_poisson_counts_are_drawn_by_batch(spark):
    """No fold of the distribution for each row by itself, whatever the mean."""
    rows = [(1, 0.3), (2, 5.0), (3, 40.5), (4, 2e6), (5, 0.0), (None, 17.0), (7, None)] + [(i, 3.0) for i in range(100, 140)]
    out = sampling.poisson_sample(spark.createDataFrame(rows, "id int, w double"), ["id"], "w", 2.0)
    assert "lambdafunction" not in out._jdf.queryExecution().analyzed().toString()
    want = {}
    for i, w in rows:
        parts = math.ceil(2 * w / 16) if w else 0
        for p in range(parts):
            own = 2 * w / parts
            u = int(hashlib.md5(":".join(["42", *([] if i is None else [str(i)]), str(p)]).encode()).hexdigest()[:13], 16) / 2**52
            mass = below = math.exp(-own)
            k = 0
            while below <= u:
                k += 1
                mass *= own / k
                below += mass
            want[i] = want.get(i, 0) + k
    assert {r["id"]: r["n"] for r in out.collect()} == {i: n for i, n in want.items() if n}


def test_last_edges_go_in_order(spark, monkeypatch):
    """A chain, of which a round takes one edge, needs no round; the results are those of rounds."""
    chain = spark.createDataFrame([((i + 1) // 2, i // 2, 1, 0.01 * i) for i in range(60)], "a int, b int, copy int, cost double")
    written = []
    with monkeypatch.context() as m:
        m.setattr(matching, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
        assert sorted(r.a for r in matching.one_to_one_match(chain).collect()) == list(range(30)) and len(written) < 5
    left, right = vectors(spark, 60, 2).filter("words is not null"), vectors(spark, 45, 2, 1000)
    pairs = similarity.similarity_pairs(left, right, threshold=0.4, n_bits=64)

    def found():
        clusters = matching.threshold_clusters(left, 0.5, n_bits=64)
        picks = matching.diverse_pick(clusters.join(left, "id"), F.lit(4))
        edges = matching.one_to_one_match(matching.match_edges(pairs, copies=2))
        return [sorted(map(tuple, df.collect())) for df in (clusters, picks, edges, matching.match_tables(left, right, 2))]

    at_once = found()
    monkeypatch.setattr(matching, "LAST_EDGES", 0)
    monkeypatch.setattr(matching, "PICK_ROWS", 0)
    assert found() == at_once and max(p for *_, p in at_once[1]) == 4


def test_free_rows_are_matched_by_falling_thresholds(spark, monkeypatch):
    """Few pairs are matched at once, many at more thresholds than pairs of little
    likeness would need rounds; the matches are the same."""
    left, right = vectors(spark, 24, 5).filter("words is not null"), vectors(spark, 20, 6, 1000)
    seen, pairs_of = [], similarity.similarity_pairs_of

    def found(**kw):
        seen.clear()
        return sorted(map(tuple, matching.match_tables(left, right, **kw).collect()))

    monkeypatch.setattr(matching, "similarity_pairs_of", lambda a, b, level, *args: seen.append(level) or pairs_of(a, b, level, *args))
    at_once = found()
    assert len(seen) == 1
    monkeypatch.setattr(matching, "LAST_EDGES", 0)
    assert found(levels=(0.5,)) == at_once and len(seen) == 2
