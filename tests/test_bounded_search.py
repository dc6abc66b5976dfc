"""Searches that look at a part of the pairs, against all pairs."""

import random

import pytest

from combisieve.operators import similarity

SCHEMA = "id bigint, words array<bigint>"
N_BITS = 128


def vector(bits, n_bits: int = N_BITS) -> list[int]:
    return [sum(1 << (b % 32) for b in set(bits) if b // 32 == w) for w in range(n_bits // 32)]


def bits_of(words: list[int]) -> set[int]:
    return {32 * i + j for i, w in enumerate(words) for j in range(32) if w >> j & 1}


def library(n: int, seed: int, first_id: int = 0) -> list[tuple[int, list[int]]]:
    """Families of alike vectors, copies, loners, dense and empty ones."""
    pick = random.Random(seed)
    seeds = [pick.sample(range(N_BITS), 30) for _ in range(8)]
    out = []
    for i in range(n):
        kind = i % 10
        if kind < 6:
            own = set(pick.choice(seeds)) ^ set(pick.sample(range(N_BITS), pick.randrange(4)))
        elif kind < 8:
            own = set(pick.sample(range(N_BITS), pick.randrange(1, 20)))
        elif kind == 8:
            own = set(range(N_BITS)) - set(pick.sample(range(N_BITS), pick.randrange(20)))
        else:
            own = bits_of(out[pick.randrange(len(out))][1])
        out.append((first_id + i, vector(own)))
    return [*out, (first_id + n, vector([]))]


def value(a: list[int], b: list[int], metric: str) -> float:
    x, y = bits_of(a), bits_of(b)
    if not x or not y:
        return 0.0
    return float(similarity.similarity_of(float(len(x & y)), float(len(x)), float(len(y)), metric, 0.9, 0.3, lambda v: v**0.5))


@pytest.mark.parametrize(("metric", "exclude_self"), [("tanimoto", False), ("tanimoto", True), ("tversky", False), ("cosine", True)])
def test_nearest(spark, metric, exclude_self, monkeypatch):
    monkeypatch.setattr(similarity, "GRID_ROWS", 16)
    targets = library(150, 1)
    queries = targets[:60] if exclude_self else [*library(40, 2, 1000), (5000, targets[5][1])]
    report = []
    got = similarity.nearest(
        spark.createDataFrame([*queries, (7, None)], SCHEMA), spark.createDataFrame([*targets, (8, None)], SCHEMA), 4,
        metric=metric, alpha=0.9, beta=0.3, exclude_self=exclude_self, report=report,
    ).collect()
    want = []
    for q, a in queries:
        order = sorted((-value(a, b, metric), t) for t, b in targets if not (exclude_self and t == q))[:4]
        want += [(q, i + 1, t, round(-s, 9)) for i, (s, t) in enumerate(order)]
    assert sorted((r.query_id, r.rank, r.target_id, round(r.similarity, 9)) for r in got) == sorted(want)
    assert report and max(n for _, n in report) <= len(queries) * len(targets)


def test_nearest_of_nothing(spark):
    some, none = spark.createDataFrame(library(5, 1), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert similarity.nearest(some, none, 3).count() == similarity.nearest(none, some, 3).count() == 0
    assert similarity.similarity_summary(some, none).count() == similarity.similarity_summary(none, some).count() == 0
    assert similarity.nearest(some, some, 100).count() == 36


def test_compared_pairs_follow_the_alike_ones(spark):
    """Queries with near partners are not compared with the rest of the table."""
    counts = []
    for n in (200, 800):
        pick = random.Random(n)
        rows = []
        for f in range(n // 8):
            own = pick.sample(range(1024), 24)
            rows += [(8 * f + j, vector(set(own) ^ {pick.randrange(1024)}, 1024)) for j in range(8)]
        df, report = spark.createDataFrame(rows, SCHEMA), []
        assert similarity.nearest(df, df, 3, exclude_self=True, report=report).count() == 3 * n
        counts.append(sum(c for _, c in report))
    assert counts[1] < 0.2 * 800 * 800 and counts[1] < 8 * counts[0]


@pytest.mark.parametrize("metric", ["tanimoto", "cosine"])
def test_summary(spark, metric, monkeypatch):
    monkeypatch.setattr(similarity, "GRID_ROWS", 16)
    monkeypatch.setattr(similarity, "PROBES", 3)
    targets = [r for r in library(160, 3) if r[1] != vector([])]
    queries = [*library(40, 4, 1000), (3000, targets[0][1]), (3001, targets[0][1])]
    report = []
    got = similarity.similarity_summary(spark.createDataFrame([*queries, (9, None)], SCHEMA), spark.createDataFrame(targets, SCHEMA), metric=metric, report=report)
    want = {q: (max(v), min(v)) for q, v in ((q, [value(a, b, metric) for _, b in targets]) for q, a in queries)}
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        best, worst = want[r.query_id]
        assert r.best == pytest.approx(best) and r.worst == pytest.approx(worst) and r.spread == pytest.approx(best - worst)
    assert {name for name, _ in report} >= {"probes", "classes"}


def test_dense_vectors_skip_sizes(spark, monkeypatch):
    """Without any disjoint target the sizes bound what has to be compared."""
    monkeypatch.setattr(similarity, "GRID_ROWS", 8)
    monkeypatch.setattr(similarity, "PROBES", 4)
    pick = random.Random(6)
    targets = [(i, vector(pick.sample(range(N_BITS), 40 + i % 88))) for i in range(300)]
    queries = [(i, vector(pick.sample(range(N_BITS), 100))) for i in range(60)]
    report = []
    got = similarity.similarity_summary(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(targets, SCHEMA), report=report).collect()
    for r in got:
        assert r.worst == pytest.approx(min(value(queries[r.query_id][1], b, "tanimoto") for _, b in targets))
    assert dict(report)["classes"] < 0.7 * 300 * 60
