"""Folds of whole groups that keep the mix of all labels, against a plain loop."""

import pytest
from pyspark.sql import functions as F

from combisieve.operators import splits
from workload import q_splits


def greedy_folds(groups, k):
    """Group after group to the fold where it adds least to the squared label
    shares; groups per fold for each mix."""
    totals = {}
    for cells in groups.values():
        for label, n in cells.items():
            totals[label] = totals.get(label, 0) + n
    loads, rows, dealt = {label: [0] * k for label in totals}, [0] * k, {}
    uneven = lambda c: len(totals) * sum(n * n for n in c.values()) - sum(c.values()) ** 2
    for cells in sorted(groups.values(), key=lambda c: (-uneven(c), -sum(c.values()), mix(c))):
        cost = [sum(10**36 // totals[label] ** 2 * n * loads[label][f] for label, n in cells.items()) for f in range(k)]
        f = min(range(k), key=lambda i: (cost[i], rows[i], i))
        rows[f] += sum(cells.values())
        for label, n in cells.items():
            loads[label][f] += n
        dealt.setdefault(mix(cells), [0] * k)[f] += 1
    return dealt


def mix(cells):
    return tuple(sorted(f"{n}" if label is None else f"{n}:{label}" for label, n in cells.items()))


def label_counts(rows, *key):
    groups = {}
    for r in rows.groupBy(*key, "label").count().collect():
        groups.setdefault(r[0] if len(key) == 1 else tuple(r[:len(key)]), {})[r["label"]] = r["count"]
    return groups


def dealt_folds(groups, folds, k):
    got = {}
    for g, f in folds:
        got.setdefault(mix(groups[g]), [0] * k)[f] += 1
    return got


def mixed_rows(spark, n, labels, size):
    """``n`` groups of up to ``size`` rows with skewed labels."""
    return spark.range(n * size).select(
        "id", (F.col("id") % n).alias("g"),
        F.floor(labels * F.pow(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000, 3)).cast("int").alias("label"),
    ).filter(F.pmod(F.xxhash64("g", F.lit(1)), F.lit(size)) >= F.floor(F.col("id") / n))


@pytest.mark.parametrize(
    ("n", "labels", "size", "mixes"),
    # in one round, over several rounds, and with more mixes than 20,000
    [(400, 3, 40, 100_000), (400, 3, 40, 7), (30_000, 2, 4, 3), (24_000, 300, 6, 5_000)],
)
def test_every_label_counts_at_any_number_of_groups(spark, monkeypatch, n, labels, size, mixes):
    monkeypatch.setattr(splits, "MIX_ROUND", mixes)
    rows = mixed_rows(spark, n, labels, size)
    groups = label_counts(rows, "g")
    folds = splits.label_mix_folds(rows, "g", "label", 5).collect()
    assert len(folds) == len(groups) and all(r["group_size"] == sum(groups[r["g"]].values()) for r in folds)
    assert dealt_folds(groups, [(r["g"], r["fold_idx"]) for r in folds], 5) == greedy_folds(groups, 5)


def test_unknown_empty_and_colon_labels(spark):
    rows = spark.range(900).select(
        F.when(F.col("id") % 90 > 0, F.col("id") % 90).alias("g"),
        F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit(":"), F.lit("a:b")), F.pmod(F.xxhash64("id"), F.lit(4)).cast("int") + 1).alias("label"),
    )
    groups = label_counts(rows, "g")
    assert len({x for c in groups.values() for x in c}) == 4 and None in groups
    folds = splits.label_mix_folds(rows, "g", "label", 3).collect()
    assert dealt_folds(groups, [(r["g"], r["fold_idx"]) for r in folds], 3) == greedy_folds(groups, 3)
    assert splits.label_mix_folds(rows.filter("false"), "g", "label", 3).collect() == []


def test_group_kfold_weighs_every_label(spark):
    """The operator behind sp4 places a group by all its labels, not by one."""
    rows = mixed_rows(spark, 300, 5, 30)
    groups = label_counts(rows, "g")
    folds = splits.stratified_group_kfold(rows, "g", ["id"], "label", 4).select("g", "fold_idx").distinct().collect()
    assert dealt_folds(groups, folds, 4) == greedy_folds(groups, 4)


def test_sp4_spreads_what_one_large_group_leaves(spark, sf):
    """One scaffold holds 29 % of the rows; its fold gets little else."""
    rows = q_splits._lib(spark, sf).join(q_splits.stratified_group_kfold(spark, sf).select("mol_id", "fold_idx"), "mol_id")
    loads = [r[1] for r in rows.groupBy("fold_idx").count().collect()]
    assert len(loads) == 5 and max(loads) < 2 * min(loads)


def test_both_levels_weigh_every_label(spark, monkeypatch):
    """Outer folds, and the inner ones of each outer fold, against the loop; the
    outer folds need different numbers of rounds."""
    monkeypatch.setattr(splits, "MIX_ROUND", 9)
    rows = mixed_rows(spark, 12, 4, 200).select(
        "label", F.col("g").alias("bb1"),
        *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40) + 5 * F.col("g")).alias(f"bb{i}") for i in (2, 3)],
    )
    out = splits.two_level_block_folds(rows, "label", 3, 4)
    first = label_counts(rows, "bb1")
    outer = {r["block"]: r["fold_idx"] for r in out.filter("side = 'bb1'").collect()}
    assert dealt_folds(first, outer.items(), 3) == greedy_folds(first, 3)
    held = rows.join(out.filter("side = 'bb1'").select(F.col("block").alias("bb1"), F.col("fold_idx").alias("p")), "bb1")
    pair = label_counts(held.select("p", F.explode(F.array_distinct(F.array("bb2", "bb3"))).alias("block"), "label"), "p", "block")
    inner = [((r["bb1_fold"], r["block"]), r["fold_idx"]) for r in out.filter("side = 'bb23'").collect()]
    assert len(inner) == len(pair)
    for p in range(3):
        groups = {g: c for g, c in pair.items() if g[0] == p}
        assert dealt_folds(groups, [x for x in inner if x[0][0] == p], 4) == greedy_folds(groups, 4)


def test_sp5_deals_the_first_blocks_evenly(spark, sf):
    """Outer folds of near equal rows; by one label of each block they differ threefold."""
    sf = sf.replace("sf0.001", "sf0.01")
    lib = q_splits._lib(spark, sf)
    outer = q_splits.two_level_block_folds(spark, sf).filter("side = 'bb1'").select(F.col("block").alias("bb1"), "fold_idx")
    loads = [r[1] for r in lib.join(outer, "bb1").groupBy("fold_idx").count().collect()]
    assert len(loads) == 4 and max(loads) < 1.5 * min(loads)
