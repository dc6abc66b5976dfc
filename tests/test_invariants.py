"""Properties of operators without a SQL oracle, and independence of partitioning."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from combisieve.operators import profile, skew, splits
from combisieve.sources import assay
from combisieve.session import scratch_path
from workload import fixtures as X
from workload import q_similarity, q_splits


def test_stratified_group_folds_keep_groups_and_labels(spark, sf):
    lib = q_splits._lib(spark, sf)
    folds = q_splits.stratified_group_kfold(spark, sf)
    assert folds.count() == lib.count()
    assert folds.groupBy("scaffold").agg(F.countDistinct("fold_idx").alias("n")).filter("n > 1").count() == 0
    assert folds.select("fold_idx").distinct().count() == 5


def test_folds_of_groups_keep_labels_even(spark, sf):
    """Each label's rows differ little between folds, and so do all rows."""
    lib = q_splits._lib(spark, sf.replace("sf0.001", "sf0.01")).withColumn("pair", F.concat_ws("-", "bb2", "bb3"))
    folds = splits.stratified_group_folds(lib, "pair", "label", 4)
    assert folds.select("pair").distinct().count() == folds.count() == lib.select("pair").distinct().count()
    rows = lib.join(folds, "pair")
    loads = [r[1] for r in folds.groupBy("fold_idx").agg(F.sum("group_size")).collect()]
    assert len(loads) == 4 and max(loads) < 1.05 * min(loads)
    labels = {}
    for r in rows.groupBy("label", "fold_idx").count().collect():
        labels.setdefault(r["label"], []).append(r["count"])
    for counts in labels.values():
        if sum(counts) >= 1000:
            assert len(counts) == 4 and max(counts) < 1.15 * min(counts), labels


def test_two_level_folds_cover_the_blocks(spark, sf):
    lib = q_splits._lib(spark, sf)
    out = q_splits.two_level_block_folds(spark, sf)
    first = out.filter("side = 'bb1'")
    assert first.count() == lib.select("bb1").distinct().count()
    pair = out.filter("side = 'bb23'")
    assert pair.groupBy("bb1_fold", "block").count().filter("count > 1").count() == 0
    seen = lib.join(first.select(F.col("block").alias("bb1"), "bb1_fold"), "bb1").select(
        "bb1_fold", F.explode(F.array("bb2", "bb3")).alias("block")
    ).distinct()
    assert seen.count() == pair.count()


def test_diverse_picks_per_cluster(spark, sf):
    clusters = q_similarity.threshold_clusters(spark, sf)
    size = {r[0]: r[1] for r in clusters.groupBy("cluster").count().collect()}
    picks = {r[0]: r[1] for r in q_similarity.diverse_pick(spark, sf).groupBy("cluster").count().collect()}
    assert picks == {c: max(1, n // 10) for c, n in size.items()}


def test_hot_keys_are_attached(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 1).otherwise(F.col("id")).alias("k"))
    out = profile.with_group_stats(df, "k", ["id"], {}, "n")
    want = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    got = {r["k"]: r["n"] for r in out.select("k", "n").distinct().collect()}
    assert got == want and out.count() == 5000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, how):
    left = spark.range(2000).select("id", F.when(F.col("id") < 1200, 5).otherwise(F.col("id") % 40).alias("k"))
    right = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.spread_join(left, right, ["k"], how, ["id"])
    want = left.join(right, "k", how).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_unknown_protein(spark):
    path = scratch_path(spark, "assay")
    df = spark.createDataFrame([(1, "a", "b", "c", "m", "HSA", 0), (2, "a", "b", "c", "m", "XYZ", 1)],
                               "id bigint, bb1 string, bb2 string, bb3 string, molecule string, protein string, binds int")
    assay.write_assay(df, path)
    assert assay.read_assay(spark, path, unknown="drop").count() == 1
    with pytest.raises(Exception):
        assay.read_assay(spark, path).collect()


@pytest.mark.parametrize("name", ["sp2_stratified_kfold", "sp3_group_kfold", "ag9_concentration", "tm5_average_precision",
                                  "sa4_weighted_sample", "sg1_similarity_pairs_tanimoto"])
def test_partitioning_does_not_matter(spark, sf, name):
    results = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = entry.queries()[name](spark, sf)
        results.append(sorted(tuple(str(v) for v in r) for r in df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lib_is_whole(spark, sf):
    assert X.lib(spark, sf).count() == X.table(spark, sf, "lineitem").count()
