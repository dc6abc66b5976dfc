"""Cross-validation splits over items, groups and building blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from combisieve import TARGETS
from combisieve.functions.hashing import HASH_BITS, hash_key
from combisieve.operators.joins import keep_keys
from combisieve.operators.ordering import hash_rank, row_index
from combisieve.operators.predicates import in_sets
from combisieve.operators.sampling import subsample
from combisieve.operators.skew import BROADCAST_ROWS, attach_totals
from combisieve.session import cut_lineage

# Sizes of the second-stage and of the second-plus-third-stage
# test parts relative to the number of fully held-out rows.
STAGE2_RATIO = 158_699 / 508_983
STAGE23_RATIO = 369_039 / 508_983
SIZE_CUT = 6116
# Label shares are compared as whole numbers of this part.
SHARE_SCALE = 10**15
# Squared label shares as whole numbers: exact up to 10**18 rows of a label.
MIX_SCALE = 10**36
# Label mixes that one task deals before it hands the loads on.
MIX_ROUND = 100_000


# --- folds of rows ---------------------------------------------------------

def kfold(df: DataFrame, ids: Sequence[str], k: int, seed: object = 42, name: str = "fold_idx") -> DataFrame:
    """Shuffled folds whose sizes differ by at most one."""
    return hash_rank(df, ids, seed, name=name).withColumn(name, (F.col(name) % k).cast("int"))


def stratified_kfold(
    df: DataFrame, ids: Sequence[str], label: Sequence[str], k: int, seed: object = 42, name: str = "fold_idx"
) -> DataFrame:
    """Per label, fold sizes differ by at most one."""
    return hash_rank(df, ids, seed, label, name).withColumn(name, (F.col(name) % k).cast("int"))


# --- folds of groups -------------------------------------------------------

def _fill(loads: list[int], size: int, count: int, rows: list[int] | None = None, group: int = 0) -> list[int]:
    """How many of ``count`` equal groups each fold gets when every next group
    goes to the lightest fold.  Ties go to the fold with the fewest ``rows``, to
    which a group adds ``group``, then to the lowest index."""

    def below(level: int) -> list[int]:
        return [max(0, -(-(level - load) // size)) for load in loads]

    low, high = min(loads), max(loads) + size * (count + 1)
    while high - low > 1:  # highest level with at most ``count`` groups below it
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= count else (low, mid)
    got = below(low)
    last = [i for i, load in enumerate(loads) if load + got[i] * size == low]
    if rows:
        last.sort(key=lambda i: rows[i] + got[i] * group)
    for i in last[: count - sum(got)]:
        got[i] += 1
    return got


def largest_first_plan(histogram: Iterable[tuple[int, int]], k: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """Largest group first, always to the lightest fold, on a size histogram.

    Returns ``(size, cumulative group counts per fold)`` rows and the fold
    loads.  Groups of one size are interchangeable, so the histogram (at most
    sqrt(2n) sizes) decides every load.
    """
    loads, plan = [0] * k, []
    for size, count in sorted(histogram, reverse=True):
        got = _fill(loads, size, count)
        loads = [load + g * size for load, g in zip(loads, got)]
        plan.append((size, [int(x) for x in np.cumsum(got)]))
    return plan, loads


def group_folds(df: DataFrame, key: str, k: int, seed: object = 42, name: str = "fold_idx") -> tuple[DataFrame, list[int]]:
    """``(key, group_size, fold)`` for whole-group folds, and the fold loads."""
    # one row per group, read for the histogram, the ranks and the join
    sizes = cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("group_size")))
    hist = sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("n"))
    plan, loads = largest_first_plan([(r[0], r[1]) for r in hist.collect()], k)
    table = df.sparkSession.createDataFrame(plan, "group_size bigint, __ends array<bigint>")
    if len(plan) <= BROADCAST_ROWS // k:
        table = F.broadcast(table)
    ranked = hash_rank(sizes, [key], seed, ["group_size"], "__rank")
    fold = F.size(F.filter("__ends", lambda e: e <= F.col("__rank")))
    return ranked.join(table, "group_size").select(key, "group_size", fold.alias(name)), loads


def group_kfold(
    df: DataFrame, key: str, ids: Sequence[str], k: int, seed: object = 42, name: str = "fold_idx"
) -> DataFrame:
    folds, _ = group_folds(df, key, k, seed, name)
    return attach_totals(df, folds, [key], "group_size", ids).drop("group_size")


def stratum_plan(histogram: Iterable[tuple[int, int, int]], k: int, turn: int = 0) -> list[list[int]]:
    """Cumulative group counts per fold for each ``(own, size, groups)`` row of a
    stratum: groups with the most rows of the stratum's label first, the larger
    of equal ones, each to the fold with the fewest of those rows, then to the
    one with the fewest rows, then to the first from ``turn`` on.

    Groups with equal numbers are interchangeable and dealt in one step.
    """
    loads, rows = [0] * k, [0] * k
    histogram = list(histogram)
    found: dict[int, list[int]] = {}
    for at in sorted(range(len(histogram)), key=lambda i: (-histogram[i][0], -histogram[i][1])):
        own, size, count = histogram[at]
        got = _fill(loads, int(own), int(count), rows, int(size))
        loads = [load + g * int(own) for load, g in zip(loads, got)]
        rows = [r + g * int(size) for r, g in zip(rows, got)]
        # strata do not all begin with the same fold
        turned = [got[(i - turn) % k] for i in range(k)]
        found[at] = list(accumulate(turned))
    return [found[at] for at in range(len(found))]


def stratified_group_folds(
    df: DataFrame,
    key: str,
    label: str,
    k: int,
    within: Sequence[str] = (),
    seed: object = 42,
    name: str = "fold_idx",
) -> DataFrame:
    """``(within, key, group_size, fold)``: whole groups, label mix kept.

    A group belongs to the stratum of the label of which it holds the largest
    share of all rows (ties: the lower label), so that rare labels are dealt
    evenly before common ones.  Every stratum is planned by a task of its own on
    the histogram of ``(rows of the label, rows)`` of its groups
    (``stratum_plan``), at any number of groups and labels; a group finds its
    fold by its hash rank among those with equal numbers.  A NULL label is a
    label, a NULL key a group.
    """
    within = list(within)
    # compared as text, like in every engine; NULL before all others
    cells = cut_lineage(
        df.groupBy(*within, F.col(key).alias("__key"), F.col(label).cast("string").alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    )
    totals = cells.groupBy(*within, "__label").agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__groups"))
    shared = attach_totals(cells, totals, [*within, "__label"], "__groups", ["__key"])
    # whole numbers, so that equal shares are equal in every engine
    share = F.expr(f"cast(__n as decimal(38,0)) * {SHARE_SCALE} div cast(__all as decimal(38,0))")
    first = F.min(F.struct((-share).alias("s"), F.col("__label").isNotNull().alias("some"), "__label", "__n"))
    groups = cut_lineage(
        shared.groupBy(*within, "__key").agg(F.sum("__n").alias("group_size"), first.alias("__f"))
        .select(*within, "__key", "group_size", F.col("__f.__label").alias("__label"), F.col("__f.__n").alias("__own"))
    )
    stratum = [*within, "__label"]
    cell = [*stratum, "__own", "group_size"]
    hist = groups.groupBy(*cell).agg(F.count(F.lit(1)).alias("__groups"))
    turn = F.pmod(hash_key(F.coalesce("__label", F.lit("")), seed=seed), F.lit(k)).cast("int")
    schema = StructType([*hist.schema, StructField("__ends", ArrayType(LongType()))])

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        ends = stratum_plan(zip(part["__own"], part["group_size"], part["__groups"]), k, int(part["__turn"].iloc[0]))
        return part.drop(columns="__turn").assign(__ends=pd.Series(ends, part.index))

    plan = cut_lineage(hist.withColumn("__turn", turn).groupBy(*stratum).applyInPandas(deal, schema))
    ranked = hash_rank(groups.withColumnRenamed("__key", key), [key], seed, cell, "__rank")
    found = attach_totals(ranked, plan, cell, "__groups", [key])
    fold = F.size(F.filter("__ends", lambda e: e <= F.col("__rank")))
    return found.select(*within, key, "group_size", fold.alias(name))


def label_mix_plan(
    histogram: Iterable[tuple[Sequence[str], int]], totals: Mapping[str, int], loads: dict[str, list[int]], k: int
) -> list[list[int]]:
    """Cumulative group counts per fold for each ``(label mix, groups)`` row, in
    the order of the rows; a mix lists ``rows:label`` of one group.

    Every group goes to the fold where it adds least to the squared label
    shares, then to the one with the fewest rows, then to the first.  Groups of
    one mix are interchangeable and each adds the same to the cost of its fold,
    so a mix is dealt in one step whatever its number of groups.  ``loads`` (rows
    of each label per fold) is carried on.
    """
    weight = {label: max(1, MIX_SCALE // t**2) for label, t in totals.items()}
    rows = [sum(load) for load in zip(*loads.values())]
    ends = []
    for mix, count in histogram:
        # a NULL label has no colon
        cells = [(colon + label, int(n)) for n, colon, label in (cell.partition(":") for cell in mix)]
        cost = [0] * k
        for label, n in cells:
            w = weight[label] * n
            cost = [c + w * load for c, load in zip(cost, loads[label])]
        size = sum(n for _, n in cells)
        if count == 1:
            got = [0] * k
            got[min(range(k), key=lambda i: (cost[i], rows[i]))] = 1
        else:
            got = _fill(cost, sum(weight[label] * n * n for label, n in cells), int(count), rows, size)
        for i, g in enumerate(got):
            if g:
                rows[i] += g * size
                for label, n in cells:
                    loads[label][i] += g * n
        ends.append(list(accumulate(got)))
    return ends


def label_mix_folds(
    df: DataFrame,
    key: str,
    label: str,
    k: int,
    within: Sequence[str] = (),
    seed: object = 42,
    name: str = "fold_idx",
) -> DataFrame:
    """``(within, key, group_size, fold)``: whole groups, the mix of all labels kept.

    Groups with the most uneven labels first (the larger, then the lower mix on
    ties), each by itself to the fold where all its labels together fit best
    (``label_mix_plan``), at any number of groups and labels.  Folds are planned
    on the histogram of label mixes, sorted by Spark and dealt ``MIX_ROUND`` mixes
    of each ``within`` at a time: a task gets one round and the loads so far.  A
    group finds its fold by its hash rank among those of its mix.  A NULL label
    is a label, a NULL key a group.
    """
    within, part = list(within), list(within) or ["__all"]
    # without a label there is no colon, so NULL and "" differ
    text = F.coalesce(F.concat(F.lit(":"), F.col(label).cast("string")), F.lit("")).alias("__label")
    counted = df.groupBy(*within, F.col(key).alias("__key"), text).agg(F.count(F.lit(1)).alias("__n"))
    cells = cut_lineage(counted if within else counted.withColumn("__all", F.lit(0)))
    totals = cells.groupBy(*part, "__label").agg(F.sum("__n").alias("__groups"))
    cell = F.concat(F.col("__n").cast("string"), F.col("__label"))
    # exact at any size: squares of row counts outgrow a bigint
    groups = cut_lineage(
        cells.groupBy(*part, "__key").agg(
            F.sum("__n").alias("group_size"),
            F.sum(F.expr("cast(__n as decimal(18,0)) * cast(__n as decimal(18,0))")).cast("decimal(38,0)").alias("__squares"),
            F.array_sort(F.collect_list(cell)).alias("__mix"),
        )
    )
    hist = cut_lineage(groups.groupBy(*part, "__mix", "group_size", "__squares").agg(F.count(F.lit(1)).alias("__groups")))
    count = {n: F.sum(n).alias(n) for n in ("__labels", "__units")}
    parts = cut_lineage(
        totals.select(*part, F.lit(1).alias("__labels"), F.lit(0).alias("__units"))
        .unionByName(hist.select(*part, F.lit(0).alias("__labels"), F.lit(1).alias("__units")))
        .groupBy(*part).agg(*count.values())
    )
    even = F.expr(
        "cast(cast(group_size as decimal(18,0)) * cast(group_size as decimal(18,0))"
        " - cast(__labels as decimal(18,0)) * __squares as decimal(38,0))"
    )
    sized = attach_totals(hist, parts, part, "__units", ["__mix"])
    sized = sized.select(*part, even.alias("__even"), (-F.col("group_size")).alias("__small"), "__mix", "__groups")
    ordered = row_index(sized, [*part, "__even", "__small", "__mix"], "__at")
    starts = ordered.groupBy(*part).agg(F.min("__at").alias("__start"), F.count(F.lit(1)).alias("__units"))
    rounds = cut_lineage(
        attach_totals(ordered, starts, part, "__units", ["__at"])
        .withColumn("__round", F.floor((F.col("__at") - F.col("__start")) / F.lit(MIX_ROUND)).cast("int"))
    )
    no_ends = F.lit(None).cast("array<bigint>").alias("__ends")
    units = rounds.select("__round", *part, "__at", "__mix", F.lit(None).cast("string").alias("__label"), "__groups", no_ends)
    # the loads travel as rows without a mix; __groups is the label's total there
    state = totals.select(
        *part, F.lit(-1).cast("bigint").alias("__at"), F.lit(None).cast("array<string>").alias("__mix"), "__label", "__groups",
        F.array_repeat(F.lit(0).cast("bigint"), k).alias("__ends"),
    )
    schema = state.schema

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        mixes, now = rows[rows["__mix"].notna()].sort_values("__at"), rows[rows["__mix"].isna()]
        total = {x: int(t) for x, t in zip(now["__label"], now["__groups"])}
        loads = {x: [int(n) for n in load] for x, load in zip(now["__label"], now["__ends"])}
        ends = label_mix_plan(zip(mixes["__mix"], mixes["__groups"]), total, loads, k)
        return pd.concat([
            mixes.assign(__ends=pd.Series(ends, mixes.index, dtype=object)),
            now.assign(__ends=pd.Series([loads[x] for x in now["__label"]], now.index, dtype=object)),
        ])

    plans = [units.drop("__round").filter(F.lit(False))]
    last = rounds.agg(F.max("__round")).first()[0]
    for i in range(0 if last is None else last + 1):
        ready = units.filter(F.col("__round") == i).drop("__round").unionByName(state)
        dealt = cut_lineage(ready.groupBy(*part).applyInPandas(deal, schema))
        plans.append(dealt.filter("__mix is not null"))
        state = dealt.filter("__mix is null")
    plan = reduce(DataFrame.unionByName, plans).select(*part, "__mix", "__groups", "__ends")
    ranked = hash_rank(groups.withColumnRenamed("__key", key), [key], seed, [*part, "__mix"], "__rank")
    # a mix may be that of most groups
    found = attach_totals(ranked, plan, [*part, "__mix"], "__groups", [key])
    fold = F.size(F.filter("__ends", lambda e: e <= F.col("__rank")))
    # callers join it to all rows and read it more than once: a file has its true size
    return cut_lineage(found.select(*within, key, "group_size", fold.alias(name)))


def stratified_group_kfold(
    df: DataFrame, key: str, ids: Sequence[str], label: str, k: int, seed: object = 42, name: str = "fold_idx", **kw
) -> DataFrame:
    folds = label_mix_folds(df, key, label, k, (), seed, name=name, **kw)
    return attach_totals(df, folds, [key], "group_size", ids).drop("group_size")


def two_level_block_folds(
    df: DataFrame, label: str, k1: int, k23: int, first: str = "bb1", pair: Sequence[str] = ("bb2", "bb3"), seed: object = 42
) -> DataFrame:
    """``(bb1_fold, side, block, fold_idx)``: folds of first blocks, and inside
    each of them folds of the pair blocks over the rows whose first block is
    held out (a row counts once per distinct block)."""
    outer = label_mix_folds(df, first, label, k1, seed=seed, name="bb1_fold")
    held = attach_totals(df.select(first, *pair, label), outer, [first], "group_size", pair)
    blocks = held.withColumn("block", F.explode(F.array_distinct(F.array(*pair))))
    inner = label_mix_folds(blocks, "block", label, k23, ["bb1_fold"], seed)
    return outer.select(
        "bb1_fold", F.lit("bb1").alias("side"), F.col(first).alias("block"), F.col("bb1_fold").alias("fold_idx")
    ).unionByName(inner.select("bb1_fold", F.lit("bb23").alias("side"), "block", "fold_idx"))


# --- chunks, windows and grids ---------------------------------------------

def chunk_of(index: Column, length: Column, n: int) -> Column:
    """Chunk of a position when the first ``length % n`` chunks get one extra."""
    per, extra = F.floor(length / n), length % n
    edge = extra * (per + 1)
    tail = F.when(per > 0, extra + F.floor((index - edge) / per))
    return F.when(index < edge, F.floor(index / (per + 1))).otherwise(tail).cast("int")


def ntile_chunks(df: DataFrame, order: Sequence[str], n: int, name: str = "chunk") -> DataFrame:
    indexed = row_index(df, order, "__i")
    length = indexed.select(F.count(F.lit(1))).scalar()
    return indexed.withColumn(name, chunk_of(F.col("__i"), length, n)).drop("__i")


def cyclic_windows(df: DataFrame, chunk: str, n: int, m: int, cell: str = "cell") -> DataFrame:
    """Each row once per window it belongs to: window j has the chunks
    j, j+1, ... j+m-1 modulo n; ``slot`` is the place inside the window."""
    return df.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn(
        cell, F.pmod(F.col(chunk) - F.col("slot"), F.lit(n)).cast("int")
    )


def shuffled_positions(n: int, seed: object) -> list[int]:
    """Position of each of ``n`` chunks in seeded hash order."""
    def key(i: int) -> tuple[int, int]:
        return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[: HASH_BITS // 4], 16), i

    place = {c: p for p, c in enumerate(sorted(range(n), key=key))}
    return [place[c] for c in range(n)]


def block_grid(
    bb1: DataFrame, bb23: DataFrame, n1: int, n23: int, m1: int, m23: int, seed: object = 42, shuffle: bool = True
) -> DataFrame:
    """``(grid_idx, side, block, expected_rows)`` from two ``(block, chunk)``
    tables: every bb1 window meets every bb23 window."""

    def side(df: DataFrame, name: str, n: int, m: int) -> DataFrame:
        if shuffle:
            place = F.array(*[F.lit(p) for p in shuffled_positions(n, f"{seed}{name}")])
            df = df.withColumn("chunk", place[F.col("chunk")])
        return cyclic_windows(df, "chunk", n, m).select(F.lit(name).alias("side"), "block", "cell")

    # each window is copied into the cells of its grid row or column
    rows = side(bb1, "bb1", n1, m1).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n23 - 1))))
    cols = side(bb23, "bb23", n23, m23).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n1 - 1))))
    cells = rows.select((F.col("cell") * n23 + F.col("other")).alias("grid_idx"), "side", "block").unionByName(
        cols.select((F.col("other") * n23 + F.col("cell")).alias("grid_idx"), "side", "block")
    )
    n_1, n_23 = (F.sum((F.col("side") == s).cast("bigint")) for s in ("bb1", "bb23"))
    expected = cells.groupBy("grid_idx").agg((n_1 * n_23 * (n_23 + 1) / 2).alias("expected_rows"))
    return cells.join(expected, "grid_idx")


# --- staged split -----------------------------------------------------------

def three_stage_split(
    df: DataFrame,
    ids: Sequence[str],
    held: Mapping[str, Iterable[int]],
    scaffold: str,
    size_col: str,
    label: str,
    size_cut: int = SIZE_CUT,
    seed: object = 42,
    train_only: Mapping[str, Iterable[int]] | None = None,
) -> DataFrame:
    """``(ids, label, subset)``: 0 all blocks held out, 1 some block held out, 2
    whole small scaffolds, 3 stratified rows, NULL the rest (train).

    Rows that are neither test nor, with ``train_only``, made of train-only
    blocks are dropped.  Stage sizes depend on the data, so the few columns that
    decide are written once and every stage reads those.  Where the small
    scaffolds have too few rows for even one fold of the second stage, it is
    empty and the third takes its share.
    """
    all_in, any_in = in_sets(held, "all"), in_sets(held, "any")
    open_row = ~any_in if train_only is None else in_sets(train_only, "all")
    staged = df.withColumn("__s1", F.when(all_in, F.lit(0)).when(any_in, F.lit(1)))
    staged = staged.withColumn("__open", open_row).filter("__s1 is not null or __open")
    small = F.col("__open") & F.col(size_col).between(1, size_cut)
    staged = cut_lineage(
        staged.select(*ids, scaffold, label, "__s1", "__open", small.alias("__small"))
    )
    n0, n_open, n_small = staged.agg(
        F.count_if(F.col("__s1") == 0), F.count_if("__open"), F.count_if("__small")
    ).first()

    size2, size23 = round(STAGE2_RATIO * n0), round(STAGE23_RATIO * n0)
    if size2 <= 1:
        raise ValueError("too few fully held-out rows for the second stage")
    k2 = round(1 / (size2 / n_small)) if n_small else 0
    held2 = 0
    if k2:
        folds, loads = group_folds(staged.filter("__small"), scaffold, k2, seed, "__f2")
        held2 = loads[0]
        # sizes of all scaffolds, so that hot ones are found and spread
        totals = staged.groupBy(scaffold).agg(F.count(F.lit(1)).alias("__rows")).join(
            folds.select(scaffold, "__f2"), scaffold, "left"
        )
        staged = attach_totals(staged, totals, [scaffold], "__rows", ids)
        second = F.coalesce(F.col("__small") & (F.col("__f2") == 0), F.lit(False))
    else:
        second = F.lit(False)
    staged = staged.withColumn("__s2", second)

    size3, rest = size23 - held2, n_open - held2
    if size3 <= 1:
        raise ValueError("the second stage already uses the whole test size")
    k3 = round(1 / (size3 / rest))
    staged = staged.withColumn("__left", F.col("__open") & ~F.col("__s2"))
    staged = hash_rank(staged, ids, seed, ["__left", label], "__r3")
    subset = (
        F.when(F.col("__s1").isNotNull(), F.col("__s1"))
        .when(F.col("__s2"), F.lit(2))
        .when(F.col("__r3") % k3 == 0, F.lit(3))
    )
    return staged.select(*ids, label, subset.cast("int").alias("subset"))


def sample_blocks(df: DataFrame, fractions: Mapping[str, float], seed: object = 42) -> DataFrame:
    """``(position, block)``: a random share of the distinct blocks of each
    position (a dictionary, so one value per block)."""
    cells = F.array(*[F.struct(F.lit(c).alias("position"), F.col(c).alias("block")) for c in fractions])
    blocks = df.select(F.inline(cells)).distinct()
    ranked = hash_rank(blocks, ["position", "block"], seed, ["position"], "__rank")
    sizes = blocks.groupBy("position").agg(F.count(F.lit(1)).alias("__n"))
    share = F.create_map(*[F.lit(x) for kv in fractions.items() for x in kv])[F.col("position")]
    return ranked.join(F.broadcast(sizes), "position").filter(
        F.col("__rank") < F.bround(share * F.col("__n"))
    ).select("position", "block")


# --- stages of a strategy ----------------------------------------------------

def select_stage(
    df: DataFrame,
    strategy: str,
    stage: str,
    *,
    index: str = "index",
    blocks: Mapping[str, Iterable[int]] | None = None,
    folds: DataFrame | None = None,
    fold_idx: int = 0,
    train_on_all: bool = False,
    train_rows: DataFrame | None = None,
    val_rows: DataFrame | None = None,
    sample: int | None = None,
    seed: object = 42,
) -> DataFrame:
    """``(index, subset)`` of a training stage.

    ``bb_grid-`` uses the rows of one grid cell for both stages;
    ``nonshare-`` trains on rows without any held-out block and validates on
    rows made of them only; ``nonshare-overfit-`` uses the latter for both;
    ``...kf`` follows a fold table; any other name uses given row tables, where
    validation drops subset 1.
    """
    if stage not in ("train", "val"):
        raise ValueError(f"stage must be train or val, not {stage!r}")
    three = F.lit(3).alias("subset")
    if strategy.startswith("bb_grid-") or strategy.startswith("nonshare-"):
        mode = "all"
        if strategy.startswith("nonshare-") and "overfit-" not in strategy and stage == "train":
            mode = "none"
        out = df.filter(in_sets(blocks, mode)).select(index, three)
    elif "kf" in strategy:
        keep = F.col("fold_idx") == fold_idx
        if stage == "train":
            keep = F.lit(True) if train_on_all else ~keep
        out = folds.filter(keep).select(index, three)
    elif stage == "train":
        out = train_rows.select(index, three)
    else:
        out = val_rows.filter(F.col("subset") != 1).select(index, F.col("subset").cast("int"))
    if stage == "train" and sample is not None:
        out = subsample(out, [index], sample, seed)
    return out


def complement_split(df: DataFrame, val: DataFrame, index: str = "index", subsets: Sequence[int] = (2, 3)) -> DataFrame:
    """Train rows: all indices but those validated in ``subsets``."""
    return keep_keys(df.select(index), val.filter(F.col("subset").isin(list(subsets))), [index], inside=False)


def fold_report(
    df: DataFrame, label: str, fold: str = "fold_idx", targets: Sequence[str] = TARGETS, labels: Sequence[int] = tuple(range(8))
) -> DataFrame:
    """Size, label histogram and positive rate per fold."""
    return df.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(label) == v).alias(f"label_{v}") for v in labels],
        *[F.avg(t).alias(f"rate_{t}") for t in targets],
    )
