"""Similarity of bit vectors held as arrays of words."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from combisieve.functions.exprs import let
from combisieve.operators.features import popcount
from combisieve.operators.joins import keep_keys
from combisieve.operators.skew import fits, spread_join
from combisieve.session import cut_lineage

WORD_BITS = 32
CELL_ROWS = 4_000
BROADCAST_VECTORS = 20_000
GRID_ROWS = 2_048
#: Rows of the blocks that are compared pair by pair, and blocks of a table.
BLOCK_ROWS, MOST_BLOCKS = (512, 16_384), 1_000
#: Pairs that are looked at, and found pairs that are handed on, at a time.
SLICE_PAIRS, BATCH_PAIRS = 1 << 18, 1 << 19
#: What a row of the lists of bits and one of their join cost, in pairs of
#: 64-bit words that are compared in a block meanwhile.
LIST_COST, JOIN_COST = 500, 64
#: Thresholds at which neighbours are looked for, one after the other.
LEVELS = (0.8, 0.5, 0.25)
PROBES = 1_024
METRICS = ("tanimoto", "dice", "cosine", "tversky")


def _weights(metric: str, alpha: float, beta: float) -> tuple[float, float]:
    """Tanimoto and Dice are Tversky with weights 1 and 1/2."""
    return {"tanimoto": (1.0, 1.0), "dice": (0.5, 0.5), "tversky": (alpha, beta)}[metric]


def similarity_of(common, a, b, metric: str = "tanimoto", alpha: float = 0.5, beta: float = 0.5, sqrt=F.sqrt):
    """Similarity from set sizes and their overlap; Columns or NumPy arrays."""
    if metric == "cosine":
        return common / sqrt(a * b)
    if metric == "tanimoto":
        return common / (a + b - common)
    if metric == "dice":
        return common * 2.0 / (a + b)
    return common / (common + alpha * (a - common) + beta * (b - common))


def common_bits(left: Column | str, right: Column | str) -> Column:
    left, right = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    return popcount(F.zip_with(left, right, lambda x, y: x.bitwiseAND(y)))


def distinct_vectors(df: DataFrame, id_col: str, words: str) -> DataFrame:
    """``(id, last_id, copies, words)``: equal vectors once, under their lowest
    id, so that many copies of one vector do not pair with each other."""
    return df.groupBy(F.col(words).alias("words")).agg(
        F.min(id_col).alias("id"), F.max(id_col).alias("last_id"), F.count(F.lit(1)).alias("copies")
    )


def least_common(a: np.ndarray, b: np.ndarray, threshold: float, metric: str, alpha: float, beta: float) -> np.ndarray:
    """The least overlap with which sets of sizes a and b can reach the threshold."""
    if metric == "cosine":
        need = threshold * np.sqrt(a * b)
    else:
        wa, wb = _weights(metric, alpha, beta)
        need = threshold * (wa * a + wb * b) / (1 - threshold + threshold * (wa + wb))
    return np.maximum(1, np.ceil(need - 1e-9))


def size_bounds(n_bits: int, threshold: float, metric: str, alpha: float, beta: float) -> list[tuple]:
    """Per set size: lowest and highest partner size that can reach the
    threshold and the least overlap any of them needs, for either side."""
    sizes = np.arange(1, n_bits + 1, dtype=float)
    a, b = sizes[:, None], sizes[None, :]
    need = least_common(a, b, threshold, metric, alpha, beta)
    possible = need <= np.minimum(a, b)

    def side(ok: np.ndarray, least: np.ndarray) -> list[tuple[int, int, int]]:
        out = []
        for i in range(n_bits):
            hits = np.flatnonzero(ok[i])
            out.append((int(hits[0]) + 1, int(hits[-1]) + 1, int(least[i, hits].min())) if len(hits) else (1, 0, 0))
        return out

    ratio = max(1.1, 1 / threshold)
    band = [int(math.log(s, ratio) + 1e-9) for s in range(1, n_bits + 1)]
    return [
        (i + 1, band[i], *left, band[left[0] - 1], band[max(left[1], 1) - 1], *right)
        for i, (left, right) in enumerate(zip(side(possible, need), side(possible.T, need.T)))
    ]


def _ranked(vectors: DataFrame, rank: Column, bounds: DataFrame, side: str) -> DataFrame:
    """Sorted bit ranks (rarest first) cut to the prefix that must contain a
    common bit with every partner."""
    def ranks(words: Column) -> Column:
        bits = F.flatten(F.transform(words, lambda w, i: F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda j: F.when(
                w.bitwiseAND(F.pow(F.lit(2.0), j).cast("bigint")) != 0, i * WORD_BITS + j
            )), lambda x: x.isNotNull())))
        return F.array_sort(F.transform(bits, lambda b: F.get(rank, b)))

    lo, hi, need = f"{side}_lo", f"{side}_hi", f"{side}_need"
    sized = vectors.withColumn("size", popcount("words")).join(F.broadcast(bounds), "size")
    prefix = F.slice(let(F.col("words"), ranks), F.lit(1), F.col("size") - F.col(need) + 1)
    return sized.filter(F.col(lo) <= F.col(hi)).select(
        F.col("id").alias(f"{side}_id"), F.col("size").alias(f"{side}_size"), lo, hi, "band", "band_lo", "band_hi",
        F.posexplode(prefix).alias(f"{side}_pos", "bit"),
    )


def _attach_vectors(pairs: DataFrame, vectors: DataFrame, side: str) -> DataFrame:
    """Words of one side; a vector with very many candidates is spread."""
    right = vectors.select(
        F.col("id").alias(f"{side}_id"), F.col("words").alias(f"{side}_words"), F.col("copies").alias(f"{side}_copies")
    )
    if fits(vectors, BROADCAST_VECTORS):
        return pairs.join(F.broadcast(right), f"{side}_id")
    return spread_join(pairs, right, [f"{side}_id"], "inner", ["l_id", "r_id"])


def similarity_pairs(
    left: DataFrame,
    right: DataFrame | None = None,
    *,
    threshold: float,
    id_col: str = "id",
    words: str = "words",
    n_bits: int = 2048,
    metric: str = "tanimoto",
    alpha: float = 0.5,
    beta: float = 0.5,
) -> DataFrame:
    """``(left_id, right_id, similarity, left_copies, right_copies)`` of all
    pairs of distinct vectors that reach a positive threshold; within one table
    when ``right`` is missing (lower id on the left).

    Exact and without a product of the tables: two vectors that reach the
    threshold share one of their rarest bits, so those bits are the join key.
    Partner sizes are bounded, which splits a bit's list into bands, and a list
    longer than ``CELL_ROWS`` is cut into a grid of cells.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    # read several times below: written once instead of rebuilding the vectors
    lv = cut_lineage(distinct_vectors(left, id_col, words))
    rv = lv if right is None else cut_lineage(distinct_vectors(right, id_col, words))
    return _pairs(lv, rv, right is None, threshold, n_bits, metric, alpha, beta)


def similarity_pairs_of(
    left: DataFrame, right: DataFrame, threshold: float, n_bits: int, metric: str = "tanimoto", alpha: float = 0.5, beta: float = 0.5
) -> DataFrame:
    """``similarity_pairs`` of two tables that ``distinct_vectors`` made."""
    return _pairs(left, right, False, threshold, n_bits, metric, alpha, beta)


def _pairs(
    lv: DataFrame, rv: DataFrame, one_table: bool, threshold: float, n_bits: int, metric: str, alpha: float, beta: float
) -> DataFrame:
    """By the lists of bits or, where those are longer than what they save, block by block."""
    sizes = [_sizes(lv, n_bits)]
    sizes.append(sizes[0] if one_table else _sizes(rv, n_bits))
    found = _candidates(lv, rv, one_table, threshold, n_bits, metric, alpha, beta, sizes)
    if found is None:
        return _block_pairs(lv, rv, one_table, threshold, n_bits, metric, alpha, beta, sizes)
    return _scored(found, lv, rv, threshold, metric, alpha, beta)


def _sizes(vectors: DataFrame, n_bits: int) -> dict[int, int] | None:
    """Vectors per size, those without a bit left out (at most ``n_bits`` numbers);
    None where they are not all words of 32 bits in one number."""
    whole = (F.size("words") * WORD_BITS == n_bits) & F.forall("words", lambda w: F.coalesce(w.between(0, 2**WORD_BITS - 1), F.lit(False)))
    rows = vectors.filter("id is not null and words is not null").groupBy(popcount("words").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("whole")
    ).collect()
    return {r["size"]: r["n"] for r in rows if r["size"]} if all(r["n"] == r["whole"] for r in rows) else None


def _n_pairs(sizes: Sequence[dict[int, int]], one_table: bool) -> int:
    left, right = (sum(x.values()) for x in sizes)
    return left * (left - 1) // 2 if one_table else left * right


def _candidates(
    lv: DataFrame, rv: DataFrame, one_table: bool, threshold: float, n_bits: int, metric: str, alpha: float, beta: float,
    sizes: Sequence[dict[int, int] | None],
) -> DataFrame | None:
    """``(l_id, r_id, l_size, r_size)``: pairs of distinct vectors that may reach
    the threshold; None where the lists cost more than to compare all pairs."""
    spark = lv.sparkSession
    table = size_bounds(n_bits, threshold, metric, alpha, beta)
    worth = None
    if None not in sizes:
        worth = _n_pairs(sizes, one_table) * -(-n_bits // (2 * WORD_BITS))
        rows = sum(
            sizes[0].get(n, 0) * max(0, n - l_need + 1) * (last - first + 1) * (l_lo <= l_hi) + sizes[1].get(n, 0) * max(0, n - r_need + 1) * (r_lo <= r_hi)
            for n, _, l_lo, l_hi, l_need, first, last, r_lo, r_hi, r_need in table
        )
        if rows * LIST_COST > worth:
            return None
    # frequency per bit: at most n_bits numbers
    places = F.sequence(F.lit(0), F.lit(n_bits - 1))
    on = F.filter(places, lambda p: F.get("words", F.floor(p / WORD_BITS).cast("int")).bitwiseAND(
        F.pow(F.lit(2.0), p % WORD_BITS).cast("bigint")) != 0)
    freq = dict(rv.select(F.explode(on).alias("b")).groupBy("b").count().collect())
    order = sorted(range(n_bits), key=lambda b: (freq.get(b, 0), b))
    place = {b: r for r, b in enumerate(order)}
    rank = F.array(*[F.lit(place[b]) for b in range(n_bits)])
    bounds = spark.createDataFrame(
        table,
        "size int, band int, l_lo int, l_hi int, l_need int, band_lo int, band_hi int, r_lo int, r_hi int, r_need int",
    )

    # the lists of bits are made once, then read for the cells and for the join
    lp = cut_lineage(_ranked(lv, rank, bounds, "l").withColumn("band", F.explode(F.sequence("band_lo", "band_hi"))).drop("band_lo", "band_hi"))
    rp = cut_lineage(_ranked(rv, rank, bounds, "r").drop("band_lo", "band_hi", "r_lo", "r_hi"))
    # at most n_bits * n_bands rows each: how many parts a list is cut into
    lc, rc = (df.groupBy("bit", "band").agg(F.count(F.lit(1)).alias(n)) for df, n in ((lp, "l_n"), (rp, "r_n")))
    both = lc.join(rc, ["bit", "band"])
    if worth is not None and (both.agg(F.sum(F.col("l_n").cast("decimal(38,0)") * F.col("r_n"))).first()[0] or 0) * JOIN_COST > worth:
        return None
    parts = [F.ceil(F.col(f"{side}_n") / CELL_ROWS).cast("int").alias(f"{side}_parts") for side in "lr"]
    cells = F.broadcast(both.select("bit", "band", *parts))
    lp = lp.join(cells, ["bit", "band"]).withColumns({
        "l_part": F.pmod(F.xxhash64("l_id"), F.col("l_parts")),
        "r_part": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("r_parts").cast("bigint") - 1)),
    }).drop("l_parts", "r_parts")
    rp = rp.join(cells, ["bit", "band"]).withColumns({
        "r_part": F.pmod(F.xxhash64("r_id"), F.col("r_parts")),
        "l_part": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("l_parts").cast("bigint") - 1)),
    }).drop("l_parts", "r_parts")

    pairs = lp.join(rp, ["bit", "band", "l_part", "r_part"])
    keep = F.col("r_size").between(F.col("l_lo"), F.col("l_hi"))
    if one_table:
        keep = keep & (F.col("l_id") < F.col("r_id"))
    # at their first common bit two vectors share at most what is left of either
    most = F.least(F.col("l_size") - F.col("l_pos"), F.col("r_size") - F.col("r_pos"))
    keep = keep & (similarity_of(most, F.col("l_size"), F.col("r_size"), metric, alpha, beta) >= F.lit(threshold - 1e-9))
    # only ids travel until the candidates are distinct
    return pairs.filter(keep).select("l_id", "r_id", "l_size", "r_size").distinct()


def _scored(
    found: DataFrame, lv: DataFrame, rv: DataFrame, threshold: float, metric: str, alpha: float, beta: float
) -> DataFrame:
    """Similarity of candidates, those that reach the threshold."""
    full = _attach_vectors(_attach_vectors(found, lv, "l"), rv, "r")
    sim = similarity_of(common_bits("l_words", "r_words"), F.col("l_size"), F.col("r_size"), metric, alpha, beta)
    return full.select(
        F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), sim.alias("similarity"),
        F.col("l_copies").alias("left_copies"), F.col("r_copies").alias("right_copies"),
    ).filter(F.col("similarity") >= F.lit(threshold))


def _by_size(sizes: dict[int, int], block_rows: int) -> list[tuple[int, int, int, int]]:
    """``(first block, blocks, lowest, highest size)`` of runs of sizes: small
    sizes together, those of one large size dealt to several blocks."""
    runs, held = [], 0
    for size, n in sorted(sizes.items()):
        if not runs or held + n > block_rows:
            runs.append([size, size, 0])
            held = 0
        held += n
        runs[-1][1:] = size, held
    out, at = [], 0
    for low, high, n in runs:
        parts = -(-n // block_rows)
        out.append((at, parts, low, high))
        at += parts
    return out


def _block_pairs(
    lv: DataFrame, rv: DataFrame, one_table: bool, threshold: float, n_bits: int, metric: str, alpha: float, beta: float,
    sizes: Sequence[dict[int, int]],
) -> DataFrame:
    """``_scored`` of all pairs: both tables in blocks of near sizes, each block
    with those whose sizes can reach the threshold.  A task holds the vectors of
    two blocks and hands on what it finds in batches."""
    spark = lv.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a few cells for each task
    side = math.ceil(math.sqrt(4 * parts))
    runs = []
    for x in sizes:
        n = sum(x.values())
        rows = max(BLOCK_ROWS[0], min(BLOCK_ROWS[1], -(-n // side)), -(-n // MOST_BLOCKS))
        runs.append(_by_size(x, rows))
    bounds = {b[0]: b for b in size_bounds(n_bits, threshold, metric, alpha, beta)}
    # per run of the left the blocks of the right that it meets, and the other way
    meets: list[list[tuple]] = [[], []]
    for k, (mine, other) in enumerate((runs, runs[::-1])):
        for at, n, low, high in mine:
            reach = [bounds[x][2 + 5 * k : 4 + 5 * k] for x in range(low, high + 1) if x in sizes[k]]
            reach = [(lo, hi) for lo, hi in reach if lo <= hi]
            met = [r for r in other if reach and r[2] <= max(hi for _, hi in reach) and r[3] >= min(lo for lo, _ in reach)]
            if met:
                first, last = met[0][0], met[-1][0] + met[-1][1] - 1
                meets[k] += [(x, at, n, first, last) for x in range(low, high + 1) if x in sizes[k]]
    half = one_table and metric != "tversky"
    blocks = [sum(r[1] for r in run) for run in runs]

    def copies(df: DataFrame, k: int) -> DataFrame:
        table = spark.createDataFrame(meets[k], "size int, at int, n int, first int, last int")
        block = F.col("at") + F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
        placed = df.filter("id is not null").withColumn("size", popcount("words")).join(F.broadcast(table), "size").withColumn("block", block)
        if half:
            placed = placed.withColumns({"first": F.greatest("first", "block")} if k == 0 else {"last": F.least("last", "block")})
        placed = placed.filter("first <= last").withColumn("other", F.explode(F.sequence("first", "last")))
        cell = F.col("block") * F.lit(blocks[1]) + F.col("other") if k == 0 else F.col("other") * F.lit(blocks[1]) + F.col("block")
        return placed.select(cell.cast("bigint").alias("cell"), F.lit(k).alias("side"), F.struct("id").alias("who"), "words", F.col("copies").cast("bigint").alias("copies"))

    kinds = [df.schema["id"].dataType.simpleString() for df in (lv, rv)]
    schema = f"left_id {kinds[0]}, right_id {kinds[1]}, similarity double, left_copies bigint, right_copies bigint"
    if not meets[0] or not meets[1]:
        return spark.createDataFrame([], schema)
    both = [copies(df, k) for k, df in enumerate((lv, rv))]
    both = [df.select("cell", "side", *[(F.col("who.id") if i == k else F.lit(None).cast(kinds[i])).alias(n) for i, n in enumerate(("l_id", "r_id"))], "words", "copies") for k, df in enumerate(both)]
    tasks = max(parts, min(blocks[0] * blocks[1] // (2 if half else 1), 4 * MOST_BLOCKS))
    cells = both[0].unionByName(both[1]).repartition(tasks, "cell").sortWithinPartitions("cell", "side")
    names = ["left_id", "right_id", "similarity", "left_copies", "right_copies"]

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        of = rows["side"].to_numpy()
        sides = [rows.filter(pa.array(of == k)) for k in (0, 1)]
        if not sides[0].num_rows or not sides[1].num_rows:
            return
        a, b = (packed(pc.list_flatten(t["words"]).to_numpy().reshape(t.num_rows, -1)) for t in sides)
        ids = [t[n].combine_chunks() for t, n in zip(sides, ("l_id", "r_id"))]
        n_of = [t["copies"].to_numpy() for t in sides]
        na, nb = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
        (ua, ia), (ub, ib) = (np.unique(x, return_inverse=True) for x in (na, nb))
        need = least_common(ua[:, None].astype(float), ub[None, :].astype(float), threshold, metric, alpha, beta).astype(np.uint32)
        b = np.ascontiguousarray(b.T)
        inside = one_table and (not half or rows["cell"][0].as_py() % (blocks[1] + 1) == 0)
        held: list[tuple] = []

        def told() -> pa.RecordBatch:
            i, j, sim = (np.concatenate(x) for x in zip(*held))
            held.clear()
            left, right = ids[0].take(pa.array(i)), ids[1].take(pa.array(j))
            cols = [left, right, pa.array(sim), pa.array(n_of[0][i]), pa.array(n_of[1][j])]
            if half:
                first = pc.less(left, right)
                cols[0], cols[1], cols[3], cols[4] = (pc.if_else(first, cols[x], cols[y]) for x, y in ((0, 1), (1, 0), (3, 4), (4, 3)))
            out = pa.RecordBatch.from_arrays(cols, names)
            return out.filter((pc.less if inside else pc.not_equal)(left, right)) if one_table else out

        step = max(1, SLICE_PAIRS // b.shape[1])
        for at in range(0, len(a), step):
            part = slice(at, at + step)
            common = common_matrix(a[part], b)
            i, j = np.nonzero(common >= need[ia[part]][:, ib])
            sim = similarity_of(common[i, j].astype(float), na[part][i].astype(float), nb[j].astype(float), metric, alpha, beta, np.sqrt)
            ok = sim >= threshold
            held.append((i[ok] + at, j[ok], sim[ok]))
            if sum(len(x[0]) for x in held) >= BATCH_PAIRS:
                yield told()
        if held:
            yield told()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_cell, held = None, []
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for at, end in zip(edges, edges[1:]):
                if at == end:
                    continue
                if held and cell[at] != open_cell:
                    yield from compare(pa.Table.from_batches(held))
                    held = []
                open_cell = cell[at]
                held.append(batch.slice(at, end - at))
        if held:
            yield from compare(pa.Table.from_batches(held))

    return cells.mapInArrow(run, schema)


def compare_blocks(queries: DataFrame, targets: DataFrame, schema: str, reduce_cell) -> tuple[DataFrame, DataFrame]:
    """Run ``reduce_cell(queries, targets)`` over a grid of blocks of bounded size
    for each ``cls`` of ``(id, words, cls)``; only reduced rows come out.  A row
    is copied to the blocks of the other side in its own class.  Also the rows of
    each side by class (``cls``, ``q_n``, ``t_n``)."""
    sides = [df.groupBy("cls").agg(F.count(F.lit(1)).alias(n)) for df, n in ((queries, "q_n"), (targets, "t_n"))]
    # a class is an interval of sizes: few rows
    cells = cut_lineage(sides[0].join(sides[1], "cls"))
    parts = F.broadcast(cells.select("cls", *[F.ceil(F.col(n) / GRID_ROWS).cast("int").alias(n) for n in ("q_n", "t_n")]))

    def blocks(df: DataFrame, mine: str, n: str, other: str, m: str) -> DataFrame:
        return df.join(parts, "cls").select(
            *df.columns, F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other),
        )

    q, t = blocks(queries, "qb", "q_n", "tb", "t_n"), blocks(targets, "tb", "t_n", "qb", "q_n")
    return q.groupBy("cls", "qb", "tb").cogroup(t.groupBy("cls", "qb", "tb")).applyInPandas(reduce_cell, schema), cells


def packed(words: np.ndarray) -> np.ndarray:
    """Rows of 32-bit words, two of them in one number where that is all they are."""
    words = words.astype(np.uint64)
    if words.size and int(words.max()) < 2**WORD_BITS:
        if words.shape[1] % 2:
            words = np.concatenate([words, np.zeros((len(words), 1), np.uint64)], axis=1)
        return words[:, ::2] | words[:, 1::2] << np.uint64(WORD_BITS)
    return words


def common_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bits of the rows of ``a`` and the columns of ``b``."""
    common = np.zeros((len(a), b.shape[1]), np.uint16 if 64 * len(b) < 2**16 else np.uint32)
    for w in range(len(b)):
        common += np.bitwise_count(a[:, w][:, None] & b[w][None, :])
    return common


def similarity_matrix(q: pd.DataFrame, t: pd.DataFrame, metric: str, alpha: float = 0.5, beta: float = 0.5) -> np.ndarray:
    a, b = (np.stack(x["words"].to_numpy()).astype(np.uint64) for x in (q, t))
    width = a.shape[1]
    both = packed(np.concatenate([a, b]))
    a, b = both[: len(a)], both[len(a) :]
    common = common_matrix(a, np.ascontiguousarray(b.T)).astype(float) if width else np.zeros((len(a), len(b)))
    na = np.bitwise_count(a).sum(axis=1).astype(float)[:, None]
    nb = np.bitwise_count(b).sum(axis=1).astype(float)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = similarity_of(common, na, nb, metric, alpha, beta, np.sqrt)
    return np.nan_to_num(sim, nan=0.0)


def _width(*frames: DataFrame) -> int:
    """Bits of the widest vector of the tables."""
    return WORD_BITS * max(df.agg(F.max(F.size("words"))).first()[0] or 0 for df in frames)


def _compared(report: list | None, stage: str, pairs: int) -> None:
    if report is not None:
        report.append((stage, pairs))


def _near_vectors(
    qv: DataFrame, tv: DataFrame, want: int, metric: str, alpha: float, beta: float, levels: Sequence[float], report: list | None
) -> DataFrame:
    """``(left_id, right_id, similarity)``: per distinct query vector the first
    ``want`` distinct target vectors by (similarity, lowest id).

    The threshold falls from level to level.  A query whose targets at a level
    have ``want`` rows is done, since all pairs of the level are known; only the
    others go on.  What is left after the last level, or where the lists of a
    level would give more rows than there are pairs, is compared block by block.
    """
    def first(pairs: DataFrame) -> DataFrame:
        # Spark cuts each task's rows to ``want`` per query before the shuffle
        rank = F.row_number().over(W.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id"))
        return pairs.withColumn("__r", rank).filter(F.col("__r") <= want).select("left_id", "right_id", "similarity")

    n_bits, left, parts = _width(qv, tv), qv, []
    targets = _sizes(tv, n_bits)
    for level in levels:
        found = _candidates(left, tv, False, level, n_bits, metric, alpha, beta, [_sizes(left, n_bits), targets])
        if found is None:
            break
        found = cut_lineage(found)
        if report is not None:
            _compared(report, f"level {level}", found.count())
        pairs = cut_lineage(_scored(found, left, tv, level, metric, alpha, beta))
        rows = pairs.groupBy("left_id").agg(F.sum("right_copies").alias("n"))
        done = cut_lineage(rows.filter(F.col("n") >= want).select(F.col("left_id").alias("id")))
        parts.append(first(keep_keys(pairs, done.withColumnRenamed("id", "left_id"), ["left_id"])))
        left = cut_lineage(keep_keys(left, done, ["id"], inside=False))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, parts)

    def cell(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"left_id": [], "right_id": [], "similarity": []})
        t = t.sort_values("id")
        sim = similarity_matrix(q, t, metric, alpha, beta)
        best = np.argsort(-sim, axis=1, kind="stable")[:, :want]
        return pd.DataFrame({
            "left_id": np.repeat(q["id"].to_numpy(), best.shape[1]),
            "right_id": t["id"].to_numpy()[best].ravel(),
            "similarity": np.take_along_axis(sim, best, axis=1).ravel(),
        })

    kinds = [df.schema["id"].dataType.simpleString() for df in (qv, tv)]
    whole = [df.select("id", "words", F.lit(0).alias("cls")) for df in (left, tv)]
    rest, cells = compare_blocks(*whole, f"left_id {kinds[0]}, right_id {kinds[1]}, similarity double", cell)
    if report is not None:
        _compared(report, "blocks", cells.agg(F.coalesce(F.sum(F.col("q_n") * F.col("t_n")), F.lit(0))).first()[0])
    return reduce(DataFrame.unionByName, [*parts, first(rest)])


def nearest(
    queries: DataFrame, targets: DataFrame, k: int, id_col: str = "id", words: str = "words", metric: str = "tanimoto",
    alpha: float = 0.5, beta: float = 0.5, exclude_self: bool = False, levels: Sequence[float] = LEVELS, report: list | None = None,
) -> DataFrame:
    """``(query_id, rank, target_id, similarity)``: the k most similar targets,
    ties by target id; ``exclude_self`` leaves out the target with the query's id.

    Exact: ``levels`` only decide how many pairs are looked at.  ``report``
    collects ``(stage, pairs compared)``.  Rows without a vector take no part.
    """
    want = k + exclude_self
    # read for the vectors and for their ids: written once instead of making the vectors again
    queries, targets = (
        cut_lineage(df.select(F.col(id_col).alias("id"), F.col(words).alias("words")).filter("words is not null")) for df in (queries, targets)
    )
    qv, tv = (cut_lineage(distinct_vectors(df, "id", "words")) for df in (queries, targets))
    if not _width(qv, tv) or tv.isEmpty():
        kinds = [df.schema["id"].dataType.simpleString() for df in (queries, targets)]
        return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, rank int, target_id {kinds[1]}, similarity double")
    near = _near_vectors(qv, tv, want, metric, alpha, beta, levels, report)
    # the lowest ids of each target vector: no more than ``want`` can be called for
    number = F.row_number().over(W.partitionBy("words").orderBy("id"))
    lowest = targets.withColumn("__r", number).filter(F.col("__r") <= want).groupBy("words").agg(
        F.min("id").alias("right_id"), F.collect_list("id").alias("ids")
    )
    each = spread_join(near, lowest.select("right_id", "ids"), ["right_id"], "inner", ["left_id"]).select(
        "left_id", "similarity", F.explode("ids").alias("target_id")
    )
    place = F.row_number().over(W.partitionBy("left_id").orderBy(F.desc("similarity"), "target_id"))
    listed = each.withColumn("__r", place).filter(F.col("__r") <= want).groupBy("left_id").agg(
        F.array_sort(F.collect_list(F.struct("__r", "target_id", "similarity"))).alias("near")
    )
    by_vector = qv.join(listed, qv["id"] == listed["left_id"]).select("words", "near")
    near = F.col("near")
    if exclude_self:
        near = F.filter(near, lambda x: x["target_id"] != F.col("id"))
    out = spread_join(queries, by_vector, ["words"], "inner", ["id"]).select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(near, 1, k)).alias("__p", "x")
    )
    return out.select("query_id", (F.col("__p") + 1).alias("rank"), F.col("x.target_id").alias("target_id"), F.col("x.similarity").alias("similarity"))


def _size_classes(tv: DataFrame) -> list[tuple[int, int]]:
    """``(lowest, highest)`` size of classes of targets, small sizes together.
    The driver sees one row per size."""
    sizes = tv.groupBy(popcount("words").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()
    classes, held = [], 0
    for r in sizes:
        if not classes or held >= GRID_ROWS:
            classes.append((r["size"], r["size"]))
            held = 0
        classes[-1] = (classes[-1][0], r["size"])
        held += r["n"]
    return classes


def _farthest(qv: DataFrame, tv: DataFrame, metric: str, alpha: float, beta: float, report: list | None) -> DataFrame:
    """``(id, worst)``: the lowest similarity of each distinct query vector.

    First against ``PROBES`` targets with the fewest bits and as many others: a
    query with nothing in common with one of them is done.  Two vectors of a and
    b bits out of n share at least a + b - n, so the rest only meet the classes
    of sizes that can go below what they have.
    """
    n_bits, classes = _width(qv, tv), _size_classes(tv)
    sized = tv.select("id", "words", popcount("words").alias("size"))
    probes = [
        r["words"] for order in (["size", "id"], [F.xxhash64("id"), "id"]) for r in sized.orderBy(*order).limit(PROBES).select("words").collect()
    ]
    _compared(report, "probes", 0 if report is None else qv.count() * len(probes))
    low = np.array([c[0] for c in classes], float)
    found = pd.DataFrame({"words": probes})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q in batches:
            if q.empty:
                continue
            worst = similarity_matrix(q, found, metric, alpha, beta).min(axis=1)
            bits = np.bitwise_count(np.stack(q["words"].to_numpy()).astype(np.uint64)).sum(axis=1).astype(float)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                least = similarity_of(np.maximum(0.0, bits + low[None, :] - n_bits), bits, low[None, :], metric, alpha, beta, np.sqrt)
            open_to = np.nan_to_num(least, nan=0.0) < worst[:, None]
            yield pd.DataFrame({"id": q["id"], "words": q["words"], "worst": worst, "classes": [np.flatnonzero(x).tolist() for x in open_to]})

    kind = qv.schema["id"].dataType.simpleString()
    seen = cut_lineage(qv.select("id", "words").mapInPandas(probe, f"id {kind}, words array<bigint>, worst double, classes array<int>"))
    rest = seen.filter("worst > 0").select("id", "words", F.explode("classes").alias("cls"))
    class_of = F.array_position(F.transform(F.array(*[F.lit(c[1]) for c in classes]), lambda top: F.col("size") <= top), True) - 1

    def cell(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"id": [], "worst": []})
        return pd.DataFrame({"id": q["id"].to_numpy(), "worst": similarity_matrix(q, t, metric, alpha, beta).min(axis=1)})

    more, cells = compare_blocks(rest, sized.select("id", "words", class_of.cast("int").alias("cls")), f"id {kind}, worst double", cell)
    if report is not None:
        _compared(report, "classes", cells.agg(F.coalesce(F.sum(F.col("q_n") * F.col("t_n")), F.lit(0))).first()[0])
    return seen.select("id", "worst").unionByName(more).groupBy("id").agg(F.min("worst").alias("worst"))


def similarity_summary(
    queries: DataFrame, targets: DataFrame, id_col: str = "id", words: str = "words",
    metric: str = "tanimoto", alpha: float = 0.5, beta: float = 0.5, report: list | None = None,
) -> DataFrame:
    """``(query_id, best, worst, spread)`` over all targets.

    Queries with equal vectors are looked up once.  ``report`` collects
    ``(stage, pairs compared)``.  Rows without a vector take no part, and without
    targets there is no row.
    """
    queries, targets = (df.select(F.col(id_col).alias("id"), F.col(words).alias("words")).filter("words is not null") for df in (queries, targets))
    qv, tv = (cut_lineage(distinct_vectors(df, "id", "words")) for df in (queries, targets))
    if tv.isEmpty():
        return queries.limit(0).select(F.col("id").alias("query_id"), *[F.lit(0.0).alias(c) for c in ("best", "worst", "spread")])
    best = _near_vectors(qv, tv, 1, metric, alpha, beta, LEVELS, report).select(F.col("left_id").alias("id"), F.col("similarity").alias("best"))
    both = qv.select("id", "words").join(best, "id").join(_farthest(qv, tv, metric, alpha, beta, report), "id").select("words", "best", "worst")
    out = spread_join(queries, both, ["words"], "inner", ["id"])
    out = out.groupBy(F.col("id").alias("query_id")).agg(F.max("best").alias("best"), F.min("worst").alias("worst"))
    return out.withColumn("spread", F.col("best") - F.col("worst"))
