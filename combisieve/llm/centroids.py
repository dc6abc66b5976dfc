"""Clusters of integer vectors around centroids, by a tournament of bisectors.

Between centroids ``i < j`` lies a bisector with the normal ``2 (c_j - c_i)`` and
the threshold ``|c_j|^2 - |c_i|^2``: ``j`` is nearer to ``x`` exactly where ``x``
times the normal exceeds the threshold.  ``k - 1`` such tests leave one winner;
the two sides of a test are always blocks of lower and of higher numbers, so
that equality goes to the smaller number.  All numbers are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combisieve.llm.columns import array_udf

SCALE = 64
ROWS = 4096  # vectors that are tested at once
#: Components below this keep all products and sums of a test within 64 bits.
SMALL = 1 << 26
MAX_SMALL_WIDTH = 128
LIMB = 40
MAX_LONG = 2**63 - 1
_COUNT, _DISTANCE = -1, -2


class Clusters(NamedTuple):
    #: final centroids, and the sum of squared distances of each one's vectors
    centroids: list[list[int]]
    inertia: list[int]


def is_kept(vector: Column, width: int) -> Column:
    """Exactly ``width`` components, none NULL or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce((F.size(vector) == width) & fine, F.lit(False))


def integers(values: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``: int64 where all are small, else Python integers."""
    scaled = np.floor(values * SCALE)
    if values.shape[1] <= MAX_SMALL_WIDTH and (not scaled.size or np.abs(scaled).max() < SMALL):
        return scaled.astype(np.int64)
    # doubles from 2**53 on are integers; their multiple may be beyond doubles
    whole = [[math.floor(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in row] for row in values.tolist()]
    return np.array(whole, object).reshape(values.shape)


def vectors(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, integer matrix)`` of the vectors of a batch that are kept."""
    n = len(column)
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    rows = np.flatnonzero(lengths == width)
    for a in range(0, len(rows), ROWS):
        own = rows[a : a + ROWS]
        values = flat[starts[own][:, None] + np.arange(width)]
        fine = np.isfinite(values).all(1)
        if n and fine.any():
            yield own[fine], integers(values[fine])


class Bisectors:
    """Normals and thresholds between all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]) -> None:
        c = np.array(centroids, object)
        self.small = c.shape[1] <= MAX_SMALL_WIDTH and max(map(abs, c.reshape(-1))) < SMALL
        square = (c * c).sum(1)
        self.tables = {object: (c, 2 * (c[None, :] - c[:, None]), square[None, :] - square[:, None])}
        if self.small:
            self.tables[np.int64] = tuple(t.astype(np.int64) for t in self.tables[object])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row of ``x``, and the squared distance."""
        kind = np.int64 if self.small and x.dtype == np.int64 else object
        c, normal, threshold = self.tables[kind]
        x = x.astype(kind)
        sides = [np.full(len(x), i) for i in range(len(c))]
        while len(sides) > 1:
            winners = []
            for low, high in zip(sides[::2], sides[1::2], strict=False):
                above = (x * normal[low, high]).sum(1) > threshold[low, high]
                winners.append(np.where(above.astype(bool), high, low))
            sides = winners + sides[len(winners) * 2 :]
        gap = x - c[sides[0]]
        return sides[0], (gap * gap).sum(1)


def _limbs(cluster: int, what: int, total: int) -> Iterator[tuple[int, int, int, int]]:
    """An integer of any size as rows that can be summed apart."""
    sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
    while rest or not limb:
        yield cluster, what, limb, sign * (rest & ((1 << LIMB) - 1))
        rest, limb = rest >> LIMB, limb + 1


def _totals(df: DataFrame, vector: Column, width: int, centroids: list[list[int]]) -> dict[tuple[int, int], int]:
    """Sums by cluster over its vectors: of each component, of distances, and
    their count.  A batch tells one row per sum; the driver gets as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bisectors(centroids)
        for batch in batches:
            sums: dict[tuple[int, int], int] = {}
            for _, x in vectors(batch.column(0), width):
                cluster, distance = own.nearest(x)
                for c in np.unique(cluster).tolist():
                    at = cluster == c
                    told = [(_COUNT, int(at.sum())), (_DISTANCE, sum(distance[at].tolist())), *enumerate(x[at].sum(0).tolist())]
                    for what, total in told:
                        sums[c, what] = sums.get((c, what), 0) + total
            rows = [row for (c, what), total in sums.items() for row in _limbs(c, what, total)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "what", "limb", "value"]
            )

    told = df.select(vector.alias("x")).mapInArrow(run, "cluster int, what int, limb int, value bigint")
    rows = told.groupBy("cluster", "what", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in rows:
        out[r["cluster"], r["what"]] = out.get((r["cluster"], r["what"]), 0) + (int(r["value"]) << (LIMB * r["limb"]))
    return out


def fit(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", width: int = 64, k: int = 16, rounds: int = 3) -> Clusters:
    """Centroids of the vectors of ``df`` that ``is_kept`` takes.

    They start as the vectors with the ``k`` smallest SHA-256 of ``1:<id>`` (all
    of them where there are fewer; rows without an id come last, equal ids by
    their vectors) and move ``rounds`` times to the floor of the mean of the
    vectors nearest to them; one without vectors stays.  Repeated rows count as
    often as they stand; other columns are not read.  Without any kept vector
    there is no centroid.
    """
    values = F.col(vector).cast("array<double>")
    order = [F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")), 256).asc_nulls_last(), values.asc()]
    first = df.filter(is_kept(values, width)).orderBy(*order).limit(k).select(values.alias("x")).collect()
    centroids = [integers(np.array([r["x"]], np.float64))[0].tolist() for r in first]
    if not centroids:
        return Clusters([], [])
    for _ in range(rounds):
        totals = _totals(df, values, width, centroids)
        for c in range(len(centroids)):
            if count := totals.get((c, _COUNT)):
                centroids[c] = [totals[c, i] // count for i in range(width)]
    totals = _totals(df, values, width, centroids)
    return Clusters(centroids, [totals.get((c, _DISTANCE), 0) for c in range(len(centroids))])


def assign(df: DataFrame, clusters: Clusters, vector: str = "embedding", width: int = 64, name: str = "assigned") -> DataFrame:
    """``df`` with a struct ``name``: ``cluster`` and squared ``distance``.

    It is NULL where the vector is not kept or there are no centroids; the
    distance is NULL where it is beyond a bigint.  Rows are judged one by one;
    an empty table gives an empty table, other columns pass through (one called
    ``name`` is replaced).
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Bisectors(clusters.centroids) if clusters.centroids else None
        for column in batches:
            cluster, distance = np.zeros(len(column), np.int32), np.full(len(column), None, object)
            found = np.zeros(len(column), bool)
            for rows, x in vectors(column, width) if own else ():
                cluster[rows], distance[rows] = own.nearest(x)
                found[rows] = True
            told = pa.array([d if d is not None and d <= MAX_LONG else None for d in distance], pa.int64())
            yield pa.StructArray.from_arrays([pa.array(cluster), told], ["cluster", "distance"], mask=pa.array(~found))

    return df.withColumn(name, array_udf(run, "struct<cluster:int,distance:bigint>")(F.col(vector).cast("array<double>")))
