"""Shards of near equal bytes by histogram sort.

Every row has a 60-bit key: a hash of the text, then a hash of the id, so that
equal texts stand side by side.  The bytes below candidate borders are counted
exactly over all partitions; a cell of the key range that holds a border and too
many bytes, or too many rows to be sorted by one task, is probed again with finer
borders, until all meet the tolerance.  Then every row knows its shard and its
cell, and the rows are exchanged once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from combisieve.session import cut_lineage

KEY_BITS, HALF_BITS = 60, 30
#: Bits of the key that the first probe and each further one tell apart.
FIRST_BITS, MORE_BITS = 12, 8
#: How far the bytes below a border may be off, as a share of a shard.
TOLERANCE = 0.002
#: A cell with more than so many times the mean rows of a first cell is cut again.
LARGE_CELL = 8


class Cell(NamedTuple):
    """Keys whose first ``bits`` bits are ``prefix``."""

    bits: int
    prefix: int
    rows: int
    bytes: int

    @property
    def low(self) -> int:
        return self.prefix << (KEY_BITS - self.bits)


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def key_of(doc_id: Column, text: Column) -> Column:
    mask = F.lit((1 << HALF_BITS) - 1)
    high = F.xxhash64(text).bitwiseAND(mask)
    # NULL would hash to the seed like any other; equal ids have equal keys
    return F.shiftleft(high, HALF_BITS).bitwiseOR(F.xxhash64(doc_id, F.lit("id")).bitwiseAND(mask))


def _prefix(bits: int) -> Column:
    return F.shiftright("__key", KEY_BITS - bits)


def _borders(cells: list[Cell], shards: int, total: int) -> dict[int, Cell]:
    """For each inner border the cell in which it falls."""
    out, below, border = {}, 0, 1
    for cell in cells:
        while border < shards and below + cell.bytes >= border * total / shards:
            out[border] = cell
            border += 1
        below += cell.bytes
    return out


def histogram(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[Cell]:
    """Cells in key order, fine enough for ``shards`` borders.

    A probe is one aggregate.  The driver holds one row per cell: 2**FIRST_BITS,
    and 2**MORE_BITS for each cell that is cut, of which there are fewer than
    ``2**FIRST_BITS / LARGE_CELL + shards`` at each of the (60 - 12) / 8 depths.
    """
    sums = [F.count(F.lit(1)).alias("rows"), F.sum("__size").alias("bytes")]
    done = [Cell(FIRST_BITS, r["p"], r["rows"], r["bytes"]) for r in keyed.groupBy(_prefix(FIRST_BITS).alias("p")).agg(*sums).toLocalIterator()]
    done.sort(key=lambda c: c.low)
    total, rows = sum(c.bytes for c in done), sum(c.rows for c in done)
    bits = FIRST_BITS
    while bits < KEY_BITS:
        allowed = max(1.0, tolerance * total / shards)
        split = {c for c in _borders(done, shards, total).values() if c.bits == bits and c.bytes > allowed and c.rows > 1}
        split |= {c for c in done if c.bits == bits and c.rows * 2**FIRST_BITS > LARGE_CELL * max(rows, 2**FIRST_BITS)}
        if not split:
            break
        finer = min(KEY_BITS, bits + MORE_BITS)
        chosen = keyed.sparkSession.createDataFrame([(c.prefix,) for c in sorted(split)], "__cut bigint")
        inside = keyed.join(F.broadcast(chosen), _prefix(bits) == F.col("__cut"), "left_semi")
        parts = [Cell(finer, r["p"], r["rows"], r["bytes"]) for r in inside.groupBy(_prefix(finer).alias("p")).agg(*sums).toLocalIterator()]
        done = sorted([c for c in done if c not in split] + parts, key=lambda c: c.low)
        bits = finer
    return done


def _assigned(cells: list[Cell], shards: int) -> list[tuple[int, int, int, int]]:
    """``(bits, prefix, shard, rows of the shard before the cell)``; a cell goes
    to the shard in which its middle byte falls."""
    total = max(1, sum(c.bytes for c in cells))
    out, below, counts = [], 0, [0] * shards
    for c in cells:
        shard = min(shards - 1, (2 * below + c.bytes) * shards // (2 * total))
        out.append((c.bits, c.prefix, shard, counts[shard]))
        counts[shard] += c.rows
        below += c.bytes
    return out


def shard_documents(
    docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE
) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes and 1), ``shard`` from 0 and ``slot``,
    gapless from 0 in each shard, in key order.

    Shards hold nearly equal bytes: a border is off by at most ``tolerance`` of a
    shard, unless one row is larger.  Where copies of one text go over a border
    they are cut there, by a hash of the id.

    A NULL or empty text has size 1.  Rows that repeat id and text have equal
    keys and stay side by side in any order; a NULL id is an id like others.  An
    empty table gives an empty table.  Other columns pass through; columns
    called ``size``, ``shard`` or ``slot`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in ("size", "shard", "slot") if c not in (doc_id, text)])
    added = {"__size": byte_size(F.col(text)), "__key": key_of(F.col(doc_id), F.col(text))}
    keyed = docs.withColumns(added)
    # the probes read two numbers per row instead of the texts
    cells = _assigned(histogram(cut_lineage(keyed.select("__size", "__key")), shards, tolerance), shards)
    placed = keyed.withColumns({"__bits": F.lit(None).cast("int"), "__shard": F.lit(None).cast("int"), "__before": F.lit(None).cast("bigint")})
    for bits in sorted({c[0] for c in cells}):
        level = spark.createDataFrame([c[1:] for c in cells if c[0] == bits], "__p bigint, __s int, __b bigint")
        # as many rows as there are cells: see histogram
        placed = placed.join(F.broadcast(level), _prefix(bits) == F.col("__p"), "left").withColumns({
            "__bits": F.when(F.col("__s").isNotNull(), F.lit(bits)).otherwise(F.col("__bits")),
            "__shard": F.coalesce("__s", "__shard"),
            "__before": F.coalesce("__b", "__before"),
        }).drop("__p", "__s", "__b")
    cell = W.partitionBy("__shard", "__before", "__bits").orderBy("__key", F.col(doc_id))
    slot = F.col("__before") + F.row_number().over(cell) - 1
    return placed.select(*docs.columns, F.col("__size").alias("size"), F.col("__shard").alias("shard"), slot.alias("slot"))
