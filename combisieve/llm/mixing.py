"""Mixing sources to target weights.

The words of each source, document after document, are packed into blocks of
fixed length.  Every output shard draws a multinomial number of slots for each
source; the slots of a source are numbered through all shards, and a slot's
number goes through a pseudorandom permutation of the source's blocks (a new one
for every pass), so that nothing is shuffled but block numbers.  Blocks and slots
meet in a join by block number.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from combisieve.llm.words import mix as mix_bits
from combisieve.operators.ordering import bucket_bits, hash_bucket, prefix_sums, row_index
from combisieve.functions.hashing import hash_key
from combisieve.session import cut_lineage

BLOCK_WORDS = 1024
SHARD_SLOTS = 4096
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space around it that belongs to it: all of them, one
#: after the other, are the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, size)`` rows.

    Sources in code point order, NULL last, get the weights in turn and share
    the total size by them; no target is above ``max_repeats`` times the size of
    its source, and what is over goes to the others by weight.  The level of the
    others is found by rounds over the table of sources; only two sums of each
    round come to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = row_index(totals, [F.col("source").asc_nulls_last()], "__rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights)).cast("int") + 1)
    table = cut_lineage(ranked.withColumn("weight", weight).drop("__rank"))
    cap = F.col("source_size") * max_repeats
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = cap <= level * F.col("weight")
        row = table.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (total - (row["held"] or 0)) / row["open"]
    return table.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


@dataclasses.dataclass
class _Source:
    """What a task has to know of a source."""

    index: int
    size: int
    words: int  # to take
    block: int

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)

    @property
    def slots(self) -> int:
        passes, rest = divmod(self.words, self.size) if self.size else (0, 0)
        return passes * self.blocks + -(-rest // self.block)


def permuted(number: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each ``number`` in a pseudorandom permutation of ``0 .. n - 1``
    chosen by ``key``: a four-round Feistel network on just enough bits, walked
    along its cycle until it falls below ``n``."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    value = number.astype(np.uint64)
    todo = np.ones(len(value), bool)
    while todo.any():
        left, right = value[todo] >> half[todo], value[todo] & mask[todo]
        for turn in range(4):
            left, right = right, left ^ (mix_bits(right + key[todo] + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) & mask[todo])
        value[todo] = (left << half[todo]) | right
        todo[todo] = value[todo] >= n[todo].astype(np.uint64)
    return value.astype(np.int64)


def _slots(sources: list[_Source], shards: int, shard_slots: int, seed: int):
    """Slots of each source in each drawn shard."""
    wanted = np.array([s.slots for s in sources], np.float64)
    share = wanted / wanted.sum()
    total = int(wanted.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                draw = np.random.Generator(np.random.Philox(key=[seed, shard]))
                counts = draw.multinomial(min(shard_slots, total - shard * shard_slots), share)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), shard), pa.int64()), pa.array(np.array([sources[i].index for i in some]), pa.int64()), pa.array(counts[some], pa.int64())],
                    ["shard", "source_index", "slots"],
                )

    return run


def _numbered(sources: list[_Source], shard_slots: int, seed: int):
    """Each slot's block, pass and words; draws beyond what a source may give
    are dropped (the closing shards have what is missing)."""
    by_index = {s.index: s for s in sources}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, index, n, last in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s = by_index[index]
                j = np.arange(last - n, min(last, s.slots))
                if not len(j):
                    continue
                turn, i = np.divmod(j, s.blocks)
                # the last block, which may be short, keeps its place: then all
                # slots but the last one of the last pass are whole
                place = i.copy()
                free = i < s.blocks - 1
                key = mix_bits(np.uint64(seed) + (turn[free].astype(np.uint64) << np.uint64(32)) + np.uint64(index))
                place[free] = permuted(i[free], np.full(free.sum(), s.blocks - 1), key)
                words = np.minimum(np.minimum(s.block, s.size - place * s.block), s.words - turn * s.size - i * s.block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(j), shard), pa.int64()), pa.array(j, pa.int64()), pa.array(np.full(len(j), index), pa.int64()), pa.array(turn, pa.int64()), pa.array(place, pa.int64()), pa.array(words, pa.int64())],
                    ["shard", "slot", "source_index", "turn", "block", "words"],
                )

    return run


@dataclasses.dataclass
class Mix:
    """A mix of documents.

    ``entries``: one row per document (``key`` names it) with ``source``,
    ``size``, ``source_size``, ``target`` and ``first_word``, its place in its
    source.  ``pieces``: ``(shard, slot, source_index, turn, block, key, begin, n)``,
    for every slot the words ``begin .. begin + n - 1`` of each document in it.
    """

    entries: DataFrame
    pieces: DataFrame
    _rows: DataFrame
    _text_col: str

    def _text(self) -> Column:
        return F.col("__row")[self._text_col]

    def taken(self) -> DataFrame:
        """``entries`` with ``taken``, the words that the mix takes, repeats counted."""
        took = self.pieces.groupBy("key").agg(F.sum("n").alias("taken"))
        return self.entries.join(took, "key", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))

    def _cut(self) -> DataFrame:
        """``pieces`` with their text, a slice of the source text."""
        units = F.regexp_extract_all(self._text(), F.lit(UNIT), F.lit(0))
        listed = self.pieces.groupBy("key").agg(F.collect_list(F.struct("turn", "begin", "n", "shard", "slot")).alias("parts"))
        cut = F.transform(
            F.array(units),
            lambda u: F.transform("parts", lambda p: F.struct(p["turn"], p["begin"], p["shard"], p["slot"], F.array_join(F.slice(u, p["begin"].cast("int") + 1, p["n"].cast("int")), "").alias("text"))),
        )[0]
        return self._rows.join(listed, "key").select("key", "__row", cut.alias("parts"))

    def blocks(self) -> DataFrame:
        """``(shard, slot, source_index, text)``: what is written to the shards.
        A block has at most ``BLOCK_WORDS`` words."""
        parts = self._cut().select("key", F.inline("parts"))
        where = self.pieces.select("shard", "slot", "source_index", "key", "turn", "begin", "first")
        joined = parts.drop("turn").join(where, ["key", "shard", "slot", "begin"])
        ordered = F.array_sort(F.collect_list(F.struct("first", "key", "text")))
        return joined.groupBy("shard", "source_index", "slot").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))

    def documents(self, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
        """One row per document and pass with the words that the pass takes of it
        as ``text``, the other columns as they are (``n_chars``, if there is such
        a column, is counted anew).  Documents without words stay once."""
        by_turn = F.transform(
            F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["turn"]))),
            lambda t: F.array_join(F.transform(F.array_sort(F.filter("parts", lambda p: p["turn"] == t)), lambda p: p["text"]), ""),
        )
        whole = self._cut().select("__row", F.explode(by_turn).alias("__new"))
        empty = self._rows.filter(words_in(self._text()) == 0).select("__row", self._text().alias("__new"))
        row = F.col("__row").withField(text, F.col("__new"))
        if n_chars is not None and n_chars in self._rows.schema["__row"].dataType.names:
            row = row.withField(n_chars, F.when(F.col("__row")[n_chars].isNotNull(), F.char_length("__new")).cast(self._rows.schema["__row"].dataType[n_chars].dataType))
        return whole.unionByName(empty).select(row.alias("__row")).select("__row.*")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED,
) -> Mix:
    """Mix whole ``docs`` (see ``source_targets``).  Each source gives exactly its
    target, rounded to words; no word is taken more than ``max_repeats`` times.

    Multinomial draws of a shard are cut off where they would take a source over
    its target; what is missing stands in a closing shard.  Sources are a short
    table that goes to the driver (three numbers each); documents, blocks and
    slots never do.

    A NULL, empty or blank text has no words and is in no block.  A NULL source
    is a source.  Documents are told apart by id, source and a hash of the text;
    rows that repeat all three are laid one after another, as documents of their
    own with their own other columns.  An empty table gives an empty mix.
    """
    spark = docs.sparkSession
    # the text travels once, inside its row
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(source).alias("source"), F.xxhash64(text).alias("mark"), F.struct("*").alias("__row"))
    same = rows.select("doc", "source", "mark", words_in(F.col("__row")[text]).alias("size")).groupBy("doc", "source", "mark").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy")
    sized = cut_lineage(same.select("doc", "source", "mark", "size", copies))
    targets = source_targets(sized.select("source", "size"), weights, max_repeats)
    targets = cut_lineage(row_index(targets, [F.col("source").asc_nulls_last()], "source_index"))

    table = [
        _Source(r["source_index"], r["source_size"], min(round(r["target"]), max_repeats * r["source_size"]), block_words)
        for r in targets.select("source_index", "source_size", "target").toLocalIterator()
    ]
    table = [s for s in table if s.slots]
    named = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(
        "doc", sized["source"], "mark", "size", "copy", "source_size", "target", "source_index"
    )
    named = named.withColumn("key", F.struct("doc", "source", "mark", "copy"))
    placed = named.withColumn("__h", hash_key("doc", "mark", "copy", seed=seed)).withColumn("__b", hash_bucket("__h", bucket_bits(spark)))
    order = [F.col(c) for c in ("__h", "doc", "mark", "copy")]
    placed = prefix_sums(placed, "__b", order, {"__last": F.col("size")}, ["source_index"])
    entries = cut_lineage(placed.select("key", "source", "size", "source_size", "target", "source_index", (F.col("__last") - F.col("size")).alias("first_word")))

    slots = spark.createDataFrame([], "shard bigint, slot bigint, source_index bigint, turn bigint, block bigint, words bigint")
    if table:
        n = sum(s.slots for s in table)
        shards = -(-n // shard_slots)
        drawn = cut_lineage(spark.range(shards).mapInArrow(_slots(table, shards, shard_slots, seed), "shard bigint, source_index bigint, slots bigint"))
        # the closing shard has what the draws left of each source
        short = spark.createDataFrame([(s.index, s.slots) for s in table], "source_index bigint, wanted bigint")
        left = short.join(drawn.groupBy("source_index").agg(F.sum("slots").alias("had")), "source_index", "left")
        closing = left.select(F.lit(shards).cast("bigint").alias("shard"), "source_index", F.greatest(F.col("wanted") - F.coalesce("had", F.lit(0)), F.lit(0)).alias("slots"))
        every = drawn.unionByName(closing).withColumn("__b", F.shiftright("shard", 10))
        counted = prefix_sums(every, "__b", [F.col("shard")], {"last": F.col("slots")}, ["source_index"])
        slots = (
            counted.select("shard", "source_index", "slots", "last").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "source_index")
            .mapInArrow(_numbered(table, shard_slots, seed), slots.schema)
        )
        slots = cut_lineage(slots)
    low, high = F.floor(F.col("first_word") / block_words), F.floor((F.col("first_word") + F.col("size") - 1) / block_words)
    in_blocks = entries.filter("size > 0").select("key", "source_index", "first_word", "size", F.explode(F.sequence(low, high)).alias("block"))
    start = F.col("block") * block_words
    begin = F.greatest(F.col("first_word"), start)
    end = F.least(F.col("first_word") + F.col("size"), start + F.col("words"))
    pieces = (
        # a row per block of the mix on either side: never broadcast
        in_blocks.hint("merge").join(slots.hint("merge"), ["source_index", "block"])
        .select("shard", "slot", "source_index", "turn", "block", "key", begin.alias("first"), (begin - F.col("first_word")).alias("begin"), (end - begin).alias("n"))
        .filter("n > 0")
    )
    # rows that repeat all three are few as a rule; their other columns order them
    others = F.xxhash64(F.to_json(F.struct(*[F.col("__row")[c].alias(c) for c in docs.columns if c != text])))
    number = F.row_number().over(W.partitionBy("doc", "source", "mark").orderBy(others)).cast("bigint")
    numbered = rows.withColumn("copy", number).select(F.struct("doc", "source", "mark", "copy").alias("key"), "__row")
    return Mix(entries, pieces, numbered, text)
