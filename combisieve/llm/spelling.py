"""Spelling variants: frequent words one edit apart, found by PartEnum.

The multiset of a word's letters is a binary vector with one dimension for the
first, second, ... occurrence of each letter.  One inserted or deleted letter
changes one dimension, a replaced one two.  The dimensions are dealt to
``PARTS`` parts; a signature is the vector without two of the parts.  Two
vectors at a distance of at most two are equal outside some two parts, so near
words always share a signature: equi-joins on signatures miss none, and the edit
distance is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combisieve.functions.exprs import let
from combisieve.operators.skew import attach_totals, spread_join
from combisieve.session import cut_lineage

PARTS = 7
#: Words of a signature that are compared pair by pair; beyond that they are
#: compared where they also share a word with one letter less.
GROUP = 64
CHUNK_CHARS = 1 << 20
#: Distinct words that a task gathers before it tells them.
GATHERED = 400_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")


def _runs(text: str) -> Counter[str]:
    """Runs of letters with A-Z lower-cased, by their number."""
    found: Counter[str] = Counter()
    at = 0
    while at < len(text):
        gap = _OTHER.search(text, at + CHUNK_CHARS)
        to = gap.start() if gap else len(text)
        found.update(_RUN.findall(text, at, to))
        at = to
    low: Counter[str] = Counter()
    for run, n in found.items():
        # bytes.lower() leaves letters beyond ASCII alone
        low[run.lower() if run.isascii() else run.encode().lower().decode()] += n
    return low


def noisy_words(doc_id: str, text: str, every: int) -> Counter[str]:
    """Words of a text by their number.  A run whose CRC-32 behind the document's
    id is divisible by ``every`` lacks the letter at that value modulo its length."""
    prefix, words = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in _runs(text).items():
        h = zlib.crc32(run.encode(), prefix)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        words[run] += n
    return words


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", every: int = 199, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """``(word, n)``: words of at least ``min_length`` code points that stand at
    least ``min_count`` times in all texts.

    A NULL text has no words, a NULL id is taken as empty; repeated rows count as
    often as they stand.  Tasks add up before the words are dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])
            words.clear()
            return rows

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in noisy_words(doc_id or "", body.as_py() or "", every).items():
                    if len(word) >= min_length:
                        words[word] += n
                if len(words) > GATHERED:
                    yield told()
        yield told()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def signatures(word: Column) -> Column:
    """One hash for each choice of two parts that are left out.

    In the sorted letters, the k-th equal one is dimension ``(letter, k)``; its
    part is the code of the letter plus k, modulo ``PARTS``.
    """
    parts = let(
        F.array_sort(F.split(word, "")),
        lambda letters: F.array(*[
            F.array_join(F.filter(letters, lambda c, i: F.pmod(F.ascii(c) + i - F.array_position(letters, c).cast("int"), F.lit(PARTS)) == part), "")
            for part in range(PARTS)
        ]),
    )
    left_out = list(combinations(range(PARTS), 2))
    return let(parts, lambda p: F.array(*[F.xxhash64(F.lit(i), *[p[k] for k in range(PARTS) if k not in out]) for i, out in enumerate(left_out)]))


def shortened(word: Column) -> Column:
    """``word`` and what is left of it without any one letter."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), less))


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``, both ways round: words of ``words``
    ``(word, n)``, unique and not NULL, that differ by exactly one inserted,
    deleted or replaced code point."""
    keyed = words.withColumn("signature", F.explode(signatures(F.col("word"))))
    totals = keyed.groupBy("signature").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = attach_totals(keyed, totals, ["signature"], "members", ["word"]).filter("members > 1")
    by = F.when(F.col("members") > GROUP, shortened(F.col("word"))).otherwise(F.array(F.lit("")))
    sides = cut_lineage(shared.select("signature", F.explode(by).alias("by"), "word", "n"))
    left, right = sides.alias("l"), sides.alias("r")
    same = (F.col("l.signature") == F.col("r.signature")) & (F.col("l.by") == F.col("r.by"))
    close = (F.abs(F.length("l.word") - F.length("r.word")) <= 1) & (F.levenshtein("l.word", "r.word", 1) == 1)
    found = left.join(right, same & (F.col("l.word") < F.col("r.word")) & close).select(
        F.col("l.word").alias("word"), F.col("l.n").alias("n"), F.col("r.word").alias("near"), F.col("r.n").alias("near_n")
    )
    pairs = cut_lineage(found.distinct())
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``, unique on ``word``: forms are
    followed to the last.  They must not go in circles.  A step doubles the
    distance that is followed, so few are needed."""
    chain = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = spread_join(chain, further, ["root"], "left", ["word"])
        chain = cut_lineage(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not chain.agg(F.bool_or("moved")).first()[0]:
            return chain.select("word", "root")
        chain = chain.select("word", "root")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """``words`` ``(word, n)``, unique and not NULL, with ``form``, ``root``,
    ``n_near`` and ``form_n``.

    A word's form is its near word of largest ``n`` (ties: the smallest in
    code-point order) if that is at least ``times`` the word's own, else NULL;
    its root is where forms lead, itself without one.  ``times`` above 1 keeps
    them from going in circles.  Without near words ``n_near`` is 0; an empty
    table gives an empty table.
    """
    words = cut_lineage(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near")))
    near = near_pairs(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    good = -F.col("best.m") >= times * F.col("n")
    near = cut_lineage(near.select("word", "n_near", F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")))
    ends = roots(near.filter("form is not null"))
    joined = words.join(near, "word", "left").join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
