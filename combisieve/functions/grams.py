"""Hashed character q-grams of texts, a batch at a time.

A batch has far fewer different q-grams than places, so each is hashed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from combisieve.functions.hashing import HASH_BITS

#: Characters, and cells of a table of rows by bits, that are held at a time.
SLICE_CHARS, SLICE_CELLS = 4_000_000, 1 << 25
#: Hashes that a task remembers.
KNOWN_GRAMS = 1_000_000
CODE_POINTS = 0x110000


def full_hash(text: str) -> int:
    """``functions.hashing.text_hash`` with all its bits."""
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:7], "big") >> 4


def _slices(texts: Iterator[bytes | None], rows: int) -> Iterator[list[str]]:
    out, chars = [], 0
    for t in texts:
        out.append("" if t is None else t.decode("utf-8", "replace"))
        chars += len(out[-1])
        if chars >= SLICE_CHARS or len(out) >= rows:
            yield out
            out, chars = [], 0
    if out:
        yield out


def _places(texts: list[str], q: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, gram, h)``: row and q-gram of every place, in the order of the
    texts, and the hash of each q-gram."""
    text = "".join(texts)
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(chars) - q + 1
    if n < 1:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    at = np.flatnonzero(row[:n] == row[q - 1 :])
    seen = np.zeros(CODE_POINTS, np.int64)
    seen[chars] = 1
    letters = int(seen.sum())
    letter = (np.cumsum(seen) - 1)[chars]
    code, kinds = letter[at], letters
    for j in range(1, q):
        if kinds * letters >= 2**62:
            found = pa.array(code).dictionary_encode()
            code, kinds = found.indices.to_numpy().astype(np.int64), len(found.dictionary)
        code = code * letters + letter[at + j]
        kinds *= letters
    gram = pa.array(code).dictionary_encode().indices.to_numpy()
    some = np.empty(int(gram.max(initial=-1)) + 1, np.int64)
    some[gram] = at
    if len(known) > KNOWN_GRAMS:
        known.clear()
    h = np.empty(len(some), np.int64)
    for i, p in enumerate(some.tolist()):
        g = text[p : p + q]
        if (x := known.get(g)) is None:
            x = known[g] = full_hash(g)
        h[i] = x
    return row[at], gram, h


def _gram_udf(q: int, rows: int, kind: pa.DataType, schema: str, reduce: Callable[..., pa.Array]) -> Callable[[Column], Column]:
    """``reduce(n_rows, row, gram, h)`` of slices of the texts, a value per row."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for batch in batches:
            texts = chain.from_iterable(batch.slice(i, 1024).to_pylist() for i in range(0, len(batch), 1024))
            parts = [reduce(len(s), *_places(s, q, known)).cast(kind) for s in _slices(texts, rows)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    udf = F.arrow_udf(run, schema).asNondeterministic()
    return lambda text: udf(text.cast("binary"))


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def gram_words(text: Column, q: int, n_bits: int, shift: int) -> Column:
    """32-bit words of the set of q-gram hashes, cut to their first bits by
    ``shift``, modulo ``n_bits``.  A NULL text has none."""
    n_words = (n_bits + 31) // 32

    def reduce(n: int, row: np.ndarray, gram: np.ndarray, h: np.ndarray) -> pa.Array:
        on = np.zeros((n, n_words * 32), np.uint8)
        on[row, ((h >> shift) % n_bits)[gram]] = 1
        words = np.packbits(on, axis=1, bitorder="little").view("<u4").astype(np.int64)
        return _lists(np.full(n, n_words), pa.array(words.ravel()))

    return _gram_udf(q, max(1, SLICE_CELLS // n_bits), pa.list_(pa.int64()), "array<bigint>", reduce)(text)


def gram_counts(text: Column, q: int, n_bits: int, shift: int) -> Column:
    """``(bit, n)`` of the same hashes: how many places have them."""
    kind = pa.list_(pa.struct([("bit", pa.int64()), ("n", pa.int64())]))

    def reduce(n: int, row: np.ndarray, gram: np.ndarray, h: np.ndarray) -> pa.Array:
        cells = np.bincount(row * np.int64(n_bits) + ((h >> shift) % n_bits)[gram], minlength=n * n_bits)
        at = np.flatnonzero(cells)
        pairs = pa.StructArray.from_arrays([pa.array(at % n_bits), pa.array(cells[at])], ["bit", "n"])
        return _lists(np.bincount(at // n_bits, minlength=n), pairs)

    return _gram_udf(q, max(1, SLICE_CELLS // n_bits), kind, "array<struct<bit:bigint,n:bigint>>", reduce)(text)


def gram_minima(text: Column, q: int, shift: int, prime: int, family: list[tuple[int, int]]) -> Column:
    """Minimum of ``(a*h + b) mod prime`` (below 2**31) over the q-grams for each
    ``(a, b)`` of the family; ``prime`` where there is no q-gram."""
    def reduce(n: int, row: np.ndarray, gram: np.ndarray, h: np.ndarray) -> pa.Array:
        out = np.full((n, len(family)), prime, np.int64)
        if len(row):
            # a q-gram counts once in a row
            pairs = pa.array(row * np.int64(len(h)) + gram).dictionary_encode().dictionary.to_numpy()
            of, which = pairs // len(h), pairs % len(h)
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            h = (h >> shift) % prime
            for i, (a, b) in enumerate(family):
                out[of[starts], i] = np.minimum.reduceat(((a * h + b) % prime).astype(np.int32)[which], starts)
        return _lists(np.full(n, len(family)), pa.array(out.ravel()))

    return _gram_udf(q, 1 << 16, pa.list_(pa.int64()), "array<bigint>", reduce)(text)
