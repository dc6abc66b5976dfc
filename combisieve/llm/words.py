"""Words and their hashes from a block of texts, as numpy arrays over the bytes.

Separators of both word rules are ASCII, so UTF-8 bytes can be classed one by
one: bytes above 0x7F belong to words.  A word's hash is a polynomial over
secret byte weights modulo 2**64, taken from prefix sums, then mixed; it
depends on the word alone, so that hashes compare across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_SEG = 1 << 17
_U = np.uint64


def _weights(fold_case: bool) -> np.ndarray:
    table = np.random.Generator(np.random.Philox(key=20240229)).integers(1, 2**64 - 1, 256, dtype=_U)
    if fold_case:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


def _powers(base: int) -> np.ndarray:
    out = np.full(_SEG, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_POW, _INV = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))
_SEG_POW, _SEG_INV = pow(_BASE, _SEG, 2**64), pow(pow(_BASE, -1, 2**64), _SEG, 2**64)
_PLAIN, _FOLDED = _weights(False), _weights(True)

#: Not in a word: space and tab to carriage return.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Not in a word: ASCII other than digits and letters.
ALNUM = np.ones(256, bool)
ALNUM[:0x80] = False
for _lo, _hi in (("0", "9"), ("a", "z"), ("A", "Z")):
    ALNUM[ord(_lo) : ord(_hi) + 1] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Block:
    """Words of some consecutive texts (NULL counts as empty).

    ``buf``: their bytes; ``offsets``: byte offsets of the texts (one more than
    texts); ``start``/``end``: byte range of each word; ``doc``: its text;
    ``first``: index of the first word of each text (one more than texts).
    """

    def __init__(self, texts: pa.Array, in_word: np.ndarray, fold_case: bool) -> None:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        buffers = texts.buffers()
        raw = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        lo, hi = int(raw[0]), int(raw[-1])
        self.buf = np.frombuffer(buffers[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
        self.offsets = raw - lo
        self.n_docs = n
        self.fold_case = fold_case
        inside = in_word[self.buf]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = self.offsets[:-1][self.offsets[:-1] < len(self.buf)]
        begins[edges] = inside[edges]
        edges = edges[edges > 0] - 1
        ends[edges] = inside[edges]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word, or of other ascending, non-overlapping byte ranges."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        table = _FOLDED if self.fold_case else _PLAIN
        before, after = np.zeros(len(start), _U), np.zeros(len(start), _U)
        carry, base, n = 0, 1, len(self.buf)
        for a in range(0, n, _SEG):
            terms = table[self.buf[a : a + _SEG]]
            terms *= _POW[: len(terms)]
            total = np.zeros(len(terms) + 1, _U)
            np.cumsum(terms, out=total[1:])
            total *= _U(base)
            total += _U(carry)
            b = a + len(terms)
            i, j = np.searchsorted(start, (a, b))
            before[i:j] = total[start[i:j] - a]
            i, j = np.searchsorted(end, (a, b), side="right")
            after[i:j] = total[end[i:j] - a]
            carry = int(total[-1])
            base = base * _SEG_POW % 2**64
        seg_inv = np.array([pow(_SEG_INV, k, 2**64) for k in range(n // _SEG + 1)], _U)
        value = (after - before) * _INV[start % _SEG] * seg_inv[start // _SEG]
        return mix(value + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def bytes_of(self, word: int) -> bytes:
        return self.buf[self.start[word] : self.end[word]].tobytes()


def blocks(texts: pa.Array, in_word: np.ndarray, fold_case: bool = False) -> Iterator[tuple[int, Block]]:
    """``(index of the first text, Block)`` over slices of about ``SLICE_BYTES``;
    a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    done = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(done, done[at] + SLICE_BYTES, side="right")) - 1)
        yield at, Block(texts.slice(at, to - at), in_word, fold_case)
        at = to


def ngrams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words of one text, and the index of their
    first words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = words[:count].copy()
    for k in range(1, n):
        h *= _U(_BASE)
        h ^= h >> _U(29)
        h += words[k : k + count]
    at = np.flatnonzero(doc[:count] == doc[n - 1 :])
    return mix(h[at]), at


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each ``[first[i], first[i + 1])``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
