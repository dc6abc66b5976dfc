"""Token ids in fixed-width bit-packed files.

A file: ``magic, bits, block size, tokens, documents`` (little endian), the
documents' ids, whether they have one, and first tokens, the byte offset of each
block, then the blocks.  A block holds ``BLOCK`` ids (the last one fewer) in
``bits`` bits each, the least that the vocabulary needs, in 64-bit words; it is
unpacked by itself with shifts over whole numpy columns, so that any range of
tokens is read without the rest.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from combisieve.llm.files import partition_id, place, write_whole
from combisieve.llm.words import SPACED, Block, blocks, sums
from combisieve.session import cut_lineage, scratch_path

MAGIC = b"BITPACK1"
HEADER = struct.Struct("<8sIIQQ")
BLOCK = 4096  # ids in a block, a multiple of 64
FILE_TOKENS = 4_000_000
#: Pieces whose ids a task keeps at hand; only saves work.
REMEMBERED_WORDS = 500_000
_LETTERS_ONLY = re.compile("[a-zß-öø-ÿ]+")


def width(vocabulary: int) -> int:
    """Least bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """64 ids fill ``bits`` words: id j of each group of 64 goes to the same bits
    of the same words, so each step works on all groups at once."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, 64)
    out = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= padded[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= padded[:, j] >> np.uint64(64 - shift)
    return out.reshape(-1)[: -(-len(ids) * bits // 64)].astype("<u8").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    groups = -(-n // 64)
    words = np.zeros(groups * bits, np.uint64)
    packed = np.frombuffer(data, "<u8")
    words[: len(packed)] = packed
    words = words.reshape(groups, bits)
    out = np.empty((groups, 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.reshape(-1)[:n].astype(np.uint32)


def encode_file(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None], bits: int) -> list[bytes]:
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    payload = [pack(ids[a : a + BLOCK], bits) for a in range(0, len(ids), BLOCK)]
    has_id = np.array([x is not None for x in doc_ids], np.uint8)
    own = np.array([x or 0 for x in doc_ids], "<i8")
    head = HEADER.pack(MAGIC, bits, BLOCK, len(ids), len(doc_ids))
    first = len(head) + own.nbytes + has_id.nbytes + starts.nbytes + 8 * (len(payload) + 1)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in payload], dtype=np.int64)]) + first
    return [head, own.tobytes(), has_id.tobytes(), starts.tobytes(), offsets.astype("<u8").tobytes(), *payload]


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str) -> None:
        system, path = place(uri)
        self.file = system.open_input_file(path)
        magic, self.bits, self.block, self.n_tokens, self.n_docs = HEADER.unpack(self._read(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        at = HEADER.size
        n_blocks = -(-self.n_tokens // self.block)
        own = np.frombuffer(self._read(at, 8 * self.n_docs), "<i8")
        at += 8 * self.n_docs
        has_id = np.frombuffer(self._read(at, self.n_docs), np.uint8)
        at += self.n_docs
        self.doc_ids = [int(x) if y else None for x, y in zip(own, has_id, strict=True)]
        self.starts = np.frombuffer(self._read(at, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.offsets = np.frombuffer(self._read(at, 8 * (n_blocks + 1)), "<u8").astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the file; reads the blocks that hold them."""
        if end <= begin:
            return np.zeros(0, np.uint32)
        low, high = begin // self.block, -(-end // self.block)
        data = self._read(int(self.offsets[low]), int(self.offsets[high] - self.offsets[low]))
        out = []
        for b in range(low, high):
            n = min(self.block, self.n_tokens - b * self.block)
            a = int(self.offsets[b] - self.offsets[low])
            out.append(unpack(data[a : a + int(self.offsets[b + 1] - self.offsets[b])], n, self.bits))
        return np.concatenate(out)[begin - low * self.block : end - low * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))


def _byte_kinds() -> np.ndarray:
    """0 marks, 1 letters (all bytes above ASCII), 2 digits, 3 white space."""
    kinds = np.ones(256, np.int8)
    kinds[:0x80] = 0
    kinds[~SPACED] = 3
    for lo, hi, kind in (("a", "z", 1), ("A", "Z", 1), ("0", "9", 2)):
        kinds[ord(lo) : ord(hi) + 1] = kind
    return kinds


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases, drops white space and
    splits between letters, digits and marks: each distinct piece is encoded
    once, and texts are put together from that.

    A word is cut into pieces and lower-cased here only if its letters are ASCII
    or two-byte Latin-1 ones and it has neither an apostrophe (which joins the
    letters behind it) nor ``<`` (of special tokens); others are pieces as they
    are.  So the ids equal those of the whole text.
    """

    _KINDS = _byte_kinds()

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Pieces of lower-case letters are one word each: as many as a text with
        blanks between them has ids that close a word.  Any other piece (marks,
        figures, other letters, special tokens) is a text of its own."""
        plain = [w for w in pieces if _LETTERS_ONLY.fullmatch(w)]
        other = [w for w in pieces if not _LETTERS_ONLY.fullmatch(w)]
        ids, counts = [self.flat], [self.count]
        for at in range(0, len(plain), 256):
            got = np.array(self.tokenizer.encode(" ".join(plain[at : at + 256]), add_special_tokens=False).ids, np.uint32)
            ids.append(got)
            counts.append(np.diff(np.flatnonzero(self.closes[got]) + 1, prepend=0))
        for at in range(0, len(other), 4096):
            each = [e.ids for e in self.tokenizer.encode_batch(other[at : at + 4096], add_special_tokens=False)]
            ids.append(np.array([i for x in each for i in x], np.uint32))
            counts.append(np.array([len(x) for x in each], np.int64))
        self.known.update(zip(plain + other, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.flat, self.count = np.concatenate(ids), np.concatenate(counts)
        if len(self.count) != len(self.known) or self.count.sum() != len(self.flat):
            raise ValueError("not a tokenizer that closes each word of letters once")

    def _pieces(self, block: Block) -> tuple[pa.LargeStringArray, np.ndarray]:
        """Pieces of all texts, and the first one of each text (one more)."""
        buf = block.buf
        kind = self._KINDS[buf]
        latin = np.concatenate([[False], buf[:-1] == 0xC3])  # second byte of a Latin-1 letter
        odd = (buf == 0x27) | (buf == 0x3C) | (buf >= 0xC4) | (buf == 0xC2) | ((buf >= 0x80) & (buf < 0xC0) & ~latin)
        odd |= latin & ((buf == 0x97) | (buf == 0xB7))
        strange = sums(odd, np.concatenate([block.start, [len(buf)]])) > 0
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = kind[1:] != kind[:-1]
        plain = np.zeros(len(buf) + 1, np.int8)
        plain[block.start] = np.where(strange, -1, 1)
        plain[block.end] -= np.where(strange, -1, 1)
        inside = np.cumsum(plain)[:-1]  # 1 in words that are cut, -1 in others
        cut[:-1] &= inside == 1
        cut[block.start] = True
        starts = np.flatnonzero(cut[:-1] & (kind != 3))
        used = kind != 3
        low = buf.copy()
        low[(inside == 1) & (((buf >= 0x41) & (buf <= 0x5A)) | (latin & (buf <= 0x9E)))] += 0x20
        place = np.concatenate([[0], np.cumsum(used)])
        offsets = np.concatenate([place[starts], [place[-1]]]).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[used]))
        return pieces, np.searchsorted(starts, block.offsets)

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        all_ids, all_lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for _, block in blocks(texts, SPACED):
            pieces, first = self._pieces(block)
            coded = pieces.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(self.known) > REMEMBERED_WORDS:
                self._forget()
            self._learn([w for w in distinct if w not in self.known])
            number = np.array([self.known[w] for w in distinct] + [len(self.count)], np.int64)
            # the end id is one more piece, at the end of each text
            flat, count = np.append(self.flat, end), np.append(self.count, len(end))
            begin = np.cumsum(count) - count
            order = number[np.insert(coded.indices.to_numpy(zero_copy_only=False), first[1:], len(distinct))]
            n = count[order]
            to = np.cumsum(n)
            all_ids.append(flat[np.repeat(begin[order] - (to - n), n) + np.arange(to[-1] if len(to) else 0)])
            ends = first[1:] + np.arange(1, block.n_docs + 1)
            all_lengths.append(np.diff(np.concatenate([[0], to])[ends], prepend=0))
        return np.concatenate(all_ids), np.concatenate(all_lengths)


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker, with what it has learned."""
    return WordEncoder(path)


class TextEncoder:
    """Encodes each text by itself, for any tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        end = [] if end_id is None else [end_id]
        rows = [e.ids + end for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.array([i for r in rows for i in r], np.uint32), np.array([len(r) for r in rows], np.int64)


class Written(NamedTuple):
    folder: str
    #: ``(part, number, path, n_docs, n_tokens, first_token)``, one row per file
    manifest: DataFrame


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text",
    by_word: bool = False, folder: str | None = None,
) -> Written:
    """Encode whole texts and write them in ascending ``doc_id`` order.

    ``tokenizer``: path of a tokenizer file that every machine has.  ``by_word``
    says that it is of the kind that ``WordEncoder`` describes; then distinct
    words are encoded once.  ``end_id`` is appended to each text.  ``folder``: a folder that
    all machines see (a new one in the shared folder if not given).

    NULL text counts as empty (it has the end id only); a NULL ``doc_id`` comes
    first; repeated ids stand side by side, by a hash of the text, and stay
    separate documents.  Other columns are ignored.  An empty table writes no
    file.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    bits = width(Tokenizer.from_file(tokenizer).get_vocab_size())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer) if by_word else TextEncoder(tokenizer)
        part, number = partition_id(), 0
        ids, lengths, owners, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{number:06d}.bin"
            every, each = np.concatenate(ids), np.concatenate(lengths)
            write_whole(path, encode_file(every, each, owners, bits))
            row = {"part": part, "number": number, "path": path, "n_docs": len(owners), "n_tokens": len(every)}
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                got, n = encoder.encode(piece.column(1), end_id)
                ids.append(got)
                lengths.append(n)
                owners += piece.column(0).to_pylist()
                held += len(got)
                if held >= FILE_TOKENS:
                    yield flush()
                    number += 1
                    ids, lengths, owners, held = [], [], [], 0
        if owners:
            yield flush()

    order = [F.col("id"), F.xxhash64("text")]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    files = cut_lineage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "part int, number int, path string, n_docs bigint, n_tokens bigint"))
    # one row per file; a file holds FILE_TOKENS ids
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    return Written(folder, files.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))))


_MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read_tokens(written: Written, with_ids: bool = False) -> DataFrame:
    """One row per document read back from the files: ``doc_id``, ``start`` (ids
    of all documents before it), ``n_tokens``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers) and, if wanted, ``ids``."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                ids = file.tokens(0, file.n_tokens).astype("<u4")
                each = [ids[a:b] for a, b in zip(file.starts[:-1], file.starts[1:], strict=True)]
                columns = [
                    pa.array(file.doc_ids, pa.int64()),
                    pa.array(file.starts[:-1] + first, pa.int64()),
                    pa.array(np.diff(file.starts), pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in each], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    parts = int(written.manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written.manifest.select("path", "first_token").repartition(parts, "path").mapInArrow(run, schema)
