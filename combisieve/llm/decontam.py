"""Benchmark decontamination with suffix arrays over the training text.

Every task builds suffix arrays over blocks of its training documents (a shard)
and binary-searches every window of every test suffix in them.  Suffixes that do
not begin like any window cannot be an answer and are left out before the
sort.  Locations are extended to the longest verbatim match by a second binary
search, in the sorted suffixes of the test items.

Spark cuts the test items into chunks of bounded size and writes an index of
each to the shared folder.  A task gathers blocks of documents up to a bounded
size and passes over the chunks once for all of them; the driver knows the paths
only.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combisieve.llm.columns import array_udf
from combisieve.llm.files import partition_id, read_whole, write_whole
from combisieve.llm.words import ALNUM, Block, blocks, mix
from combisieve.session import scratch_path

#: Words of test items in one chunk (about 100 MB in a task).
CHUNK_WORDS = 1_000_000
#: Text that a task gathers before it passes over several chunks.
GATHER_BYTES = 16 << 20
#: A suffix takes part if so many words begin some window.
HEAD_WORDS = 3

MATCH = "struct<start:bigint,n_words:bigint,item_id:string,item_start:bigint>"
SCHEMA = f"struct<n_words:bigint,n_hit:bigint,items:array<string>,longest:{MATCH},spans:array<struct<start:bigint,end:bigint>>>"
_ARROW_MATCH = pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())])
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Items(NamedTuple):
    """Test items in the form in which a task searches them."""

    vocabulary: np.ndarray  # sorted word hashes; a word's code is its place + 1
    by_length: dict[int, tuple[np.ndarray, list[list[int]]]]  # window length: distinct windows, items of each
    heads: dict[int, tuple[int, np.ndarray]]  # window length: words looked at, sorted keys of the windows' beginnings
    names: list[str]  # ascending
    codes: bytes  # all items, a 0 after each
    order: np.ndarray  # suffix array of ``codes``
    ends: np.ndarray  # place after the last word of each item
    longest: int  # words of the longest item
    window: int  # words of a window of an item that has so many


def _as_bytes(codes: np.ndarray) -> np.ndarray:
    """Rows of codes as byte strings that sort like the rows."""
    return np.ascontiguousarray(codes.astype(">u4")).view(f"S{4 * codes.shape[1]}")[:, 0]


def prepare(names: list[str], texts: list[str | None], window: int) -> Items:
    """Index of some test items; items without words match nothing."""
    parts = [(block.hashes(), block.first) for _, block in blocks(pa.array(texts, pa.string()), ALNUM, fold_case=True)]
    vocabulary = np.unique(np.concatenate([h for h, _ in parts])) if parts else np.zeros(0, np.uint64)
    coded = [np.searchsorted(vocabulary, h[a:b]) + 1 for h, first in parts for a, b in zip(first[:-1], first[1:], strict=True)]
    found: dict[int, dict[bytes, list[int]]] = {}
    for item, codes in enumerate(coded):
        n = min(window, len(codes))
        whole = codes.astype(">u4").tobytes()
        for at in range(len(codes) - n + 1 if n else 0):
            owners = found.setdefault(n, {}).setdefault(whole[4 * at : 4 * (at + n)], [])
            if not owners or owners[-1] != item:
                owners.append(item)
    by_length, heads = {}, {}
    for n, owned in found.items():
        keys = sorted(owned)
        by_length[n] = np.frombuffer(b"".join(keys), f"S{4 * n}"), [owned[k] for k in keys]
        head = min(n, HEAD_WORDS)
        heads[n] = head, np.unique(_head_key(np.frombuffer(b"".join(keys), ">u4").reshape(-1, n)[:, :head]))
    joined = np.concatenate([np.append(c, 0) for c in coded]) if coded else np.zeros(0, np.int64)
    ends = np.cumsum([len(c) + 1 for c in coded], dtype=np.int64) - 1
    longest = max(map(len, coded), default=0)
    return Items(vocabulary, by_length, heads, names, joined.astype(">u4").tobytes(), _suffix_array(joined, longest), ends, longest, window)


def _head_key(rows: np.ndarray) -> np.ndarray:
    key = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        key = mix(key + rows[:, k].astype(np.uint64))
    return key


def _suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` in order, by doubling the words compared."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth and len(codes) > 1:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable")


class Shard:
    """Suffix array of a block of documents, of the suffixes whose first words
    begin a window; compared by as many words as a window has."""

    def __init__(self, block: Block, hashes: np.ndarray, items: Items) -> None:
        place = np.searchsorted(items.vocabulary, hashes)
        place[place == len(items.vocabulary)] = 0
        known = items.vocabulary[place] == hashes if len(items.vocabulary) else np.zeros(len(hashes), bool)
        self.window = max(items.by_length, default=1)
        # a code 0 is a word of no item; zeros after each document end its suffixes
        gap = self.window
        shift = block.doc * gap
        self.codes = np.zeros(len(hashes) + gap * (block.n_docs + 1), np.int64)
        self.codes[np.arange(len(hashes)) + shift] = np.where(known, place + 1, 0)
        at = np.arange(len(hashes))[known] + shift[known]
        kept = np.zeros(len(at), bool)
        for head, keys in items.heads.values():
            mine = _head_key(np.stack([self.codes[at + k] for k in range(head)], 1))
            place = np.searchsorted(keys, mine)
            place[place == len(keys)] = 0
            kept |= keys[place] == mine
        at = at[kept]
        self.suffix = _as_bytes(np.stack([self.codes[at + k] for k in range(self.window)], 1)) if len(at) else np.zeros(0, "S4")
        order = np.argsort(self.suffix, kind="stable")
        self.suffix, self.at = self.suffix[order], at[order]
        self.word = self.at - shift_of(self.at, block, gap)
        self.doc = block.doc[self.word] if len(self.word) else np.zeros(0, np.int64)

    def ranges(self, windows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place + 1 of the suffixes that begin with each window."""
        if n == self.window:
            return np.searchsorted(self.suffix, windows), np.searchsorted(self.suffix, windows, side="right")
        low = np.searchsorted(self.suffix, windows.astype(self.suffix.dtype))
        after = np.frombuffer(windows.tobytes(), ">u4").reshape(-1, n).copy()
        after[:, -1] += 1
        return low, np.searchsorted(self.suffix, _as_bytes(after).astype(self.suffix.dtype))


def shift_of(at: np.ndarray, block: Block, gap: int) -> np.ndarray:
    """How far code positions are moved by the gaps before their document."""
    begins = block.first[:-1] + np.arange(block.n_docs) * gap
    return (np.searchsorted(begins, at, side="right") - 1) * gap


def _longest(codes: bytes, items: Items) -> tuple[int, int, int]:
    """Longest common beginning with any test suffix: words, the first item that
    has it, first word."""
    suffix = lambda p: items.codes[4 * p : 4 * p + len(codes)]
    at = bisect.bisect_left(items.order, codes, key=suffix)
    longest = 0
    for near in (at - 1, at):
        if 0 <= near < len(items.order):
            p = int(items.order[near])
            item = int(np.searchsorted(items.ends, p))
            n = min(len(codes) // 4, int(items.ends[item]) - p)
            same = np.frombuffer(codes[: 4 * n], ">u4") == np.frombuffer(items.codes[4 * p : 4 * (p + n)], ">u4")
            run = n if same.all() else int(np.argmin(same))
            longest = max(longest, run)
    same = lambda p: items.codes[4 * p : 4 * (p + longest)]
    low = bisect.bisect_left(items.order, codes[: 4 * longest], key=same)
    high = bisect.bisect_right(items.order, codes[: 4 * longest], lo=low, key=same)
    at = items.order[low:high]
    item = np.searchsorted(items.ends, at)
    first = at - np.concatenate([[0], items.ends[:-1] + 1])[item]
    least = int(item.min())  # names are sorted, and some may be equal
    return longest, least, int(first[item < bisect.bisect_right(items.names, items.names[least])].min())


class Found:
    """What is found in the documents of one block, over all chunks."""

    def __init__(self, block: Block) -> None:
        self.block, self.hashes = block, block.hashes()
        self.hit = np.zeros(len(block.start) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(block.n_docs)]
        self.longest: list[tuple[int, int, str, int] | None] = [None] * block.n_docs

    def search(self, items: Items) -> None:
        shard = Shard(self.block, self.hashes, items)
        if not len(shard.at):
            return
        whole = np.zeros(0, np.int64)  # places of windows of full length
        for n, (windows, owners) in items.by_length.items():
            low, high = shard.ranges(windows, n)
            some = np.flatnonzero(high > low)
            counts = high[some] - low[some]
            place = np.repeat(low[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            which = np.repeat(some, counts)
            word = shard.word[place]
            np.add.at(self.hit, word, 1)
            np.add.at(self.hit, word + n, -1)
            pairs = np.unique(np.stack([shard.doc[place], which], 1), axis=0)
            for doc, w in pairs.tolist():
                self.items[doc].update(items.names[i] for i in owners[w])
            if n == items.window:
                whole = place
                continue
            # a shorter item is matched whole: the first place in each document
            order = np.argsort(word)
            docs, first = np.unique(shard.doc[place[order]], return_index=True)
            for doc, i in zip(docs.tolist(), order[first].tolist(), strict=True):
                self._offer(doc, int(word[i]), n, items.names[owners[which[i]][0]], 0)
        whole = whole[np.argsort(shard.word[whole])]
        before, known = -2, 0
        for word_i, doc_i, at_i in zip(shard.word[whole].tolist(), shard.doc[whole].tolist(), shard.at[whole].tolist(), strict=True):
            # inside the match that began one word earlier nothing is longer
            known = known - 1 if word_i == before + 1 else 0
            before = word_i
            tail = shard.codes[at_i : at_i + items.longest]
            if known and (known >= len(tail) or tail[known] == 0):
                continue  # the next word is in no item
            n, item, first = _longest(tail.astype(">u4").tobytes(), items)
            known = n
            self._offer(doc_i, word_i, n, items.names[item], first)

    def _offer(self, doc: int, word: int, n: int, name: str, first: int) -> None:
        match = (word - int(self.block.first[doc]), n, name, first)
        if self.longest[doc] is None or _place_of(match) < _place_of(self.longest[doc]):
            self.longest[doc] = match

    def arrays(self) -> list[pa.Array]:
        block = self.block
        hit = np.cumsum(self.hit[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        # a run of hit words may go over the end of a document into the next
        starts, ends = edge[::2], edge[1::2]
        spans: list[list[dict]] = [[] for _ in range(block.n_docs)]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            while a < b:
                d = int(block.doc[a])
                to = min(b, int(block.first[d + 1]))
                spans[d].append({"start": a - int(block.first[d]), "end": to - int(block.first[d])})
                a = to
        total = np.concatenate([[0], np.cumsum(hit)])
        match = [None if m is None else {"start": m[0], "n_words": m[1], "item_id": m[2], "item_start": m[3]} for m in self.longest]
        return [
            pa.array(block.n_words, pa.int64()),
            pa.array(total[block.first[1:]] - total[block.first[:-1]], pa.int64()),
            pa.array([sorted(x) for x in self.items], pa.list_(pa.string())),
            pa.array(match, _ARROW_MATCH),
            pa.array(spans, _ARROW_SPANS),
        ]


def _place_of(match: tuple[int, int, str, int]) -> tuple:
    """Longest first, then by place in the text, item and place in the item."""
    start, n_words, item, first = match
    return -n_words, start, item, first


def write_chunks(items: DataFrame, window: int) -> list[str]:
    """Paths of the chunks of test items (``id``, ``text``, ``words``: about its
    words), each a pickled ``Items`` in the shared folder, written by tasks.

    Items are dealt by hash; a task cuts its sorted share whenever a chunk is
    full, so that no chunk is larger than ``CHUNK_WORDS`` and one item, and a task
    that is run again writes the same files.
    """
    folder = scratch_path(items.sparkSession, "items")
    items = items.distinct()
    limit = CHUNK_WORDS
    parts = (items.agg(F.sum("words")).first()[0] or 0) // limit + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, written, names, texts, held = partition_id(), 0, [], [], 0

        def chunk() -> pa.RecordBatch:
            path = f"{folder}/{part}-{written}"
            write_whole(path, [pickle.dumps(prepare(names, texts, window))])
            return pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

        for batch in batches:
            for name, text, words in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                names.append(name)
                texts.append(text)
                held += words
                if held >= limit:
                    yield chunk()
                    written, names, texts, held = written + 1, [], [], 0
        if names:
            yield chunk()

    sorted_items = items.repartition(parts, "id", "text").sortWithinPartitions("id", "text")
    return sorted(r["path"] for r in sorted_items.mapInArrow(run, "path string").collect())


def _load(path: str) -> Items:
    return pickle.loads(read_whole(path))


def _gathered(batches: Iterator[pa.Array], size: int) -> Iterator[list[list[Found]]]:
    """The blocks of some batches with at least ``size`` bytes in all."""
    held, total = [], 0
    for texts in batches:
        held.append([Found(block) for _, block in blocks(texts, ALNUM, fold_case=True)])
        total += sum(len(found.block.buf) for found in held[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def locate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, name: str = "found",
) -> DataFrame:
    """``docs`` with a struct ``name`` that tells what of ``benchmark`` the text holds.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
    A window is ``window`` consecutive words of an item; an item of fewer words
    is one window.  ``n_hit`` words of the text lie inside an occurrence of a
    window, ``spans`` are their runs (word numbers, end exclusive), ``items`` the
    ids of items with occurring windows as sorted strings, ``longest`` the
    longest verbatim match that begins with a window of its item and where it stands in text and item (of several the
    first in the text, then that of the smallest item id, then the first in it).

    A NULL or empty text has no words; an item without words matches nothing; an
    item with a NULL id is listed as ``null``; items that share an id are listed
    once; an empty benchmark hits nothing.  Rows are judged one by one: repeated
    rows get equal results and other columns pass through (one called ``name``
    is replaced).
    """
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"),
        F.coalesce(F.col(item_text), F.lit("")).alias("text"),
        (F.octet_length(F.coalesce(F.col(item_text), F.lit(""))) / 2 + 1).cast("bigint").alias("words"),
    )
    paths = write_chunks(items, window)
    at_once = GATHER_BYTES if len(paths) > 1 else 0  # a single chunk stays

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = _load(paths[0]) if len(paths) == 1 else None
        for gathered in _gathered(batches, at_once):
            for path in paths:
                chunk = kept or _load(path)
                for results in gathered:
                    for result in results:
                        result.search(chunk)
            for results in gathered:
                columns = [result.arrays() for result in results]
                names = ["n_words", "n_hit", "items", "longest", "spans"]
                types = [pa.int64(), pa.int64(), pa.list_(pa.string()), _ARROW_MATCH, _ARROW_SPANS]
                merged = [pa.concat_arrays([c[i] for c in columns]) if columns else pa.array([], t) for i, t in enumerate(types)]
                yield pa.StructArray.from_arrays(merged, names)

    return docs.withColumn(name, array_udf(run, SCHEMA)(F.col(text)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` without any hit, with their own columns only.

    Rows are judged one by one: repeated rows stay or go together, a NULL or
    empty text stays, an empty table gives an empty table, an empty benchmark
    keeps every row.
    """
    rows = docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    return locate(rows, benchmark, "__text", window=window, name="__found").filter("__found.n_hit = 0").select("__row.*")

