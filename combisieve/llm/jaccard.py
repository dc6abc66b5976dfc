"""N-gram Jaccard self-join: a blocked sparse product of the document by
n-gram incidence matrix.

1. Documents with the same set of n-grams form a class; one row stands for it.
2. *Blocks.*  Two sets of sizes a, b with ``100 * inter >= percent * union``
   differ in at most ``(100 - percent) * (a + b) / (100 + percent)`` n-grams.
   Cut the hash range into more bands than that, and all bands but so many hold
   the same n-grams in both.  Small sets are keyed by each choice of so many
   bands at once, larger ones by each band.  Sets that share fewer keys with
   others have no link; each of the rest tells the lowest set of its keys, once,
   and components of that are the blocks, so that no link leaves a block.
3. *Product.*  In a block, sets sorted by size are cut into runs; a task takes
   two runs, multiplies their incidence columns slice by slice, adds up the
   overlap counts and discards pairs below the bound that their sizes set.  Run
   pairs whose sizes cannot reach it are never formed.  A task returns its link
   counts and a spanning forest of its links, not the links.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from combisieve.llm.columns import array_udf
from combisieve.llm.components import component_roots
from combisieve.llm.words import SPACED, Block, blocks, mix, ngrams
from combisieve.operators.skew import attach_totals, broadcast_if_small
from combisieve.session import cut_lineage

#: A run holds about so many sets, and so many n-grams, at most.
RUN_SETS, RUN_GRAMS = 512, 2_000_000
SLICE_COLUMNS = 4096
BUCKETS_PER_PARTITION = 2
#: Up to so many rows of two longs (16 MB) are broadcast, more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Postings that a task gathers before it deals them out (20 bytes each).
HELD_POSTINGS = 500_000
#: Sets that a task remembers to have told already; only saves work.
REMEMBERED = 200_000
#: By the largest difference: how many bands linked sets agree on, out of so many
#: and the difference.  A key of several bands holds most of a small set, which a
#: text from the same template with other words in its gaps does not share.
AGREED = {1: 3, 2: 3, 3: 3, 4: 2, 5: 2, 6: 2}
#: Keys with few n-grams are cut further, so often at most.
LEVELS = 2


def sets_of(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, ascending within each text, and the offsets of
    the texts.  A text of fewer words has one n-gram, its whole sequence."""
    hashes = block.hashes()
    gram, at = ngrams(hashes, block.doc, n)
    doc = block.doc[at]
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < n))
    whole = np.array([_sequence(hashes[block.first[d] : block.first[d + 1]]) for d in short], np.uint64)
    gram, doc = np.concatenate([gram, whole]), np.concatenate([doc, short])
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[fresh], doc[fresh]
    return gram, np.searchsorted(doc, np.arange(block.n_docs + 1))


def _sequence(words: np.ndarray) -> np.uint64:
    h = np.array([len(words)], np.uint64)
    for w in words:
        h = mix(h ^ w)
    return h[0]


def set_id(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit id of each whole set (0 for the empty one)."""
    size = np.diff(first)
    out = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        starts = first[:-1][full]
        a = np.add.reduceat(mix(gram ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
        b = np.bitwise_xor.reduceat(mix(gram + np.uint64(0x632BE59BD9B4E019)), starts)
        out[full] = mix(mix(a) ^ (b + size[full].astype(np.uint64)))
    return out


@functools.cache
def size_limits(percent: int) -> list[int]:
    """Largest size of each interval of sizes.  ``percent`` of the lowest size of
    the next but one is above the largest size of this, so that a set can only
    be linked with sets of its own interval and the two beside it."""
    limits = [1]
    while limits[-1] < 1 << 40:
        low = limits[-1] + 1
        limits.append(max(low, low * 100 // percent))
    return limits


def size_class(n: int, percent: int) -> int:
    """Number of the interval of sizes that holds ``n``."""
    return bisect.bisect_left(size_limits(percent), n)


def band_count(k: int, percent: int) -> tuple[int, int]:
    """``(bands, largest difference)`` for pairs whose larger set lies in
    interval ``k``.  Linked sets agree on all bands but so many; a set that
    agrees with others on fewer has no link."""
    d = (100 - percent) * 2 * size_limits(percent)[k] // (100 + percent)
    return d + AGREED.get(d, 1 + max(2, d // 4)), d


@functools.cache
def _choices(bands: int, agreed: int) -> np.ndarray:
    """0/1 rows, one for each choice of ``agreed`` bands."""
    rows = list(combinations(range(bands), agreed))
    out = np.zeros((len(rows), bands), np.uint64)
    out[np.repeat(np.arange(len(rows)), agreed), np.concatenate(rows)] = 1
    return out


def _choice_keys(gram: np.ndarray, bands: int, agreed: int, least: int, salt: int, level: int = 0) -> list[int]:
    """Keys of all choices of bands.  Where these hold fewer than ``least``
    n-grams, sets would share the key by chance: linked sets that do share it
    also agree on as many bands of the other n-grams, dealt anew, so the choice
    is told by keys of those.  What is cut further depends on what such sets
    share, never on the rest, in which they differ."""
    band = ((mix(gram ^ np.uint64(salt)) >> np.uint64(32)) * np.uint64(bands)) >> np.uint64(32)
    count = np.bincount(band.astype(np.int64), minlength=bands).astype(np.uint64)
    content = np.zeros(bands, np.uint64)
    np.add.at(content, band.astype(np.int64), mix(gram + np.uint64(salt)))
    choices = _choices(bands, agreed)
    keys = mix(choices @ mix(content + mix(np.arange(bands, dtype=np.uint64) + np.uint64(salt))) + mix(np.arange(len(choices), dtype=np.uint64) ^ np.uint64(salt)))
    thin = choices @ count < least
    if level == LEVELS or not thin.any():
        return keys.tolist()
    out = keys[~thin].tolist()
    for i in np.flatnonzero(thin):
        rest = gram[choices[i][band.astype(np.int64)] == 0]
        out += _choice_keys(rest, bands, agreed, least, int(keys[i]), level + 1)
    return out


def band_keys(gram: np.ndarray, k: int, percent: int) -> tuple[np.ndarray, int]:
    """Keys of the bands of one set for interval ``k`` (the lowest bit tells an
    odd ``k``), and how many of them a partner must have too.  Bands without
    n-grams have no key, unless so many are empty that they may be all that
    agrees."""
    bands, d = band_count(k, percent)
    if d == 0:
        return np.zeros(0, np.uint64), 1  # equal sets only: one class already
    if d in AGREED:
        least = max(2, size_limits(percent)[k] * AGREED[d] // (3 * bands))
        key = np.array(_choice_keys(gram, bands, AGREED[d], least, k + 1), np.uint64)
        return (key & ~np.uint64(1)) | np.uint64(k & 1), 1
    band = ((gram >> np.uint64(32)) * np.uint64(bands)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
    content = np.add.reduceat(mix(gram ^ np.uint64(k + 1)), starts)
    own = band[starts]
    need = bands - d - (bands - len(own))
    if need <= 0:
        own = np.arange(bands, dtype=np.uint64)
        full = np.zeros(bands, np.uint64)
        full[band[starts].astype(np.int64)] = content
        content, need = full, 1
    key = mix(content + mix(own + (np.uint64(k + 1) << np.uint64(40))))
    return (key & ~np.uint64(1)) | np.uint64(k & 1), need


def _described(n: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, block in blocks(texts, SPACED, fold_case=True):
                gram, first = sets_of(block, n)
                sizes.append(np.diff(first))
                ids.append(set_id(gram, first))
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(ids).view(np.int64), pa.int64())], ["n", "id"]
            )

    return array_udf(run, "struct<n:bigint,id:bigint>")


def _set_column(n: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ids, grams = [], []
            for _, block in blocks(texts, SPACED, fold_case=True):
                gram, first = sets_of(block, n)
                ids.append(set_id(gram, first))
                grams.extend(gram[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True))
            yield pa.StructArray.from_arrays(
                [pa.array((np.concatenate(ids) if ids else np.zeros(0, np.uint64)).view(np.int64), pa.int64()), pa.array(grams, pa.binary())], ["id", "grams"]
            )

    return array_udf(run, "struct<id:bigint,grams:binary>")


#: A band key of a set, and how many of its keys must be shared.
POSTING = np.dtype([("key", "<u8"), ("own", "<i8"), ("need", "<u4")])
#: A shared key, told by its lowest set.
SHARED = np.dtype([("own", "<i8"), ("low", "<i8"), ("need", "<u4"), ("odd", "u1")])


def _dealt(found: Iterator[np.ndarray], by: Callable[[np.ndarray], np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, postings) rows by the high bits of ``by``.  A task gathers its
    postings first, so it makes few rows for each bucket."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        postings = np.concatenate(held)
        bucket = ((by(postings) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        postings = postings[order]
        full = np.flatnonzero(np.diff(cut))
        payload = pa.array([postings[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), payload], ["bucket", "payload"])

    held, count = [], 0
    for postings in found:
        if len(postings):
            held.append(postings)
            count += len(postings)
        if count > HELD_POSTINGS:
            yield flush(held)
            held, count = [], 0
    if count:
        yield flush(held)


def _by_bucket(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """All postings of each bucket (the rows of a task are sorted by bucket)."""
    at, parts = None, []
    for batch in batches:
        for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != at and parts:
                yield np.frombuffer(b"".join(parts), kind)
                parts = []
            at = bucket
            parts.append(payload)
    if parts:
        yield np.frombuffer(b"".join(parts), kind)


def _emit_bands(n: int, percent: int, buckets: int):
    """Postings of all bands, dealt by key."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        seen: set[int] = set()  # classes already told by this task
        for batch in batches:
            for _, block in blocks(batch.column(0), SPACED, fold_case=True):
                gram, first = sets_of(block, n)
                for d, own in enumerate(set_id(gram, first).view(np.int64).tolist()):
                    size = int(first[d + 1] - first[d])
                    if not size or own in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(own)
                    k = size_class(size, percent)
                    for other in (k, k + 1):
                        key, need = band_keys(gram[first[d] : first[d + 1]], other, percent)
                        postings = np.empty(len(key), POSTING)
                        postings["key"], postings["own"], postings["need"] = key, own, need
                        yield postings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(found(batches), _by_key, buckets)

    return run


def _by_key(postings: np.ndarray) -> np.ndarray:
    return postings["key"]


def _by_set(postings: np.ndarray) -> np.ndarray:
    return mix(postings["own"].view(np.uint64))


def _shared(postings: np.ndarray) -> np.ndarray:
    """Postings, once each, whose key more than one set has."""
    postings = postings[np.lexsort((postings["own"], postings["key"]))]
    key, own = postings["key"], postings["own"]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    postings = postings[fresh]
    key, own = postings["key"], postings["own"]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sets = np.diff(np.append(first, len(key)))
    out = np.empty(len(key), SHARED)
    out["own"], out["low"], out["need"], out["odd"] = own, np.repeat(own[first], sets), postings["need"], key & np.uint64(1)
    return out[np.repeat(sets > 1, sets)]


def _collisions(buckets: int):
    """Shared keys, dealt by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(map(_shared, _by_bucket(batches, POSTING)), _by_set, buckets)

    return run


def _enough(shared: np.ndarray) -> np.ndarray:
    """Rows of sets that share as many keys as a linked set must."""
    shared = shared[np.lexsort((shared["odd"], shared["own"]))]
    own, odd = shared["own"], shared["odd"]
    starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (odd[1:] != odd[:-1])]))
    counts = np.diff(np.concatenate([starts, [len(own)]]))
    return shared[np.repeat(counts >= shared["need"][starts], counts)]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set that is ``_enough`` with the lowest sets of its keys, once each,
    and with itself.  All keys of a set are in one bucket, so the number of
    buckets does not matter."""
    for shared in _by_bucket(batches, SHARED):
        found = _enough(shared)
        own = np.unique(found["own"])
        edges = np.unique(np.stack([np.concatenate([found["own"], own]), np.concatenate([found["low"], own])], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["src", "dst"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, lowest node) of the components of edges a-b."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Overlap counts of all pairs of sets, as a product of 0/1 incidence
    matrices taken column slice by column slice."""
    sets = left if right is None else left + right
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column_of = np.concatenate(sets)
    order = np.argsort(column_of, kind="stable")
    column_of, rows = column_of[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], column_of[1:] != column_of[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(column_of)]]))
    shared = np.repeat(counts > 1, counts)  # a column with one entry adds to no pair
    rows, column = rows[shared], np.repeat(np.cumsum(counts > 1) - 1, counts)[shared]
    total = np.zeros((len(left), len(sets) - len(left) if right is not None else len(left)), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, SLICE_COLUMNS):
        i, j = np.searchsorted(column, (at, at + SLICE_COLUMNS))
        part = np.zeros((len(sets), min(SLICE_COLUMNS, last - at)), np.float32)
        part[rows[i:j], column[i:j] - at] = 1
        total += part[: len(left)] @ (part.T if right is None else part[len(left) :].T)
    return total


def _linked(percent: int):
    """Per tile: how many links each set has in it, and its spanning forest."""
    schema = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("n_links", pa.int64())])

    def solve(diagonal: bool, rows: list[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
        unique = {(second, own): grams for own, second, grams in rows}
        left = sorted(own for second, own in unique if not second)
        right = sorted(own for second, own in unique if second)
        a = [np.frombuffer(unique[False, x], np.uint64) for x in left]
        b = a if diagonal else [np.frombuffer(unique[True, x], np.uint64) for x in right]
        if not a or not b:
            return
        inter = overlaps(a, None if diagonal else b).astype(np.int64)
        na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ok = 100 * inter >= percent * (na[:, None] + nb[None, :] - inter)
        if diagonal:
            np.fill_diagonal(ok, False)
        left_ids, right_ids = np.array(left), np.array(left if diagonal else right)
        x, y = np.nonzero(ok)
        if not len(x):
            return
        links = dict(zip(left_ids.tolist(), ok.sum(1).tolist(), strict=True))
        if not diagonal:
            links |= dict(zip(right_ids.tolist(), ok.sum(0).tolist(), strict=True))
        nodes, roots = _forest(left_ids[x], right_ids[y])
        root_of = dict(zip(nodes.tolist(), roots.tolist(), strict=True))
        found = [k for k, v in links.items() if v]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int64()), pa.array([root_of.get(k, k) for k in found], pa.int64()), pa.array([links[k] for k in found], pa.int64())],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for block, i, j, own, second, grams in zip(*cols, strict=True):
                if (block, i, j) != at and rows:
                    yield from solve(at[1] == at[2], rows)
                    rows = []
                at = (block, i, j)
                rows.append((own, second, grams))
        if rows:
            yield from solve(at[1] == at[2], rows)

    return run


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """``(block, i, j, id, second)``: the tiles of its block that each set takes
    part in.  A run is named by interval of sizes and number; a tile joins two
    runs of one interval or of neighbouring ones.  Small blocks are one tile."""
    limits = size_limits(percent)
    # intervals up to 2**40 n-grams: a fixed list of about 130 limits
    interval = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x < F.col("n")))
    members = members.withColumn("k", interval)
    counts = members.groupBy("block", "k").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"))
    runs = F.greatest(F.ceil(F.col("sets") / RUN_SETS), F.ceil(F.col("grams") / RUN_GRAMS)).cast("int")
    # at most one row per interval of sizes in a window
    whole, order = W.partitionBy("block"), W.partitionBy("block").orderBy("k")
    near = lambda f, step: F.when(f("k").over(order) == F.col("k") + step, f("runs").over(order)).otherwise(0)
    counts = counts.withColumn("runs", runs).select(
        "block", "k", "sets", "runs", near(F.lag, -1).alias("below"), near(F.lead, 1).alias("above"),
        ((F.sum("sets").over(whole) <= RUN_SETS) & (F.sum("grams").over(whole) <= RUN_GRAMS)).alias("small"),
    )
    placed = attach_totals(members, counts, ["block", "k"], "sets", ["id"])
    own = F.pmod(F.xxhash64("id"), F.col("runs")).cast("int")
    name = lambda k, run: k.cast("bigint") * F.lit(1 << 40) + run
    k, u = F.col("k"), F.col("own")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda i, j, second: F.struct(i.alias("i"), j.alias("j"), second.alias("second"))
    same = F.transform(numbers(F.col("runs")), lambda v: tile(name(k, F.least(u, v)), name(k, F.greatest(u, v)), u > v))
    above = F.transform(numbers(F.col("above")), lambda v: tile(name(k, u), name(k + 1, v), F.lit(False)))
    below = F.transform(numbers(F.col("below")), lambda v: tile(name(k - 1, v), name(k, u), F.lit(True)))
    zero = F.lit(0).cast("bigint")
    tiles = F.when(F.col("small"), F.array(tile(zero, zero, F.lit(False)))).otherwise(F.concat(same, above, below))
    return placed.withColumn("own", own).select("block", "id", F.inline(tiles))


def similar_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """``(doc_id, n_shingles, set_id, n_links, component_id)``, one row per row of ``docs``.

    A document's set: its distinct n-grams of words (A-Z lower-cased, split at
    ASCII white space); with fewer words the whole sequence is its only n-gram.
    Two documents link when ``100 * inter >= percent * union``.  ``set_id`` names
    the set, ``n_links`` counts the other distinct sets linked with it, and
    ``component_id`` is the smallest doc_id reachable by links, itself included.

    A NULL, empty or blank text has the empty set: no links, its component is
    its own id.  Repeated rows are copies like others.  A NULL id stays NULL but
    takes part in links; a component without any other id is NULL.  Columns
    other than the two are ignored; an empty table gives an empty table.  Sets
    are compared by 64-bit hashes of their n-grams.
    """
    return _rooted_classes(docs, doc_id, text, n, percent).drop("__root")


def candidates(docs: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """``(src, dst)``: set ids whose components hold all links (``docs`` has a
    column ``text``).  A set that may have a link is with itself, too."""
    buckets = parts * BUCKETS_PER_PARTITION
    held = "bucket int, payload binary"
    # by number, so that each task gets as many buckets
    dealt = lambda df: df.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket")
    bands = docs.select("text").mapInArrow(_emit_bands(n, percent, buckets), held)
    shared = dealt(bands).mapInArrow(_collisions(buckets), held)
    return dealt(shared).mapInArrow(_candidates, "src bigint, dst bigint")


def _rooted_classes(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """``similar_classes`` with ``__root``, which names the component even where
    components share their smallest id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    described = cut_lineage(docs.select("doc", _described(n)("text").alias("s")).select("doc", F.col("s.n").alias("n"), F.col("s.id").alias("id")))
    classes = described.filter("n > 0").groupBy("id").agg(F.min("doc").alias("low"), F.first("n").alias("n"))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = cut_lineage(candidates(docs, n, percent, parts))
    block_of, hopeful = component_roots(told), told.select(F.col("src").alias("own")).distinct()
    members = block_of.join(hopeful, F.col("node") == F.col("own")).join(classes, F.col("node") == classes.id).select("id", F.col("root").alias("block"), "low", "n")
    members = cut_lineage(members)
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("sets"))
    members = cut_lineage(attach_totals(members, sizes, ["block"], "sets", ["id"]).filter("sets > 1").drop("sets"))
    wanted = broadcast_if_small(members.select("low", F.col("id").alias("member")), BROADCAST_ROWS)
    tiles = _tiles(members, percent)
    sets = (
        docs.join(wanted, F.col("doc").eqNullSafe(F.col("low")))
        .select("member", _set_column(n)("text").alias("s"))
        .filter("member = s.id")
        .select(F.col("s.id").alias("id"), F.col("s.grams").alias("grams"))
    )
    linked = cut_lineage(
        tiles.join(sets, "id")
        .select("block", "i", "j", "id", "second", "grams")
        .repartition(parts, "block", "i", "j")
        .sortWithinPartitions("block", "i", "j")
        .select("block", "i", "j", "id", "second", "grams")
        .mapInArrow(_linked(percent), "id bigint, root bigint, n_links bigint")
    )
    counts = linked.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    roots = component_roots(linked.select(F.col("id").alias("src"), F.col("root").alias("dst")).filter("src <> dst"))
    lows = classes.join(roots, classes.id == roots.node, "left").select("id", F.coalesce("root", "id").alias("root"), "low")
    lowest = lows.groupBy("root").agg(F.min("low").alias("component"))
    by_set = lows.join(lowest, "root").join(counts, "id", "left").select(F.col("id").alias("set"), "root", "component", F.coalesce("n_links", F.lit(0)).alias("links"))
    return described.join(by_set, F.col("id") == F.col("set"), "left").select(
        F.col("doc").alias(doc_id),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("id")).alias("set_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "doc").alias("component_id"),
        F.col("root").alias("__root"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row with
    the smallest id stays; where that id has several of its texts, the one with
    the lowest hashes.  Texts that share an id are judged one by one.  Rows
    without an id always stay, rows without words once per id and text."""
    classes = cut_lineage(_rooted_classes(docs, doc_id, text, n, percent).filter(F.col(doc_id).isNotNull() & F.col("set_id").isNotNull()))
    above = classes.filter(F.col("component_id") < F.col(doc_id)).select(F.col(doc_id).alias("__gone"), F.col("set_id").alias("__gone_set")).distinct()
    lowest = classes.filter(F.col("component_id") == F.col(doc_id)).groupBy("__root", doc_id)
    sets = lowest.agg(F.array_sort(F.collect_set("set_id")).alias("__sets")).filter("size(__sets) > 1")
    gone = above.unionByName(
        sets.select(F.col(doc_id).alias("__gone"), F.explode(F.slice("__sets", F.lit(2), F.size("__sets") - 1)).alias("__gone_set"))
    )
    rows = docs.select(F.struct("*").alias("__row"), F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__mark"), _described(n)(F.col(text)).alias("__s"))
    rows = rows.select("__row", "__id", "__mark", F.when(F.col("__s.n") > 0, F.col("__s.id")).alias("__set"))
    free = rows.filter("__id is null").select("__row.*")
    left = rows.filter("__id is not null").join(gone, (F.col("__id") == F.col("__gone")) & (F.col("__set") == F.col("__gone_set")), "left_anti")
    blank = F.when(F.col("__set").isNull(), F.col("__mark")).alias("__blank")
    once = left.groupBy("__id", "__set", blank).agg(F.min_by("__row", "__mark").alias("__row"))
    return once.select("__row.*").unionByName(free)
