"""WARC archives of pages, and their capture index.

Tasks write archives.  Read back, each archive gives a run of captures sorted by
URL key and time.  The runs are dealt by ranges of the key, and each range is
merged k-way with a loser tree, so that the ranges one after the other are the
capture histories of all URLs in order.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combisieve.llm.files import partition_id, place, write_whole
from combisieve.operators.skew import attach_totals
from combisieve.session import cut_lineage, scratch_path

MIN_SHARED_BYTES = 100  # payloads below are never shared
FILE_BYTES = 32 << 20
#: Captures that one task merges.
MERGE_ROWS = 200_000
EPOCH = datetime.datetime(2024, 1, 1)
CAPTURES = "url_key string, captured bigint, page_id bigint, run string, record_offset bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_CAPTURES = pa.schema([
    ("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("run", pa.string()), ("record_offset", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def url_key(url: str | None) -> str:
    """Host labels from the top level down, then path and sorted query."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").strip()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + query if query else ''}".lower()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, captured: int, refers_to: int | None) -> bytes:
    """One gzip member with one WARC record."""
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}")
    one_line = lambda s: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name(f'{page_id}:{digest}')}>"]
    head.append(f"WARC-Date: {(EPOCH + datetime.timedelta(seconds=captured)).isoformat()}Z")
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:uuid:{name(f'{refers_to}:{digest}')}>")
        head.append(f"X-Refers-To-Page: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def records(stream: io.RawIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, headers, block)`` of each record of an archive, read once from
    front to back; one record is held at a time."""
    base, rest = 0, b""
    while True:
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    break
            parts.append(unpacker.decompress(rest))
            used += len(rest) - len(unpacker.unused_data)
            rest = unpacker.unused_data
        if not used:
            return
        if not unpacker.eof:
            raise ValueError("the archive ends inside a record")
        whole = b"".join(parts)
        head, _, body = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield base, headers, body[: int(headers["Content-Length"])]
        base += used


def mark_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``.  Of equal payloads of at
    least ``MIN_SHARED_BYTES`` the one with the smallest page_id is kept whole;
    the others refer to it.  Leaders are found by an aggregate; a payload that
    very many pages share is spread over tasks in the join."""
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    shared = (
        rows.filter(F.octet_length("payload") >= MIN_SHARED_BYTES).groupBy("digest")
        .agg(F.min("page_id").alias("leader"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    )
    known = attach_totals(rows, shared, ["digest"], "__n", ["page_id", "url"])
    other = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader"))
    return known.select("page_id", "url", "payload", "digest", F.when(other, F.col("leader")).alias("refers_to"))


def write_archives(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url", folder: str | None = None) -> DataFrame:
    """Write a record for every row of ``pages`` and return ``(path, n_records)``,
    one row per archive of about ``FILE_BYTES``.

    The payload is the html in UTF-8 (NULL: empty).  The capture time is the
    page_id in seconds after ``EPOCH`` (pages carry no time).  Rows that repeat a
    page_id and its payload are all responses; a NULL page_id refers to the
    smallest other page_id with its payload, if there is one.  A NULL url is left
    out of the record.  Other columns are ignored; an empty table gives no
    archive.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, parts = partition_id(), 0, 0, []

        def flush() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{number:06d}.warc.gz"
            write_whole(path, parts)
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(parts)]}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                own, address, payload, digest, refers_to = (x.as_py() for x in row)
                parts.append(record(own, address, payload, digest, max(0, min(own or 0, 10**10)), refers_to))
                held += len(parts[-1])
                if held >= FILE_BYTES:
                    yield flush()
                    number, held, parts = number + 1, 0, []
        if parts:
            yield flush()

    return cut_lineage(mark_revisits(pages, page_id, html, url).mapInArrow(run, "path string, n_records bigint"))


def read_runs(archives: DataFrame) -> DataFrame:
    """The captures of each archive as a sorted run.  Payload digests of
    responses are computed anew and compared with the record's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = place(path)
                rows = []
                with system.open_input_stream(at, compression=None) as src:
                    for offset, headers, block in records(src):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"damaged record at {offset} of {path}")
                        when = int((datetime.datetime.fromisoformat(headers["WARC-Date"].rstrip("Z")) - EPOCH).total_seconds())
                        number = lambda h, headers=headers: int(headers[h]) if h in headers else None
                        rows.append({
                            "url_key": url_key(headers.get("WARC-Target-URI")), "captured": when, "page_id": number("X-Page-ID"), "run": path,
                            "record_offset": offset, "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"],
                            "refers_to": number("X-Refers-To-Page"),
                        })
                rows.sort(key=_order)
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema=_CAPTURES)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(parts, "path").mapInArrow(run, CAPTURES)


def _order(row: dict) -> tuple:
    own = row["page_id"]
    return row["url_key"], row["captured"], own is not None, own or 0, row["run"], row["record_offset"]


def loser_merge(runs: Sequence[Sequence[dict]]) -> Iterator[dict]:
    """Merge sorted runs.  Inner nodes hold the loser of their match; after a
    winner is taken, its run replays only the matches on its way up."""
    k = len(runs)
    if not k:
        return
    heads = [0] * k
    end = (1,)
    key = lambda r: (0, _order(runs[r][heads[r]])) if heads[r] < len(runs[r]) else end
    keys = [key(r) for r in range(k)]
    losers = [-1] * k
    for r in range(k):
        winner, node = r, (r + k) // 2
        while node > 0 and losers[node] >= 0:
            if keys[losers[node]] < keys[winner]:
                winner, losers[node] = losers[node], winner
            node //= 2
        losers[node] = winner
    while keys[losers[0]] != end:
        r = losers[0]
        yield runs[r][heads[r]]
        heads[r] += 1
        keys[r] = key(r)
        winner, node = r, (r + k) // 2
        while node > 0:
            if keys[losers[node]] < keys[winner]:
                winner, losers[node] = losers[node], winner
            node //= 2
        losers[0] = winner


def merge_runs(captures: DataFrame) -> DataFrame:
    """Globally ordered capture histories: the partitions of the result, and the
    rows in each, follow URL key, time and page_id.

    ``captures`` is read twice (for the borders of the ranges, then to deal).  A
    URL with very many captures is cut by time, so each task merges about
    ``MERGE_ROWS`` captures.
    """
    spark = captures.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // MERGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                runs.setdefault(row["run"], []).append(row)
        out = []
        for row in loser_merge(list(runs.values())):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=_CAPTURES)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_CAPTURES)

    order = ["url_key", "captured", "page_id"]
    # a shuffle may mix the blocks of a run: the sort puts each run in order again
    dealt = captures.repartitionByRange(parts, *order).sortWithinPartitions("run", *order, "record_offset")
    return dealt.mapInArrow(run, CAPTURES)


def capture_histories(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url", folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back and merge their captures."""
    return merge_runs(cut_lineage(read_runs(write_archives(pages, page_id, html, url, folder))))
