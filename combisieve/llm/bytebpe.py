"""Byte-level BPE with the tiktoken library and a local rank file.

The library splits a text by a pattern and merges each match by itself.  Its
pattern engine keeps a stack that grows with a run of white space, so a long
text is handed over in parts that end where a match must end anyway, and a long
run of white space as the one match that it is.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combisieve.llm.columns import array_udf

#: The characters of Unicode's White_Space.
BLANK = r"\t-\r \x85\xa0  -     　"
#: Characters of a text that the library gets at once, about.
PART_CHARS = 1 << 16
#: Longer runs of white space are merged apart from their surroundings.
RUN_CHARS = 1 << 10
#: Ids that are decoded at once.
PART_IDS = 1 << 20

_LONG_RUN = re.compile(f"[{BLANK}]{{{RUN_CHARS},}}")
#: No match goes on from a mark or letter to white space, nor from a mark other
#: than an apostrophe to a letter.
_BORDER = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])|" + r"(?<=[!,.:;?、。，])(?=[A-Za-zぁ-ゖ一-鿿])")


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """``text`` in consecutive parts, and whether a part is one match.

    Matches of the parts, one after the other, are those of the whole text: a
    run of white space before another character leaves its last one to what
    follows, one at the end is a match as a whole.
    """
    at = 0
    for run in _LONG_RUN.finditer(text):
        yield from _cut(text, at, run.start())
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : at], True
    yield from _cut(text, at, len(text))


def _cut(text: str, at: int, end: int) -> Iterator[tuple[str, bool]]:
    while end - at > PART_CHARS:
        border = _BORDER.search(text, at + PART_CHARS, end)
        if border is None:
            break
        yield text[at : border.start()], False
        at = border.start()
    if at < end:
        yield text[at:end], False


class Codec:
    """The library's encoder of a rank file and a pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.make = functools.partial(tiktoken.Encoding, mergeable_ranks=ranks, special_tokens={})
        self.split = self.make("split", pat_str=pattern)
        self.known = np.zeros(max(ranks.values(), default=-1) + 1, bool)
        self.known[list(ranks.values())] = True

    @functools.cached_property
    def whole(self):
        """Takes a text as one match; few texts need it."""
        return self.make("whole", pat_str=r"[\s\S]+")

    def encode(self, text: str) -> np.ndarray:
        ids = [(self.whole if one else self.split).encode_ordinary(part) for part, one in parts(text)]
        return np.concatenate([np.array(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The bytes of ``ids``; None where one of them is not in the rank file."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            return None
        return b"".join(self.split.decode_bytes(ids[i : i + PART_IDS].tolist()) for i in range(0, len(ids), PART_IDS))


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    """One for all tasks of a Python worker; it does not change with use."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with an array ``name`` of the ids of the whole text.

    ``pattern`` splits a text as that of public byte-level vocabularies does
    (letters, digits or marks with at most one blank before them; white space).
    A NULL or empty text has no ids (an empty array).  Rows are encoded one by
    one: repeated rows get equal ids, an empty table gives an empty table, other
    columns pass through (one called ``name`` is replaced).
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for texts in batches:
            rows = [own.encode(t.as_py() or "") for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            yield pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *rows]))

    return docs.withColumn(name, array_udf(run, "array<int>")(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with a binary column ``name``: the bytes of an array of ids.

    They need not be valid UTF-8 where ids were cut.  A NULL or empty array gives
    no bytes (empty), one with a NULL or an unknown id gives NULL.  Rows are
    decoded one by one; an empty table gives an empty table, other columns pass
    through (one called ``name`` is replaced).
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for lists in batches:
            rows = (x.values for x in lists)
            yield pa.array([b"" if r is None else own.decode(r.fill_null(-1).to_numpy(zero_copy_only=False)) for r in rows], pa.binary())

    return docs.withColumn(name, array_udf(run, "binary")(F.col(ids).cast("array<int>")))
