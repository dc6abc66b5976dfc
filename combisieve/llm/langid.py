"""Language identification by compression: a text is encoded with one zstandard
raw-content dictionary per language; the language whose dictionary gives the
smallest output is chosen, and rejected where the margin is narrow."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combisieve.llm.columns import array_udf

#: The dictionaries are fitted on a bounded sample of the labelled rows: of each
#: language one row for each of so many hash buckets, of each row so many
#: characters from a place that a hash picks.
SAMPLE_ROWS, SAMPLE_CHARS = 96, 1200
#: A text is encoded whole, in pieces of so many bytes, so that its own words
#: don't stand in for the dictionary's.
PIECE_BYTES = 2048
#: Deep enough to find short matches.
LEVEL = 12
#: Below this share of the second smallest size the margin is narrow.
MIN_MARGIN = 0.02
UNKNOWN = "und"

SCHEMA = "struct<lang:string,score:double,margin:double,rejected:boolean>"
_LETTERS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    languages: list[str]
    dictionaries: list[bytes]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Dictionaries from rows with text and language.

    The sample is chosen by hashes of the text, so that reruns agree and copies
    count once; ``rows * chars`` characters per language come to the driver.
    Rows with NULL in either column are left out.  Without rows there are no
    languages.
    """
    key = F.xxhash64("text")
    begin = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.char_length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    found = (
        labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .filter("text is not null and lang is not null")
        .select("lang", F.pmod(key, F.lit(rows)).alias("bucket"), F.struct(key, F.substr(F.col("text"), begin, F.lit(chars)).alias("piece")).alias("one"))
        .groupBy("lang", "bucket")
        .agg(F.min("one").alias("one"))
        .select("lang", "bucket", "one.piece")
        .collect()
    )
    pieces: dict[str, list[tuple[int, str]]] = {}
    for row in found:
        pieces.setdefault(row["lang"], []).append((row["bucket"], row["piece"]))
    languages = sorted(pieces)
    return Model(languages, ["".join(letters_of(p) for _, p in sorted(pieces[x])).encode() for x in languages])


def letters_of(text: str) -> str:
    """What is encoded: the runs of letters, lower-cased, with a space around
    each; marks and figures say nothing of the language."""
    return " ".join(["", *_LETTERS.findall(text.lower()), ""])


class Coder:
    """The encoders of a model."""

    def __init__(self, model: Model) -> None:
        self.languages = model.languages
        self.encoders = []
        for content in model.dictionaries:
            # raw content: no entropy tables, only text to refer to
            own = zstandard.ZstdCompressionDict(content or b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=own, compression_params=params))

    def sizes(self, text: str) -> np.ndarray:
        raw = text.encode()
        parts = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        return np.array([sum(len(e.compress(p)) for p in parts) for e in self.encoders], np.float64)

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        """``(language, score, margin, rejected)``; ties go to the first name."""
        if not text or not self.languages or not _LETTERS.search(text):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(letters_of(text))
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.languages[0], 1.0, 1.0, False
        second = float(np.partition(sizes, 1)[1])
        margin = (second - float(sizes[best])) / second
        # every percent of the size counts as a factor of e
        score = 1 / float(np.exp(np.clip(-100 * (sizes - sizes[best]) / sizes[best], -700, 0)).sum())
        return self.languages[best], score, margin, margin < MIN_MARGIN


def identify(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct ``name``: ``lang`` (``und`` where the text is NULL or
    has no letter, or nothing was learned), ``score`` from 0 to 1, ``margin``
    between the two smallest sizes as a share of the second, ``rejected``.

    Rows are judged one by one by their text alone: repeated rows get equal
    results, an empty table gives an empty table, other columns pass through
    (one called ``name`` is replaced).
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Coder(model)
        for texts in batches:
            rows = [coder.judge(t.as_py()) for t in texts]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "score", "margin", "rejected"])

    return docs.withColumn(name, array_udf(run, SCHEMA)(F.col(text)))
