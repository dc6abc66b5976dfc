"""Quality rules: how much of a text lies inside repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combisieve.llm.columns import array_udf
from combisieve.llm.words import SPACED, Block, blocks, ngrams, sums

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
REPEAT_WINDOW, MAX_REPEAT_PERCENT = 5, 20
#: Largest share of the word characters that may lie in n-grams of so many
#: words that stood earlier in the text, and in lines that did.
MAX_NGRAM_SHARE = {5: 0.20, 8: 0.18, 12: 0.15}
MAX_LINE_SHARE = 0.30

FIELDS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "dup_line_chars": pa.int64(),
    "dup_ngram_chars": pa.map_(pa.int32(), pa.int64()),
}
SCHEMA = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "dup_line_chars:bigint,dup_ngram_chars:map<int,bigint>>"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _repeated(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries share their key with another of the same text, and which
    of those are not the first (entries are in text order)."""
    own = key ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    same = ranked[1:] == ranked[:-1]
    later = np.zeros(len(key), bool)
    twice = np.zeros(len(key), bool)
    later[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice | later, later


def _covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words inside any window of ``width`` that starts at ``at``."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, at, 1)
    np.subtract.at(depth, at + width, 1)
    return np.cumsum(depth[:-1]) > 0


def measure(block: Block, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Signals of each text of ``block``."""
    buf, first = block.buf, block.first
    hashes = block.hashes()
    char = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)])
    chars = char[block.end] - char[block.start]
    out = {"n_words": block.n_words, "word_chars": sums(chars, first), "n_symbols": sums(_SYMBOL[buf], block.offsets)}

    breaks = np.flatnonzero(buf == 0x0A)
    line_start = np.unique(np.concatenate([block.offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(buf)]
    line_end = np.concatenate([line_start[1:], [len(buf)]]).astype(np.int64)[: len(line_start)]
    line_end = np.where(buf[line_end - 1] == 0x0A, line_end - 1, line_end) if len(line_start) else line_end
    word_from, word_to = np.searchsorted(block.start, line_start), np.searchsorted(block.start, line_end)
    full = word_to > word_from
    line_start, line_end, word_from, word_to = line_start[full], line_end[full], word_from[full], word_to[full]
    line_doc = block.doc[word_from]
    _, later = _repeated(block.hashes(line_start, line_end), line_doc)
    total = np.concatenate([[0], np.cumsum(chars)])
    line_chars = total[word_to] - total[word_from]
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=block.n_docs)
    out["dup_line_chars"] = np.bincount(line_doc[later], line_chars[later], block.n_docs).astype(np.int64)

    for n in sorted({REPEAT_WINDOW, *lengths}):
        gram, at = ngrams(hashes, block.doc, n)
        twice, later = _repeated(gram, block.doc[at])
        if n == REPEAT_WINDOW:
            out["n_repeat_words"] = sums(_covered(at[twice], n, len(hashes)), first)
        if n in lengths:
            out[f"dup_{n}"] = sums(chars * _covered(at[later], n, len(hashes)), first)
    return out


def repetition_signals(docs: DataFrame, text: str = "text", name: str = "signals", lengths: tuple[int, ...] = tuple(MAX_NGRAM_SHARE)) -> DataFrame:
    """``docs`` with a struct ``name`` of repetition signals of the whole text.

    ``word_chars`` code points in words, ``n_symbols`` characters of ``SYMBOLS``,
    ``n_dup_lines`` lines with a word that equal an earlier line,
    ``n_repeat_words`` words in 5-word windows found twice or more,
    ``dup_line_chars`` / ``dup_ngram_chars[n]`` word characters inside lines /
    n-grams that stood earlier.

    A NULL or empty text has zeros everywhere.  Rows are judged one by one, so
    repeated rows get equal signals, an empty table gives an empty table, and
    other columns pass through (a column called ``name`` is replaced).
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [measure(block, lengths) for _, block in blocks(texts, SPACED)]
            plain = [np.concatenate([p[f] for p in parts]) if parts else np.zeros(0, np.int64) for f in FIELDS if f != "dup_ngram_chars"]
            shares = [np.concatenate([p[f"dup_{n}"] for p in parts]) if parts else np.zeros(0, np.int64) for n in lengths]
            keys = np.tile(np.array(lengths, np.int32), len(texts))
            items = np.stack(shares, 1).reshape(-1) if lengths else np.zeros(0, np.int64)
            maps = pa.MapArray.from_arrays(
                pa.array(np.arange(len(texts) + 1) * len(lengths), pa.int32()), pa.array(keys, pa.int32()), pa.array(items, pa.int64())
            )
            yield pa.StructArray.from_arrays([*[pa.array(x, pa.int64()) for x in plain], maps], fields=[pa.field(k, t) for k, t in FIELDS.items()])

    return docs.withColumn(name, array_udf(run, SCHEMA)(F.col(text)))


def failed_rules(signals: str = "signals", max_ngram_share: Mapping[int, float] = MAX_NGRAM_SHARE, max_line_share: float = MAX_LINE_SHARE) -> dict[str, Column]:
    """Conditions, by name, under which a text is rejected."""
    s = F.col(signals)
    rules = {
        "few_words": s["n_words"] < MIN_WORDS,
        "repeated_words": 100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"],
        "repeated_lines": s["dup_line_chars"] > max_line_share * s["word_chars"],
    }
    for n, share in max_ngram_share.items():
        rules[f"repeated_{n}_grams"] = s["dup_ngram_chars"][n] > share * s["word_chars"]
    return rules


def judge(docs: DataFrame, text: str = "text", name: str = "signals") -> DataFrame:
    """``repetition_signals`` with ``base_failed`` and ``kept``.

    A NULL or empty text has too few words and is rejected.  Existing columns
    called ``base_failed`` or ``kept`` are replaced.
    """
    rules = failed_rules(name)
    base = rules.pop("few_words") | rules.pop("repeated_words")
    other = F.lit(False)
    for rule in rules.values():
        other = other | rule
    return repetition_signals(docs, text, name).withColumns({"base_failed": base, "kept": ~(base | other)})


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns only."""
    return judge(docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text")), "__text", "__signals").filter("kept").select("__row.*")
