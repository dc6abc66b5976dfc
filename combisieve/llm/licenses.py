"""Licence scan with a positional rare-token index.

Templates (key phrases and notice texts) are indexed by word and position.  For
each template the words with the highest inverse document frequency, taken over
the whole table, are looked up in a file; their postings give the places where
the template would stand.  A phrase must then match word by word.  A text must
have several rare words at the same relative position, enough of its words in
place, and one of its mandatory key phrases inside.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combisieve.llm.columns import array_udf
from combisieve.llm.words import ALNUM, Block, blocks

# Phrases that name a licence, and the label of each.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further phrases of the method's own that declare a licence.
KEY_PHRASES = {
    "spdx license identifier mit": "mit",
    "the mit license": "mit",
    "spdx license identifier apache 2 0": "apache-2",
    "apache 2 0 license": "apache-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under the apache license": "apache-2",
}
# Notice texts, and phrases of which one must stand inside.
TEXTS = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        ("permission is hereby granted free of charge", "to deal in the software without restriction", "permit persons to whom the software is furnished to do so"),
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        ("licensed under the apache license", "apache license version 2", "you may not use this file except in compliance with the license"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software", "for any purpose with or without fee is hereby granted"),
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation either version 3",),
    ),
    (
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation either version 2",),
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu lesser general public license as published by the free software foundation",),
    ),
    (
        "agpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu affero general public license as published by the free software foundation",),
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at http mozilla org mpl 2 0",
        ("subject to the terms of the mozilla public license v 2 0", "a copy of the mpl was not distributed with this file"),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by "
        "any means",
        ("free and unencumbered software released into the public domain",),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
        "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
        "commercial applications and to alter it and redistribute it freely",
        ("permission is granted to anyone to use this software for any purpose including commercial applications",),
    ),
)
#: Phrases that declare a licence by themselves.  The others are parts of a
#: notice and count for as much of it as stands around them.
DECLARING = frozenset(BASE_PHRASES) | frozenset(KEY_PHRASES)
#: Rare words of a text that are looked up, and how many must agree on a place.
TEXT_ANCHORS, MIN_AGREEING = 8, 2
#: Share of a text's words that must stand in place, give or take ``SLACK`` words.
MIN_COVERAGE, SLACK = 0.6, 2

SCHEMA = "struct<n_words:bigint,places:array<struct<label:string,start:bigint,n_words:bigint,score:double,phrase:string>>>"
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("phrase", pa.string())]))


class Template(NamedTuple):
    label: str
    words: np.ndarray  # codes
    phrase: str | None  # of a phrase template
    inside: tuple[str, ...]  # phrases of which one must stand in a text


class Index(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes; a word's code is its place + 1
    templates: list[Template]
    postings: dict[int, list[tuple[int, int]]]  # code of a rare word: (template, position)
    inside: dict[int, list[tuple[str, int]]]  # template: its mandatory phrases and where they stand in it


def _hashes(text: str) -> np.ndarray:
    return Block(pa.array([text]), ALNUM, fold_case=True).hashes()


def vocabulary() -> np.ndarray:
    every = [*BASE_PHRASES, *KEY_PHRASES, *[t for _, t, _ in TEXTS], *[p for _, _, ps in TEXTS for p in ps]]
    return np.unique(np.concatenate([_hashes(t) for t in every]))


def build_index(frequency: Mapping[int, int]) -> Index:
    """Index of all templates; ``frequency``: in how many files each code stands."""
    words = vocabulary()
    code = lambda text: np.searchsorted(words, _hashes(text)) + 1
    own = {p: label for label, _, phrases in TEXTS for p in phrases}
    phrases = own | KEY_PHRASES | BASE_PHRASES
    templates = [Template(label, code(p), p, ()) for p, label in phrases.items()]
    templates += [Template(label, code(text), None, inside) for label, text, inside in TEXTS]
    postings: dict[int, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        # highest inverse document frequency first, then the code, so that reruns
        # agree; words that stand in no file come last: looking them up finds nothing
        rare = sorted(set(template.words.tolist()), key=lambda c: (not frequency.get(c, 0), frequency.get(c, 0), c))
        for c in rare[: TEXT_ANCHORS if template.phrase is None else 1]:
            at = np.flatnonzero(template.words == c).tolist()
            for position in at if template.phrase is None else at[:1]:
                postings.setdefault(c, []).append((t, position))
    inside = {
        t: [(p, i) for p in template.inside for i in range(len(template.words)) if np.array_equal(template.words[i : i + len(code(p))], code(p))]
        for t, template in enumerate(templates)
    }
    return Index(words, templates, postings, inside)


def _codes(block: Block, words: np.ndarray) -> np.ndarray:
    hashes = block.hashes()
    place = np.searchsorted(words, hashes)
    place[place == len(words)] = 0
    return np.where(words[place] == hashes, place + 1, 0)


def file_frequency(docs: DataFrame, text: str) -> dict[int, int]:
    """In how many texts of the whole table each template word stands: one row
    per template word comes to the driver."""
    words = vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            for _, block in blocks(batch.column(0), ALNUM, fold_case=True):
                codes = _codes(block, words)
                known = np.flatnonzero(codes)
                pairs = np.unique(block.doc[known] * (len(words) + 1) + codes[known])
                total += np.bincount(pairs % (len(words) + 1), minlength=len(words) + 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["code", "files"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "code bigint, files bigint")
    return {r["code"]: r["files"] for r in counted.groupBy("code").agg(F.sum("files").alias("files")).collect()}


def scan(block: Block, index: Index) -> list[list[dict]]:
    """Places of templates in each text of ``block``, by start, then label."""
    codes = _codes(block, index.vocabulary)
    n = len(codes)
    found: list[list[tuple]] = [[] for _ in range(block.n_docs)]
    rare = np.isin(codes, np.array(list(index.postings), np.int64))
    at = np.flatnonzero(rare)
    # a place is a text and the word where the template would begin, which may
    # lie before the text or after it
    wide = n + 2 * max(len(t.words) for t in index.templates)
    where_of = lambda word, position: block.doc[word] * wide + word - position + (wide - n) // 2
    begins: dict[int, list[np.ndarray]] = {}
    for c, posted in index.postings.items():
        where = at[codes[at] == c]
        if len(where):
            for t, position in posted:
                begins.setdefault(t, []).append(where - position if index.templates[t].phrase is not None else where_of(where, position))
    exact: dict[str, np.ndarray] = {}
    for t, template in enumerate(index.templates):
        if t not in begins or template.phrase is None:
            continue
        start = np.concatenate(begins[t])
        size = len(template.words)
        start = start[(start >= 0) & (start + size <= n)]
        start = start[block.doc[start] == block.doc[start + size - 1]] if len(start) else start
        for k, c in enumerate(template.words.tolist()):
            start = start[codes[start + k] == c]
        exact[template.phrase] = np.unique(start)
    none = np.zeros(0, np.int64)
    shares: dict[tuple[str, int], float] = {}  # mandatory phrase and its place: share of the notice around it
    for t, template in enumerate(index.templates):
        if template.phrase is not None:
            continue
        size = len(template.words)
        begin = none
        if t in begins:
            begin, agreeing = np.unique(np.concatenate(begins[t]), return_counts=True)
            begin = begin[agreeing >= MIN_AGREEING]
        keys = np.sort(np.concatenate([exact.get(p, none) for p in template.inside]))
        if not len(keys):
            continue
        # a notice holds a mandatory phrase: wherever one stands, a notice may
        # begin that far before it, whatever rare words are left of it
        mandatory = [(p, i, place) for p, i in index.inside[t] for place in exact.get(p, none).tolist()]
        begin = np.union1d(begin, [int(where_of(place, i)) for _, i, place in mandatory]).astype(np.int64)
        share_at: dict[int, float] = {}
        best: list[tuple[float, int, int]] = []  # places, each the best of its copy
        for where in begin.tolist():
            d, b = divmod(where, wide)
            b -= (wide - n) // 2
            lo, hi = int(block.first[d]), int(block.first[d + 1])
            key = int(np.searchsorted(keys, max(b - SLACK * 2, lo)))
            if key >= len(keys) or keys[key] >= min(b + size, hi):
                continue
            places = b + np.arange(size)
            hit = np.zeros(size, bool)
            for s in range(-SLACK, SLACK + 1):
                at_s = (places + s >= lo) & (places + s < hi)
                hit[at_s] |= codes[places[at_s] + s] == template.words[at_s]
            share = share_at[where] = float(hit.mean())
            if share < MIN_COVERAGE:
                continue
            if best and b - best[-1][1] < size // 2 and best[-1][2] == d:
                if share > best[-1][0]:
                    best[-1] = (share, b, d)  # the same copy, better placed
                continue
            best.append((share, b, d))
        for share, b, d in best:
            lo = int(block.first[d])
            found[d].append((max(b, lo) - lo, template.label, size, share, None))
        for p, i, place in mandatory:
            shares[p, place] = max(shares.get((p, place), 0.0), share_at[int(where_of(place, i))])
    for template in index.templates:
        for place in exact.get(template.phrase, none).tolist() if template.phrase is not None else ():
            d = int(block.doc[place])
            score = 1.0 if template.phrase in DECLARING else shares[template.phrase, place]
            found[d].append((place - int(block.first[d]), template.label, len(template.words), score, template.phrase))
    return [
        [{"label": label, "start": start, "n_words": size, "score": score, "phrase": phrase} for start, label, size, score, phrase in sorted(f, key=lambda x: (x[0], x[1], x[2], x[4] or ""))]
        for f in found
    ]


def find_licenses(docs: DataFrame, text: str = "text", name: str = "licenses") -> DataFrame:
    """``docs`` with a struct ``name``: ``n_words`` and ``places``, one for each
    place of the whole text where a licence phrase or notice stands (``label``,
    ``start`` and ``n_words`` in words, ``score``: 1 for
    a phrase that declares a licence, for a notice the share of its words found,
    for a phrase out of a notice the share of that notice around it; ``phrase``:
    NULL for a notice text).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
    A NULL or empty text has no words and no places.  Rows are judged one by one:
    repeated rows get equal results, an empty table gives an empty table, other
    columns pass through (one called ``name`` is replaced).
    """
    index = build_index(file_frequency(docs, text))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n_words, places = [np.zeros(0, np.int64)], []
            for _, block in blocks(texts, ALNUM, fold_case=True):
                n_words.append(block.n_words)
                places += scan(block, index)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n_words), pa.int64()), pa.array(places, _PLACES)], ["n_words", "places"])

    return docs.withColumn(name, array_udf(run, SCHEMA)(F.col(text)))
