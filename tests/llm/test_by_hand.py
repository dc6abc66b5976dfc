"""Own signals of op4, op9 and op10, and the words that op1 takes, derived anew."""

import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from combisieve.llm import langid, mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repetition(text: str) -> tuple[int, dict[int, int], bool]:
    """Characters in later copies of lines and of n-grams, and the verdict."""
    spans = [m.span() for m in WORD.finditer(text)]
    words, chars = [text[a:b] for a, b in spans], [b - a for a, b in spans]
    seen, line_chars = set(), 0
    for line in text.split("\n"):
        own = sum(map(len, WORD.findall(line)))
        if own and line in seen:
            line_chars += own
        seen.add(line)
    grams = {}
    for n in quality.MAX_NGRAM_SHARE:
        first, inside = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if gram in first:
                inside.update(range(i, i + n))
            first.add(gram)
        grams[n] = sum(chars[i] for i in inside)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {w for w in windows if windows.count(w) > 1}
    repeated = len({i + k for i, w in enumerate(windows) if w in again for k in range(5)})
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    bad = line_chars > quality.MAX_LINE_SHARE * sum(chars) or any(grams[n] > s * sum(chars) for n, s in quality.MAX_NGRAM_SHARE.items())
    return line_chars, grams, not failed and not bad


def test_repetition_shares(spark):
    pick = random.Random(21)
    texts = ["", " \n\t", "a b c", "\n".join(line for i in range(4) for line in ("alphabetic betatron gammadelta", f"q{i} r{i} s{i}"))]
    for _ in range(60):
        lines = [" ".join(f"w{pick.randrange(pick.choice((9, 60, 900)))}é"[: pick.randrange(2, 6)] for _ in range(pick.randrange(1, 14))) for _ in range(pick.randrange(1, 9))]
        lines += [pick.choice(lines) for _ in range(pick.choice((0, 0, 1, 4)))]
        pick.shuffle(lines)
        texts.append(pick.choice(("\n", " \n", " ")).join(lines))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    verdicts = set()
    for r in quality.judge(df).collect():
        line_chars, grams, kept = repetition(r.text)
        assert (r.signals.dup_line_chars, r.signals.dup_ngram_chars, r.kept) == (line_chars, grams, kept)
        verdicts.add((r.base_failed, r.kept))
    assert verdicts == {(True, False), (False, False), (False, True)}


def test_shards_in_key_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0")).withColumn("text", F.when(F.col("doc_id") % 10 > 3, F.col("text")).otherwise(F.lit("copy of one text")))
    rows = sharding.shard_documents(docs, 8).withColumn("key", sharding.key_of(F.col("doc_id"), F.col("text"))).collect()
    rows.sort(key=lambda r: (r["key"], r["doc_id"]))
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    total, below, slot, last = sum(r["size"] for r in rows), 0, 0, 0
    for r in rows:
        if r["shard"] != last:
            assert r["shard"] == last + 1
            # the row at the border decides how far it may be off
            assert abs(below - r["shard"] * total / 8) <= max(sharding.TOLERANCE * total / 8, r["size"], size)
            slot, last = 0, r["shard"]
        assert r["slot"] == slot
        slot, below, size = slot + 1, below + r["size"], r["size"]
    assert last == 7


def test_sizes_of_a_plain_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter("doc_id % 2 = 0"))
    params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
    coders = []
    for content in model.dictionaries:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=langid.LEVEL)
        coders.append(zstandard.ZstdCompressor(dict_data=own, compression_params=params))
    for r in langid.identify(docs.filter("doc_id % 5 = 1").drop("lang"), model).collect():
        raw = "".join(f" {w}" for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()))
        if not raw:
            assert r.language.lang == "und"
            continue
        raw = (raw + " ").encode()
        sizes = [sum(len(c.compress(raw[i : i + langid.PIECE_BYTES])) for i in range(0, len(raw), langid.PIECE_BYTES)) for c in coders]
        best, second = sorted(sizes)[:2]
        assert r.language.lang == model.languages[sizes.index(best)]
        assert r.language.margin == pytest.approx((second - best) / second) and r.language.rejected == ((second - best) / second < langid.MIN_MARGIN)


def test_taken_words_are_those_of_the_slots(spark):
    """Every slot is a run of words of its source's line; sums by document agree."""
    pick = random.Random(6)
    items = [(i, " ".join(f"d{i}w{k}" for k in range(pick.choice((0, 1, 7, 40)))), pick.choice(("a", "b", None))) for i in range(80)]
    df = spark.createDataFrame(items, "doc_id bigint, text string, source string")
    mixed = mixing.mix(df, block_words=16, shard_slots=8)
    line, taken = {}, {}
    for e in mixed.entries.collect():
        text = next(t for i, t, _ in items if i == e.key.doc)
        words = text.split()
        for k, w in enumerate(words):
            line[e.source_index, e.first_word + k] = w
    seen = {}
    for p in mixed.pieces.collect():
        taken[p.key.doc] = taken.get(p.key.doc, 0) + p.n
        for k in range(p.n):
            place = p.source_index, p.first + k
            assert line[place] == f"d{p.key.doc}w{p.begin + k}" and place[1] // 16 == p.block
            seen[place] = seen.get(place, 0) + 1
    assert max(seen.values()) <= mixing.MAX_REPEATS
    for r in mixed.taken().collect():
        assert r.taken == taken.get(r.key.doc, 0) <= mixing.MAX_REPEATS * r["size"]
    by_source = {}
    for r in mixed.taken().collect():
        by_source.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(n - t) <= 1 for n, t in by_source.values())
