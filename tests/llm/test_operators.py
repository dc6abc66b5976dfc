"""Operators against brute force, round trips and odd rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from combisieve.llm import decontam, jaccard, langid, licenses, mixing, pii, quality, sharding, tokenbin, warc
from combisieve.llm.words import SPACED, Block

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED_WORD, ALNUM_WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, source string, size string, n_chars bigint"


def rows():
    """Texts with NULLs, blanks, ties, repeats, a long one and near copies."""
    pick = random.Random(5)
    words = ["Alpha", "beta", "gämma", "δ", "e-f", "x1", "the", "of", "and", "zeta,"]
    long = " ".join(pick.choice(words) + str(pick.randrange(400)) for _ in range(3000))
    near = [long.replace("x1", "y1", k) for k in (1, 2)]
    texts = [None, "", " \t\n", "one two", "one two", "One  TWO", "a\na\n\nb\na", "w " * 40, long, long, *near, "é" * 9, "#$ %&|<>"]
    texts += [" ".join(pick.choice(words) for _ in range(pick.randrange(1, 60))) for _ in range(40)]
    out = [(i, t, [None, "s1", "s2", "sé"][i % 4], "own", 1) for i, t in enumerate(texts)]
    return [*out, (None, "one two", None, None, None), out[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, empty):
    got = {(r.doc_id, r.text): r for r in quality.judge(docs).collect()}
    for doc_id, text, *_ in rows():
        words = SPACED_WORD.findall(text or "")
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(grams) < 200 else None
        seen, again = set(), 0
        for line in (text or "").split("\n"):
            if SPACED_WORD.search(line):
                again += line in seen
                seen.add(line)
        s = got[doc_id, text].signals
        assert (s.n_words, s.word_chars, s.n_dup_lines) == (len(words), sum(map(len, words)), again)
        assert s.n_symbols == sum(c in quality.SYMBOLS for c in text or "")
        assert inside is None or s.n_repeat_words == len(inside)
    assert quality.judge(docs).count() == len(rows())
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.judge(empty).count() == 0


def components(items, n, percent):
    sets = []
    for _, text, *_ in items:
        w = SPACED_WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]))
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, item in enumerate(items):
        ids = [x[0] for j, x in enumerate(items) if find(j) == find(i) and x[0] is not None]
        out.append((item[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else item[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard(docs, empty, n, percent):
    got = jaccard.similar_classes(docs, n=n, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == components(rows(), n, percent)
    assert jaccard.similar_classes(empty).count() == 0


def test_jaccard_tiles_of_a_large_block(spark, monkeypatch):
    pick = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    items = []
    for i in range(60):
        own = list(base)
        for _ in range(pick.randrange(4)):
            own[pick.randrange(60)] = f"v{pick.randrange(9)}"
        items.append((i, " ".join(own[: pick.randrange(45, 60)])))
    monkeypatch.setattr(jaccard, "RUN_SETS", 7)
    got = jaccard.similar_classes(spark.createDataFrame(items, "doc_id bigint, text string"), n=2, percent=80)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == components(items, 2, 80)


def test_linked_sets_share_enough_bands():
    pick = np.random.default_rng(1)
    for size in (7, 20, 100, 400):
        for _ in range(20):
            a = np.unique(pick.integers(0, 2**64 - 1, size, dtype=np.uint64))
            lost = int(pick.integers(0, size // 10 + 1))
            b = np.unique(np.concatenate([pick.permutation(a)[lost:], pick.integers(0, 2**64 - 1, lost // 2, dtype=np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if 100 * inter < 80 * (len(a) + len(b) - inter) or np.array_equal(a, b):
                continue
            k = max(jaccard.size_class(len(a), 80), jaccard.size_class(len(b), 80))
            (x, need_x), (y, need_y) = jaccard.band_keys(a, k, 80), jaccard.band_keys(b, k, 80)
            assert len(np.intersect1d(x, y)) >= max(1, min(need_x, need_y))


def test_linked_small_sets_share_a_choice():
    """Sets of which many bands are empty, or nearly so, too."""
    pick = np.random.default_rng(8)
    seen = 0
    for percent in (80, 85, 50):
        for size in [*range(2, 46)] * 12:
            a = np.unique(pick.integers(0, 2**64 - 1, size, dtype=np.uint64))
            lost, new = int(pick.integers(0, 3 + size // 9)), int(pick.integers(0, 3 + size // 9))
            b = np.unique(np.concatenate([pick.permutation(a)[lost:], pick.integers(0, 2**64 - 1, new, dtype=np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if not len(b) or 100 * inter < percent * (len(a) + len(b) - inter) or np.array_equal(a, b):
                continue
            k = max(jaccard.size_class(len(a), percent), jaccard.size_class(len(b), percent))
            (x, need_x), (y, need_y) = jaccard.band_keys(a, k, percent), jaccard.band_keys(b, k, percent)
            assert len(np.intersect1d(x, y)) >= max(1, min(need_x, need_y))
            seen += 1
    assert seen > 300


def test_candidates_do_not_depend_on_buckets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    few, many = (sorted(map(tuple, jaccard.candidates(docs, 5, 80, parts).collect())) for parts in (4, 400))
    assert few == many and few and len(few) == len(set(few))


def templated(n: int, seed: int = 1) -> list[tuple[int, str]]:
    """Short texts of one template with five words from small lists."""
    pick = random.Random(seed)
    gap = lambda c, m: f"{c}{pick.randrange(m)}"
    return [(i, f"the {gap('a', 40)} house in {gap('b', 60)} with {gap('c', 30)} rooms is for {gap('d', 50)} since the {gap('e', 40)} year") for i in range(n)]


def test_blocks_of_templated_texts_do_not_grow_together(spark, monkeypatch):
    """No two different ones can link; the pairs that are multiplied must not
    grow with the square of the table."""
    work = {}
    for n in (1000, 4000):
        sets = len({t for _, t in templated(n)})
        edges = jaccard.candidates(spark.createDataFrame(templated(n), "doc_id bigint, text string").select("text"), 4, 85, 4).cache()
        hopeful = {r.src for r in edges.select("src").distinct().collect()}
        blocks = {}
        for r in jaccard.component_roots(edges).collect():
            if r.node in hopeful:
                blocks[r.root] = blocks.get(r.root, 0) + 1
        work[n] = sum(b * (b - 1) // 2 for b in blocks.values())
        assert max(blocks.values(), default=0) < sets // 20
    assert work[4000] < 8 * max(work[1000], 200)


def test_keep_one(docs):
    kept = jaccard.keep_one(docs, n=4, percent=85).collect()
    assert [r.doc_id for r in kept].count(3) == 1
    assert {4, 9}.isdisjoint({r.doc_id for r in kept}) and None in {r.doc_id for r in kept}


def test_keep_one_of_texts_that_share_an_id(spark):
    base, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    items = [
        (1, base), (2, base + " more"), (2, other),  # a near copy and a clean text under one id
        (3, third), (3, third + " more"), (3, third.upper()), (3, "short and clean words of its own"),  # near copies under one id
        (4, " "), (4, " "), (4, ""), (None, base), (None, base),
    ]
    kept = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(items, "doc_id bigint, text string"), n=4).collect()]
    assert [t for i, t in kept if i == 1] == [base] and [t for i, t in kept if i == 2] == [other]
    threes = [t for i, t in kept if i == 3]
    assert len(threes) == 2 and "short and clean words of its own" in threes
    assert sorted(t for i, t in kept if i == 4) == ["", " "] and kept.count((None, base)) == 2


def test_decontamination(spark, docs, empty, monkeypatch):
    long = rows()[8][1]
    items = [(1, " ".join(long.split()[50:75])), (2, "One two"), (3, None), (4, ""), (5, "zzz"), (None, "one TWO"), (1, "e f"), (6, " ".join(long.split()[60:75]) + " other words")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for doc_id, text, *_ in rows():
        w = ALNUM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for item, t in items:
            q = ALNUM_WORD.findall((t or "").translate(LOWER))
            n = min(10, len(q))
            for i in range(len(q) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == q[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item) if item is not None else "null")
        want[doc_id, text] = (len(w), len(hit), sorted(found))
    matches = []
    for chunk, gather in ((10**6, 10**6), (12, 10**6), (12, 100)):
        monkeypatch.setattr(decontam, "CHUNK_WORDS", chunk)
        monkeypatch.setattr(decontam, "GATHER_BYTES", gather)
        got = decontam.locate(docs, bench).collect()
        assert {(r.doc_id, r.text): (r.found.n_words, r.found.n_hit, r.found["items"]) for r in got} == want
        matches.append({(r.doc_id, r.text): r.found.longest for r in got})
    assert matches[0] == matches[1] == matches[2]
    best = next(r.found.longest for r in got if r.doc_id == 8)
    assert (best.item_id, best.n_words) == ("1", len(ALNUM_WORD.findall(items[0][1])))
    assert decontam.keep_clean(docs, bench.filter("false")).count() == len(rows())
    assert decontam.locate(empty, bench).count() == 0


def longest_match(text, items, window):
    """The first of the longest runs of words that text and item share; a run
    begins with a window of the item."""
    w, best = text.split(), None
    for item, t in items:
        q = t.split()
        for i in range(len(w)):
            for j in range(len(q)):
                k = 0
                while i + k < len(w) and j + k < len(q) and w[i + k] == q[j + k]:
                    k += 1
                if k >= min(window, len(q)):
                    found = (-k, i, item, j)
                    best = found if best is None else min(best, found)
    return best and (best[1], -best[0], best[2], best[3])


def test_longest_matches_by_brute_force(spark, monkeypatch):
    pick = random.Random(9)
    text = lambda n: " ".join(pick.choice("abc") for _ in range(n))
    items = [(str(pick.randrange(6)), text(pick.randrange(1, 14) if i % 4 else 7)) for i in range(12)]
    texts = [(i, text(pick.randrange(40))) for i in range(40)]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = {i: longest_match(t, items, 6) for i, t in texts}
    for chunk in (10**6, 20):
        monkeypatch.setattr(decontam, "CHUNK_WORDS", chunk)
        got = decontam.locate(docs, bench.unionByName(bench), window=6).collect()
        assert {r.doc_id: r.found.longest and tuple(r.found.longest) for r in got} == want


def test_chunks_of_a_benchmark(spark, monkeypatch):
    """Every item is in one chunk, once; chunks are of bounded size, whatever
    their number, and the driver has their paths only."""
    items = [(f"i{i % 90}", f"w{i} " * (1 + i % 9), 1 + i % 9) for i in range(300)]
    df = spark.createDataFrame(items + items[:100] * 3, "id string, text string, words bigint").repartition(5)
    monkeypatch.setattr(decontam, "CHUNK_WORDS", 100)
    loaded = [sorted(zip(c.names, np.diff(c.ends, prepend=-1).tolist(), strict=True)) for c in map(decontam._load, decontam.write_chunks(df, 10))]
    assert sorted(x for c in loaded for x in c) == sorted((i, n + 1) for i, _, n in items)
    assert len(loaded) > 10 and all(sum(n - 1 for _, n in c) < 100 + 9 for c in loaded)
    again = [sorted(zip(c.names, np.diff(c.ends, prepend=-1).tolist(), strict=True)) for c in map(decontam._load, decontam.write_chunks(df.repartition(3), 10))]
    assert again == loaded
    assert decontam.write_chunks(df.filter("false"), 10) == []


def test_clean_rows_keep_their_columns(spark):
    items = [(1, "a b c", "x", "own"), (1, "a b c", "y", None), (2, "d e f", "x", "z"), (None, None, None, None), (3, "", "q", "q")]
    docs = spark.createDataFrame(items, "doc_id bigint, text string, found string, item_id string")
    bench = spark.createDataFrame([(7, "D E f"), (None, None)], "item_id bigint, text string")
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((i for i in items if i[0] != 2), key=str)
    assert decontam.keep_clean(docs.filter("false"), bench).count() == 0


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_identifiers(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15])


def test_plain_identifiers():
    pick = random.Random(2)
    for alphabet in ("ab.@+-0123459 ()%_", "0123 -+.()1", "a@b.c"):
        for _ in range(3000):
            text = "".join(pick.choice(alphabet) for _ in range(pick.randrange(70)))
            assert pii.base_spans(text) == plain_identifiers(text)


@pytest.mark.parametrize(("text", "kind", "shown", "value"), [
    ("mail bob [at] example [dot] com now", "email", "bob [at] example [dot] com", "bob@example.com"),
    ("аlice@example.com", "email", "аlice@example.com", "alice@example.com"),
    ("dial +1 four four nine, 555 3438", "phone", "+1 four four nine, 555 3438", "+1 4 4 9 555 3438"),
    ("٤111 1111 1111 111١", "card", "٤111 1111 1111 111١", "4111 1111 1111 1111"),
])
def test_disguised_identifiers(text, kind, shown, value):
    found = [s for s in pii.spans_of(text) if s["disguised"]]
    assert [(s["kind"], text[s["start"] : s["end"]], s["value"]) for s in found] == [(kind, shown, value)]


SPELT_CARD = "four one one one " + "one one one one " * 2 + "one one one one"


@pytest.mark.parametrize(("shown", "kind", "value"), [
    ("jane@example[.]com", "email", "jane@example.com"),
    ("jane[@]example.com", "email", "jane@example.com"),
    ("jane (@) mail{.}example dot com", "email", "jane@mail.example.com"),
    ("192 dot 168 dot 10 dot 5", "ip", "192.168.10.5"),
    ("192[dot]168[DOT]10[dot]5", "ip", "192.168.10.5"),
    ("192[.]168[.]1[.]1", "ip", "192.168.1.1"),
    ("192.168 (.) 1 <.> 1", "ip", "192.168.1.1"),
    ("one nine two dot one six eight dot one dot five", "ip", "192.168.1.5"),
    ("One-Nine-Two[.]1 six 8[.]one.five", "ip", "192.168.1.5"),
    ("192 dot one six eight dot 10 dot five", "ip", "192.168.10.5"),
    ("one nine two dot 1 dot 2 dot one six eight", "ip", "192.1.2.168"),
    ("+1 dot 555 dot 123 dot 4567", "phone", "+1.555.123.4567"),
    ("plus one dot five five five dot one two three dot four five six seven", "phone", "+1.555.123.4567"),
    ("plus 1 five five five.one two three.four five six seven", "phone", "+1 555.123.4567"),
    (SPELT_CARD, "card", "4 " + " ".join("1" * 15)),
])
def test_disguised_by_dot_signs(shown, kind, value):
    for text in (shown, f"see ({shown}), now", f"é {shown} é"):
        found = [s for s in pii.spans_of(text) if s["disguised"]]
        assert [(s["kind"], text[s["start"] : s["end"]], s["value"]) for s in found] == [(kind, shown, value)]


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("x" * 300 + " at example dot com", "email", "x" * 300 + "@example.com"),
    (".".join("abcdefghijklmnopqrst") + " at ex dot com", "email", ".".join("abcdefghijklmnopqrst") + "@ex.com"),
    ("jane at " + "d" * 64 + " dot com", "email", "jane@" + "d" * 64 + ".com"),
    ("jane at " + " dot ".join("abcdefghijkl"), "email", "jane@" + ".".join("abcdefghijkl")),
    ("zero " * 40 + "one dot two dot three dot four", "ip", "0" * 40 + "1.2.3.4"),
    ("plus 1 2 3 4 5 6 7 one two.three", "phone", "+1 2 3 4 5 6 7 12.3"),
])
def test_disguised_of_any_length(text, kind, value):
    found = [s for s in pii.spans_of(text) if s["disguised"] and s["kind"] == kind]
    assert [s["value"] for s in found] == [value]


def test_masked_identifiers(spark):
    items = [(1, "mail bob [at] example [dot] com or 1.2.3.4"), (2, None), (3, ""), (1, "mail bob [at] example [dot] com or 1.2.3.4")]
    df = spark.createDataFrame(items, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in pii.mask_identifiers(df).collect()), key=str)
    assert got == sorted([(1, "mail <EMAIL> or <IP>"), (2, None), (3, ""), (1, "mail <EMAIL> or <IP>")], key=str)
    assert pii.mask_identifiers(df.limit(0)).count() == 0


def test_dot_signs_without_identifiers():
    for text in ("300 dot 1 dot 2 dot 3", "one dot two dot three", "ask one. Two dot com", "1 9 2 dot one", "f\u0131ve two three four", "\u017fix dot \u017fix"):
        assert pii.spans_of(text) == []
    for text in ("one " * 10**5, "one dot " * 10**5, "1[.]" * 10**5, "one-1." * 10**5, "plus 1 1 " * 10**5, "[.]" * 10**5):
        pii.spans_of(text)


def test_identifiers_of_odd_rows(docs, empty):
    assert pii.find_identifiers(docs).count() == len(rows())
    assert all(r.identifiers == [] for r in pii.find_identifiers(docs).filter("text is null").collect())
    assert pii.find_identifiers(empty).count() == 0
    for text in ("1" * 10**5, "a" * 10**5, "1." * 10**5, "a.b" * 10**5 + "@", " at " * 10**4):
        pii.spans_of(text)


def test_languages(spark, docs, empty):
    texts = {"aa": "kata moro lima kana sula meno ", "bb": "wir xen qoz yul wex zin "}
    learn = spark.createDataFrame([(t * 3 + str(i), x) for x, t in texts.items() for i in range(30)] + [(None, "aa"), ("x", None)], "text string, lang string")
    model = langid.fit(learn)
    assert model.languages == ["aa", "bb"]
    coder = langid.Coder(model)
    assert coder.judge("moro kata sula meno lima kana")[0] == "aa" and coder.judge("YUL, WEX! zin qoz xen")[0] == "bb"
    assert coder.judge(None)[0] == coder.judge("12 !!")[0] == "und"
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r.language.score <= 1 for r in got)
    assert langid.identify(empty, langid.fit(learn.filter("false"))).count() == 0


def test_held_out_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = langid.identify(docs.filter(held_out), langid.fit(docs.filter(~held_out))).select((F.col("lang") == F.col("language.lang")).cast("int").alias("ok"))
    assert got.agg(F.avg("ok")).first()[0] > 0.9


def test_bit_packing():
    for bits in (1, 3, 16, 17, 31, 32):
        for n in (0, 1, 63, 64, 65, 5000):
            ids = np.random.default_rng(n).integers(0, 2**bits, n, dtype=np.uint64)
            assert (tokenbin.unpack(tokenbin.pack(ids, bits), n, bits) == ids).all()
            assert len(tokenbin.pack(ids, bits)) == 8 * -(-n * bits // 64)


def test_pieces_in_any_company():
    """Ids of a text depend neither on its neighbours nor on earlier texts."""
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    pieces = ["<|endoftext|>", "<|startoftext|>", "don't", "it's", "x²", "…", "e\u0301", "½", "'s", "A<|endoftext|>b", "İ", "ﬁ", "ª", "ß", "٣", "a\u200db", "abc", "12a", "<|", "|>", "İ<", "—é—", "\u0301"]
    own, each = tokenbin.WordEncoder(path), tokenbin.TextEncoder(path)
    pick = random.Random(9)
    batches = [[a, b] for a in pieces for b in pieces] + [[f"{a} {b}", a + b] for a in pieces for b in pieces]
    batches += [[pick.choice((" ", "")).join(pick.choices(pieces, k=pick.randrange(6))) for _ in range(40)] for _ in range(60)]
    for texts in batches:
        got, lengths = own.encode(pa.array(texts, pa.string()), None)
        want, wanted = each.encode(pa.array(texts, pa.string()), None)
        assert got.tolist() == want.tolist() and lengths.tolist() == wanted.tolist(), texts


def test_token_files(spark, docs, empty, tmp_path, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    texts = [r[1] for r in rows()] + ["It's Don't ÀÉ×÷ß a…, 12.5€ x<|endoftext|>,Y İI ﬁ é", "\x1cab\x85c"]
    by_word, by_text = tokenbin.WordEncoder(path).encode(pa.array(texts), 2), tokenbin.TextEncoder(path).encode(pa.array(texts), 2)
    assert (by_word[0] == by_text[0]).all() and (by_word[1] == by_text[1]).all()
    monkeypatch.setattr(tokenbin, "FILE_TOKENS", 1000)
    written = tokenbin.write_tokens(docs, path, 2, by_word=True, folder=f"file://{tmp_path}/tokens")
    got = tokenbin.read_tokens(written, with_ids=True).orderBy("start").collect()
    assert len(got) == len(rows()) and [r.doc_id for r in got] == sorted((r[0] for r in rows()), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got]])[:-1])
    encoder = tokenbin.TextEncoder(path)
    expected = sorted(tuple(encoder.encode(pa.array([r[1]], pa.string()), 2)[0].tolist()) for r in rows())
    assert sorted(tuple(r.ids) for r in got) == expected
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    one = written.manifest.orderBy(F.desc("n_tokens")).first()
    file = tokenbin.TokenFile(one.path)
    assert (file.tokens(5, 600) == file.tokens(0, file.n_tokens)[5:600]).all()
    assert tokenbin.read_tokens(tokenbin.write_tokens(empty, path, 2)).count() == 0


def test_licenses(spark, docs, empty):
    notice = licenses.TEXTS[0][1]
    extra = [(100, "x Under the MIT License, under the mit-license! CC BY NC", "s", "", 1), (101, "intro " + notice.replace("merge", "join", 1).upper() + " end", "s", "", 1)]
    got = {r.doc_id: r.licenses for r in licenses.find_licenses(docs.unionByName(spark.createDataFrame(extra, SCHEMA))).collect()}
    assert [(p.label, p.start) for p in got[100].places if p.phrase in licenses.BASE_PHRASES] == [("mit", 1), ("mit", 5), ("cc-by-nc", 9)]
    assert any(p.phrase is None and p.label == "mit" and p.score > 0.9 for p in got[101].places)
    assert got[0].n_words == 0 and got[0].places == [] and got[8].places == []
    assert licenses.find_licenses(empty).count() == 0


def listed_licenses(text):
    """Phrases wherever they stand; notices wherever a phrase of theirs says so,
    overlapping ones by the best share of words in place."""
    words = ALNUM_WORD.findall((text or "").translate(LOWER))
    places = lambda phrase: [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    own = {p: label for label, _, ps in licenses.TEXTS for p in ps}
    declaring = licenses.KEY_PHRASES | licenses.BASE_PHRASES
    phrases = {(i, label, p): float(p in declaring) for p, label in (own | declaring).items() for i in places(p.split())}
    notices = set()
    for label, notice, ps in licenses.TEXTS:
        notice = notice.split()
        for p in ps:
            at = [i for i in range(len(notice)) if notice[i : i + len(p.split())] == p.split()]
            for i in places(p.split()):
                for j in at:
                    b = i - j
                    near = lambda k: any(0 <= b + k + s < len(words) and words[b + k + s] == notice[k] for s in range(-licenses.SLACK, licenses.SLACK + 1))  # noqa: B023, E731
                    share = sum(map(near, range(len(notice)))) / len(notice)
                    phrases[i, label, p] = max(phrases[i, label, p], share)
                    if share >= licenses.MIN_COVERAGE:
                        notices.add(label)
    return phrases, notices


def test_licenses_by_brute_force(spark):
    """Copies cut short, shifted, doubled and worn, alone and beside whole ones."""
    pick = random.Random(12)
    texts = ["", "MIT", "Under the MIT License"]
    for _, notice, _ in licenses.TEXTS:
        words = notice.split()
        for n in (len(words), len(words) * 2 // 3 + 1, len(words) // 2):
            texts += [" ".join(words[:n]), "intro of some words " + " ".join(words[:n]) + " and more", " ".join(words[:n] * 2)]
        for _ in range(12):
            worn = [w for w in words for w in ([w] if pick.random() > 0.1 else pick.choice(([], [w, "extra"], ["other"])))]
            cut = pick.randrange(len(worn))
            texts.append(" ".join([*["filler"] * pick.randrange(5), *worn[: max(20, cut)], *pick.choice(([], words))]))
    texts.append(" ".join(licenses.TEXTS[0][1].split()[:38]))  # none of its rarest words
    for chosen in (texts, texts[-1:]):
        df = spark.createDataFrame(list(enumerate(chosen)), "doc_id bigint, text string")
        for r in licenses.find_licenses(df).collect():
            phrases, notices = listed_licenses(r.text)
            assert {(p.start, p.label, p.phrase): p.score for p in r.licenses.places if p.phrase} == pytest.approx(phrases)
            assert {p.label for p in r.licenses.places if not p.phrase} == notices, r.text
    assert notices == {"mit"}


def test_notices_in_the_company_of_other_texts(spark):
    """What stands at the end of one text does not hide a notice that begins in
    the middle of the next one; a worn opening leaves the other phrases."""
    _, notice, (opening, *others) = licenses.TEXTS[0]
    tail = notice[notice.index("to deal in") :]
    worn = notice.replace("hereby", "herewith")
    texts = [opening, tail, "x " + opening, worn, f"{opening} and no more of it", "", "spdx-license-identifier: MIT"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r.licenses.places for r in licenses.find_licenses(df).collect()}
    best = {i: max((p.score for p in places), default=0) for i, places in got.items()}
    assert {p.phrase for p in got[3]} == {None, *others} and 0.9 < best[3] < 1
    assert {p.label for p in got[1] if p.phrase is None} == {"mit"} and 0.6 <= best[1] < 0.8
    assert 0 < best[0] < 0.2 and 0 < best[4] < 0.2 and best[5] == 0 and best[6] == 1
    assert all(f" {p} " in f" {text} " for _, text, inside in licenses.TEXTS for p in inside)


def test_warc(spark, tmp_path):
    long = "<p>" + "x" * 200
    pages = [(5, "http://a.b/x?b=1&a=2", long), (3, "http://www.a.b/", long), (9, None, None), (7, "u", "short"), (8, "u", "short"), (None, "http://c", long), (3, "http://www.a.b/", long), (1, "bad url [", "é\r\n\r\n" * 60)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = warc.capture_histories(df, folder=f"file://{tmp_path}/warc").collect()
    assert [warc._order(r.asDict()) for r in got] == sorted(warc._order(r.asDict()) for r in got) and len(got) == len(pages)
    by_id = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in got}
    assert by_id == {
        5: ("revisit", 3, 203), 3: ("response", None, 203), 9: ("response", None, 0), 7: ("response", None, 5), 8: ("response", None, 5),
        None: ("revisit", 3, 203), 1: ("response", None, 360),
    }
    assert warc.capture_histories(df.filter("false")).count() == 0


def test_loser_tree():
    pick = random.Random(1)
    for k in range(9):
        runs = []
        for r in range(k):
            keys = sorted(pick.randrange(20) for _ in range(pick.randrange(6)))
            runs.append([{"url_key": str(x).zfill(2), "captured": 0, "page_id": i, "run": str(r), "record_offset": i} for i, x in enumerate(keys)])
            runs[-1].sort(key=warc._order)
        assert list(warc.loser_merge(runs)) == sorted((x for run in runs for x in run), key=warc._order)


def test_repeated_rows_keep_their_own_columns(spark):
    items = [(1, "a b c", "s", "en"), (1, "a b c", "s", "de"), (1, "a b c", "s", "de"), (2, "", "s", "x"), (2, "", "s", "y")]
    df = spark.createDataFrame(items, "doc_id bigint, text string, source string, lang string")
    got = mixing.mix(df, block_words=4).documents().collect()
    assert sorted((r.doc_id, r.lang) for r in got) == sorted((i, lang) for i, _, _, lang in items)
    assert all(r.text.split() == ["a", "b", "c"] for r in got if r.doc_id == 1)


def test_blocks_meet_slots_in_a_shuffle(spark, docs):
    """One row per block of the mix on either side: none is broadcast."""
    plan = mixing.mix(docs, block_words=16, shard_slots=8).pieces._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [source_index" in plan and "BroadcastHashJoin [source_index" not in plan


def test_targets_and_mix(spark, docs, empty):
    mixed = mixing.mix(docs, block_words=16, shard_slots=8)
    got = mixed.taken().collect()
    sizes = {}
    for _, text, source, *_ in rows():
        sizes[source] = sizes.get(source, 0) + len(SPACED_WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = {}
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows()) and all(taken[s] == round(target[s]) for s in names)
    again = mixing.mix(docs.repartition(5), block_words=16, shard_slots=8).taken()
    assert sorted((str(r.key), r.taken) for r in again.collect()) == sorted((str(r.key), r.taken) for r in got)
    out = mixed.documents()
    assert out.columns == docs.columns
    assert sum(len(SPACED_WORD.findall(r.text or "")) for r in out.collect()) == sum(taken.values())
    own = {}
    for doc_id, text, *_ in rows():
        own.setdefault(doc_id, set()).update(SPACED_WORD.findall(text or ""))
    assert all(own[r.doc_id].issuperset(SPACED_WORD.findall(r.text or "")) for r in out.collect())
    blocks = mixed.blocks().collect()
    assert sum(len(SPACED_WORD.findall(b.text)) for b in blocks) == sum(taken.values()) and all(len(SPACED_WORD.findall(b.text)) <= 16 for b in blocks)
    assert mixing.mix(empty).taken().count() == 0 and mixing.mix(empty).documents().count() == 0


def test_permutation():
    for n in (1, 2, 7, 64, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_shards(spark, docs, empty):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = sharding.shard_documents(many, 8).collect()
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
        assert r["size"] == len(r.text.encode()) + 1
    total = sum(r["size"] for r in got)
    assert sorted(by_shard) == list(range(8)) and len(got) == 4000
    for part in by_shard.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 8) < 0.01 * total / 8
    odd = sharding.shard_documents(docs, 8).collect()
    assert len(odd) == len(rows()) and all(r["size"] == len((r.text or "").encode()) + 1 for r in odd)
    assert sharding.shard_documents(empty, 8).count() == 0


def test_hashes_do_not_depend_on_neighbours():
    alone = Block(pa.array(["café"]), SPACED, False).hashes()[0]
    big = Block(pa.array(["x " * 200000 + "café", None, "café "]), SPACED, False)
    assert big.hashes()[-1] == alone and big.hashes()[-2] == alone
