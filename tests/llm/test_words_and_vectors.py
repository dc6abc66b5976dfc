"""op11, op12 and op13 against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from combisieve.llm import bytebpe, centroids, queries, spelling

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id bigint, text string, ids string, decoded int, word string, n int"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Lowest rank first, leftmost of equal ones: by the book."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [(ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        rank, i = min(found)
        if rank == math.inf:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


TEXTS = [
    None, "", " ", "  \n", "don't  stop it's  'tis\n\n x", "<|endoftext|> a", "naïve Ünïcode ½ x² ​ 　 ", "日本語。テスト、abc，漢字!ok", "\x1c\x1f a\x85b",
    "😀👍🏽 é", "12345 67,890.5 '", "a" * 3000, "'s" * 50, "end   ",
]


def test_bpe_by_the_book(library):
    own = bytebpe.codec(RANKS, PATTERN)
    for text in TEXTS[1:]:
        by_hand = [i for m in regex.findall(PATTERN, text) for i in merged(m.encode(), library._mergeable_ranks)] if len(text) < 500 else None
        ids = own.encode(text).tolist()
        assert by_hand is None or ids == by_hand
        assert ids == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_bpe_parts_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bytebpe, "PART_CHARS", 3)
    monkeypatch.setattr(bytebpe, "RUN_CHARS", 4)
    monkeypatch.setattr(bytebpe, "_LONG_RUN", re.compile(f"[{bytebpe.BLANK}]{{4,}}"))
    monkeypatch.setattr(bytebpe, "PART_IDS", 5)
    own, pick = bytebpe.Codec(RANKS, PATTERN), random.Random(3)
    signs = "ab'sdtre  \n\t .,;。、、，漢字語éß19½　\x85\x1c😀!?"
    texts = TEXTS[1:] + ["".join(pick.choice(signs) for _ in range(pick.randrange(60))) for _ in range(3000)]
    for text in texts:
        assert own.encode(text).tolist() == library.encode_ordinary(text), repr(text)
        assert "".join(p for p, _ in bytebpe.parts(text)) == text
        assert own.decode(own.encode(text)) == text.encode()


def test_bpe_long_runs(library):
    """The library's pattern engine gives up on such runs."""
    own = bytebpe.codec(RANKS, PATTERN)
    for text in ("a" + " " * 2_000_000 + "b", "x\n" + "\n" * 1_500_000, "é" * 1_000_000, "ab" * 500_000 + "\t" * 9000 + "z", "漢字。" * 200_000):
        assert own.decode(own.encode(text)) == text.encode()
    blanks = library.encode_ordinary(" " * 8000)
    assert own.encode("a" + " " * 8001 + "b").tolist() == library.encode_ordinary("a") + blanks + library.encode_ordinary(" b")


def test_bpe_table(spark, library):
    rows = [(i, t, "own", 7, "w", 1) for i, t in enumerate(TEXTS)] + [(None, "again", None, None, None, None), (4, TEXTS[4], "own", 7, "w", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    coded = bytebpe.encode(docs, RANKS, PATTERN, name="ids")
    got = bytebpe.decode(coded, RANKS, PATTERN).collect()
    assert len(got) == len(rows) and set(coded.columns) == set(docs.columns)
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
        assert r.word in ("w", None)
    odd = spark.createDataFrame([(1, [50256]), (2, [-1]), (3, [None, 5]), (4, None), (5, []), (6, [1, 2])], "i int, ids array<int>")
    told = {r.i: r.decoded for r in bytebpe.decode(odd, RANKS, PATTERN).collect()}
    assert told[1] is None and told[2] is None and told[3] is None and bytes(told[4]) == bytes(told[5]) == b"" and bytes(told[6]) == library.decode_bytes([1, 2])
    assert bytebpe.decode(bytebpe.encode(docs.limit(0), RANKS, PATTERN), RANKS, PATTERN).count() == 0


def test_bpe_query(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows: list[tuple], every: int = 199) -> Counter:
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return Counter({w: n for w, n in words.items() if len(w) >= 6 and n >= 5})


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(words: Counter) -> dict[str, tuple]:
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        near[w] = [v for m in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(m, []) if one_edit(w, v)]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def told(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("group", [64, 3, 0])
def test_spelling(spark, group, monkeypatch):
    """Few letters make many anagrams and hot signatures; every run is noisy."""
    monkeypatch.setattr(spelling, "GROUP", group)
    pick = random.Random(11)
    words = ["".join(pick.choice("abé") for _ in range(pick.choice((5, 6, 7, 7)))) for _ in range(150)] + ["Ünderway", "ünderway", "x×y÷zÀà", "thequick", "thequik"]
    rows = [(pick.choice((None, 1, 2, 3, 70)), " ".join(pick.choice(words) + pick.choice(("", ".", "1", "-B")) for _ in range(120)), "own", 1, "w", 1) for _ in range(60)]
    rows += [(9, None, None, None, None, None), (10, "", "x", 1, "w", 2), rows[0], (11, "Bigword " * 4000, "x", 1, "w", 2), (12, "bigwords " * 60, "x", 1, "w", 2), (13, "bigwordss " * 5 + "igwords " * 6, "", 0, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = spelled(counted([r[:2] for r in rows]))
    assert len(want) > 60 and any(v[0] and v[0] != v[1] for v in want.values())
    assert told(spelling.variants(spelling.word_counts(docs))) == want
    if group == 64:
        empty = spelling.variants(spelling.word_counts(docs.limit(0)))
        assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_long_text(monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK_CHARS", 7)
    text = "Abc déf, É×b " * 40 + "z" * 50
    assert spelling._runs(text) == Counter(x.translate(LOWER) for x in re.findall("[A-Za-zÀ-ÿ]+", text))


def test_every_near_pair_shares_a_signature(spark):
    pick = random.Random(2)
    pairs = []
    for _ in range(400):
        word = "".join(pick.choice("aabcdeéßz") for _ in range(pick.randrange(6, 14)))
        at, sign = pick.randrange(len(word)), pick.choice("abxyñ")
        pairs.append((word, pick.choice((word[:at] + word[at + 1 :], word[:at] + sign + word[at:], word[:at] + sign + word[at + 1 :]))))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.filter(~F.arrays_overlap(spelling.signatures(F.col("a")), spelling.signatures(F.col("b")))).count() == 0


def test_spelling_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert told(queries.op12(spark, sf)) == spelled(counted(rows))


def clustered(rows: list[tuple], k: int = 16, rounds: int = 3, width: int = 64):
    kept = [(i, v, [math.floor(x) * 64 if abs(x) >= 2**53 else math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [r[2] for r in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min(range(len(centers)), key=lambda c: (far(x, centers[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, _, x in kept:
            groups.setdefault(nearest(x), []).append(x)
        centers = [[sum(p) // len(groups[c]) for p in zip(*groups[c], strict=True)] if c in groups else centers[c] for c in range(len(centers))]
    out = [(i, nearest(x), far(x, centers[nearest(x)])) for i, _, x in kept]
    return centers, sorted(out, key=str)


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(centroids, "ROWS", 7)
    pick = random.Random(4)
    vector = lambda: [pick.choice((-0.5, 0.25, 0.3, 0.0, -0.01)) for _ in range(4)]
    rows = [(i, vector()) for i in range(60)]
    rows += [rows[3], (3, vector()), (None, vector()), (70, None), (71, []), (72, vector()[:3]), (73, [*vector(), 1.0]), (74, [None, 0.0, 0.0, 0.0])]
    rows += [(75, [math.nan, 0.0, 0.0, 0.0]), (76, [math.inf, 0.0, 0.0, 0.0])]
    for extra in ([], [(80, [1e9, 0.0, -3e9, 0.1]), (81, [1e300, -1e308, 0.0, 0.0])]):
        df = spark.createDataFrame([(i, v, "own", 5) for i, v in rows + extra], "vec_id bigint, embedding array<double>, assigned string, distance int").repartition(4)
        for k in (5, 1, 100):
            clusters = centroids.fit(df, width=4, k=k)
            centers, want = clustered(rows + extra, k, width=4)
            assert clusters.centroids == centers
            got = centroids.assign(df, clusters, width=4)
            assert set(got.columns) == set(df.columns) and got.count() == len(rows + extra)
            seen = [(r.vec_id, r.assigned.cluster, r.assigned.distance) for r in got.filter("assigned is not null").collect()]
            want = [(i, c, d if d < 2**63 else None) for i, c, d in want]
            assert sorted(seen, key=str) == sorted(want, key=str)
            assert sum(clusters.inertia) == sum(d for _, _, d in clustered(rows + extra, k, width=4)[1])
    none = centroids.fit(df.limit(0), width=4)
    assert none == centroids.Clusters([], []) and centroids.assign(df, none, width=4).filter("assigned is not null").count() == 0


def test_cluster_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    centers, want = clustered(rows)
    got = queries.op13(spark, sf).collect()
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=str) == want
    total = Counter()
    for _, c, d in want:
        total[c] += d
    for r in got:
        assert r.cluster_inertia == total[r.cluster] and r.inertia == sum(total.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()
