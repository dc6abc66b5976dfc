"""The stages of the corpus pipeline against brute force, each on its own input."""

import re
from collections import Counter

import corpus_pipeline
from combisieve.llm import mixing, quality
from combisieve.session import cut_lineage

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def covered(at, n):
    return {i + k for i in at for k in range(n)}


def good(text):
    words = SPACED.findall(text or "")
    chars, total = [len(w) for w in words], sum(map(len, words))
    found = grams(words, 5)
    twice = Counter(found)
    if len(words) < 10 or 100 * len(covered([i for i, g in enumerate(found) if twice[g] > 1], 5)) > 20 * len(words):
        return False
    seen, lines = set(), 0
    for line in text.split("\n"):
        lines += sum(map(len, SPACED.findall(line))) if line in seen else 0
        seen.add(line)
    if lines > quality.MAX_LINE_SHARE * total:
        return False
    for n, share in quality.MAX_NGRAM_SHARE.items():
        seen, later = set(), []
        for i, g in enumerate(grams(words, n)):
            if g in seen:
                later.append(i)
            seen.add(g)
        if sum(chars[i] for i in covered(later, n)) > share * total:
            return False
    return True


def one_of_each(texts):
    """Ids that stay: the lowest of each group of links."""
    sets = {}
    for doc_id, text in texts.items():
        words = SPACED.findall((text or "").translate(LOWER))
        sets[doc_id] = set(grams(words, 5)) or ({tuple(words)} if words else set())
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(texts):
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i for i in texts if find(i) == i}


def clean(text, windows):
    words = ALNUM.findall((text or "").translate(LOWER))
    return not any(g in wanted for n, wanted in windows.items() for g in grams(words, n))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out, tables = [docs], [{r.doc_id: r.text for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], sf)))
    assert [df.columns for df in out[1:5]] == [columns] * 4
    tables += [{r.doc_id: r.text for r in df.collect()} for df in out[1:4]]
    assert set(tables[1]) == {i for i, t in tables[0].items() if good(t)} and len(tables[1]) == out[1].count()
    assert set(tables[2]) == one_of_each(tables[1]) and len(tables[2]) == out[2].count()
    windows = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = ALNUM.findall((r.text or "").translate(LOWER))
        if words:
            n = min(10, len(words))
            windows.setdefault(n, set()).update(grams(words, n))
    assert set(tables[3]) == {i for i, t in tables[2].items() if clean(t, windows)} and len(tables[3]) == out[3].count()
    assert all(tables[0][i] == t for i, t in tables[3].items())

    sizes, taken = Counter(), Counter()
    for r in out[3].collect():
        sizes[r.source] += len(SPACED.findall(r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        full |= over
    mixed = out[4].collect()
    passes = Counter(r.doc_id for r in mixed)
    assert max(passes.values()) <= 3 and set(passes) <= set(tables[3])
    for r in mixed:
        words = SPACED.findall(r.text)
        # a pass takes each word of a document at most once
        assert r.n_chars == len(r.text) and Counter(words) <= Counter(SPACED.findall(tables[3][r.doc_id]))
        taken[r.source] += len(words)
    assert all(taken[s] == round(3 * sizes[s] if s in full else weight[s] * level) for s in names)

    last = out[5].collect()
    assert sorted((r.doc_id, r.text) for r in last) == sorted((r.doc_id, r.text) for r in mixed)
    assert all(r["size"] == len(r.text.encode()) + 1 for r in last)
    for shard in range(8):
        slots = sorted(r.slot for r in last if r.shard == shard)
        assert slots == list(range(len(slots)))
    loads = Counter()
    for r in last:
        loads[r.shard] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 2 * max(r["size"] for r in last) and set(loads) <= set(range(8))
