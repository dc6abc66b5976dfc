"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combisieve.llm import bytebpe, centroids, decontam, jaccard, langid, licenses, mixing, pii, quality, sharding, spelling, tokenbin, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_repetition_coverage")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = [F.col("signals")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality.judge(docs).select("doc_id", *base, "base_failed", "kept")


OP8_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s USING (doc_id) GROUP BY 1),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b USING (s)
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes o ON o.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(m.n, o.n) >= 85 * greatest(m.n, o.n)
  GROUP BY a.doc_id, b.doc_id, m.n, o.n HAVING 100 * count(*) >= 85 * (m.n + o.n - count(*))),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
SELECT r.doc_id, n AS n_shingles, min(other) AS component_id FROM reached r JOIN sizes USING (doc_id) GROUP BY r.doc_id, n
"""


@query("op8_ngram_jaccard_join", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard.similar_classes(docs, n=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP3_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM wanted),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN wanted USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::varchar)) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op3_suffix_decontamination", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("found")
    return decontam.locate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        (found["n_hit"] > 0).alias("contaminated"),
    )


@query("op2_deobfuscated_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("identifiers")
    base = F.filter(spans, lambda s: ~s["disguised"])
    listed = lambda x: F.array_join(
        F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    counts = [count(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return pii.find_identifiers(docs).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


@query("op6_rare_token_licenses")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    places = F.col("licenses.places")
    base = F.filter(places, lambda p: p["phrase"].isin(*licenses.BASE_PHRASES))
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    return licenses.find_licenses(docs).select(
        "doc_id",
        F.col("licenses.n_words").alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(places).alias("labels"),
        F.coalesce(F.array_max(F.transform(places, lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


@query("op4_compression_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = langid.fit(docs.filter("not held_out"))
    return langid.identify(docs.drop("lang"), model).select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected")
    )


@query("op5_bit_packed_tokens")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = tokenbin.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_word=True)
    return tokenbin.read_tokens(written)


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
leaders AS (SELECT payload_digest, min(page_id) AS leader FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN leader IS NULL OR leader = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN leader <> page_id THEN leader END AS refers_to
FROM p LEFT JOIN leaders USING (payload_digest)
"""


@query("op7_warc_index_merge", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_histories(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_multinomial_block_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.taken().select(F.col("key.doc").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op9_histogram_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op11_byte_bpe_round_trip")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bytebpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return bytebpe.decode(coded.drop("text"), ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP12_SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [195, unicode(s)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM runs, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
short AS (
  SELECT word, i, word[:i - 1] || word[i + 1:] AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word AS x, b.word AS y FROM short a JOIN short b USING (i, s) WHERE a.word <> b.word
  UNION SELECT word, s FROM short WHERE s IN (SELECT word FROM words)
  UNION SELECT s, word FROM short WHERE s IN (SELECT word FROM words)),
counted AS (
  SELECT x AS word, count(*) AS n_near, arg_min(y, (-w.n, y)) AS best, max(w.n) AS best_n FROM near JOIN words w ON w.word = y GROUP BY x),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
  FROM words LEFT JOIN counted USING (word)),
steps AS (
  SELECT word, word AS at FROM formed UNION SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN steps s USING (word) JOIN formed e ON e.word = s.at WHERE e.form IS NULL
"""


@query("op12_partenum_spelling", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def _d_rounds(rounds: int = 3) -> str:
    """Assignments ``a<r>`` to centroids ``c<r>`` and the centroids after them."""
    assign = lambda r: f"""
a{r} AS (SELECT rid, c, d FROM (
  SELECT rid, c, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM v, c{r})
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""  # noqa: E731
    move = lambda r: f"""
c{r + 1} AS (SELECT c, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN (
  SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (
    SELECT c, i, sum(y) AS s, count(*) AS n FROM a{r} JOIN p USING (rid) GROUP BY c, i) GROUP BY c) m USING (c))"""  # noqa: E731
    return ",".join(f(r) for r in range(rounds) for f in (assign, move)) + "," + assign(rounds)


OP13_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
p AS (SELECT rid, unnest(range(64)) AS i, unnest(x) AS y FROM v),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < 16),{_d_rounds()},
inertia AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a3 GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, cluster_inertia, (SELECT sum(d) FROM a3)::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 JOIN v USING (rid) JOIN c3 USING (c) JOIN inertia USING (c)
"""


@query("op13_bisector_clusters", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    clusters = centroids.fit(vectors)
    # one row per centroid
    ends = [(i, min(n, 2**63 - 1), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, (c, n) in enumerate(zip(*clusters, strict=True))]
    told = spark.createDataFrame(ends, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    found = centroids.assign(vectors, clusters).filter("assigned is not null").select("vec_id", "assigned.*")
    return found.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(n for _, n, _ in ends)).cast("bigint").alias("inertia"), "centroid_sha256"
    )
