"""Queries that have no SQL."""

import hashlib

from combisieve.llm import pii, queries


def test_identifier_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2(spark, sf).collect():
        found = pii.base_spans(texts[r.doc_id] or "")
        listed = ",".join(f"{pii.KINDS[kind]}:{start}:{end}" for start, kind, end in found)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in found) for i in range(4)]
        assert set(listed.split(",")) <= set(r.spans.split(","))


def test_language_query(spark, sf):
    rows = queries.op4(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 for r in rows)
