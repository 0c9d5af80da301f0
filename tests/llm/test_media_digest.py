"""The digests of stored media against plain Python."""

import hashlib
import zlib

from textlist.llm import media


def test_payloads_are_those_of_the_texts(spark):
    texts = ["", None, "a", "é" * 32, "x" * 64, "word " * 1000, "日本\n" * 77]
    docs = spark.createDataFrame([(i, t, 9, "m") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, feature string")
    got = {r["doc_id"]: r for r in media.media_digest(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"]
    assert tuple(got[0])[1:] == tuple(got[1])[1:]  # equal texts, equal values
