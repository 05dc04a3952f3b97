"""Columns of registered queries that SQL does not cover, against plain Python on a given table."""

import hashlib
import zlib

import pytest

from millrace.llm.queries import QUERIES, VOCABULARY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_fingerprints(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op5_scaled_fingerprints"](spark, SF).collect()}
    order = sorted(texts, reverse=True)
    prints = {}
    for at, i in enumerate(order):
        text, following = texts[i], texts[order[(at + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - min(half, len(text))] + following[:half] if half else text
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near in (r.near_edited, r.near_next):
            assert near is not None and 0 <= near <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(rows) == len(texts)


def test_shards(spark, texts):
    rows = QUERIES["op7_uniform_shards"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    counts = [0] * 16
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        counts[r.shard] += 1
    assert max(counts) - min(counts) <= 1
    for shard in range(16):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))


def test_packing(spark, texts):
    """Every id of every document in one piece, windows without gaps, padding only up to a power of two."""
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY[0])
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    pieces, windows = {}, {}
    for r in QUERIES["op6_retrieval_packing"](spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found, wanted in ((pieces, {i: len(x) for i, x in ids.items()}), (windows, None)):
        for key, parts in found.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            assert at == wanted[key] if wanted else at <= 2048
    assert set(pieces) == set(texts)
    lengths = [sum(n for _, n in parts) for parts in windows.values()]
    padded = sum(2048 - n for n in lengths if n & (n - 1))
    assert padded <= 0.01 * sum(lengths)


def test_held_out_parts(spark, texts):
    """Which documents the models of classifier and language model may not learn from."""
    part = lambda i, n: zlib.crc32(str(i).encode()) % n
    quality = QUERIES["op4_quality_classifier"](spark, SF).collect()
    assert {r.doc_id: r.held_out for r in quality} == {i: part(i, 4) == 2 for i in texts}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in quality)
    scored = QUERIES["op10_ppm_scores"](spark, SF).collect()
    assert {r.doc_id: r.held_out for r in scored} == {i: part(i, 5) == 1 for i in texts}
    words = {i: [*t.translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")] for i, t in texts.items()}
    words = {i: [w for w in ws if w] for i, ws in words.items()}
    train = [i for i in texts if part(i, 5) != 1]
    vocabulary = {w for i in train for w in words[i]} | {None}
    total = sum(len(words[i]) + 1 for i in train)
    for r in scored:
        known = sum(w in vocabulary for w in words[r.doc_id]) + 1
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words[r.doc_id]) + 1, known, total)
