"""The registered queries over whole tables, each column worked out again in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import public_tokenizers
import pytest

from stallkeeper.llm import queries, simhash

from ..conftest import DATA


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}


def crc_of(numbers, width=4):
    return zlib.crc32(b"".join(x.to_bytes(width, "little") for x in numbers))


def test_mixing(spark, ids):
    rows = queries.op1_mixing(spark, DATA).collect()
    assert {r.doc_id: r.n_tokens + 1 for r in rows} == {k: len(v) for k, v in ids.items()} and len(rows) == len(ids)
    assert all(r.rate >= 0 and abs(sum(r.posteriors) - 1) < 1e-6 and r.domain in queries.WEIGHTS for r in rows)


def test_packing(spark, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op2_packing(spark, DATA).collect():
        assert r.ids_crc32 == crc_of(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for parts, n in [(p, len(ids[k])) for k, p in pieces.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n if n else at <= 2048
    total = sum(map(len, ids.values()))
    assert 2048 * len(sequences) < 1.05 * total + 2048 * 8


def test_token_counts(spark, texts):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {(k, len(t.encode()), n, n > 4096) for k, t in texts.items() for n in [len(library.encode(t))]}
    rows = queries.op3_token_counts(spark, DATA).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(texts)


def test_fingerprints(spark, texts):
    order = sorted(texts)
    after = dict(zip(order, order[1:] + order[:1]))
    rows = {r.doc_id: r for r in queries.op4_fingerprints(spark, DATA).collect()}
    assert set(rows) == set(texts)
    prints = {}
    for k, r in rows.items():
        n, following = len(texts[k]), texts[after[k]]
        new = following[: n // 2]
        edited = texts[k][: n - n // 2] + new
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(texts[k], r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_next == 1 or r.fingerprint != rows[after[k]].fingerprint


def test_id_matrices(spark, ids):
    spans = defaultdict(list)
    for r in queries.op5_id_matrices(spark, DATA).collect():
        row = []
        for k, start, length in zip(r.doc_ids, r.doc_starts, [b - a for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:])]):
            row += ids[k][start : start + length]
            spans[k].append((start, length))
        assert len(row) == r.n_tokens == r.cu_seqlens[-1] and r.position_resets == r.cu_seqlens[:-1]
        assert r.ids_crc32 == crc_of(row + [0] * (2048 - len(row)), 2)
    for k, parts in spans.items():
        assert [s for s, _ in sorted(parts)] == list(range(0, len(ids[k]), 2048)) and sum(n for _, n in parts) == len(ids[k])
    assert set(spans) == set(ids)


def test_media(spark, texts):
    rows = queries.op6_media(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    told = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(payload) + 44
        assert told.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_simhash(spark, texts):
    rows = queries.op8_simhash(spark, DATA).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert prints == {k: simhash.simhash64(simhash.shingle_hashes(t, 3)) for k, t in texts.items()} and len(rows) == len(texts)
    root = {}
    for k in sorted(prints):  # breadth-first from the smallest document not yet reached
        if k in root:
            continue
        front = [k]
        root[k] = k
        while front:
            x = prints[front.pop()]
            near = [d for d, y in prints.items() if d not in root and (x ^ y).bit_count() <= 3]
            root |= dict.fromkeys(near, k)
            front += near
    assert {r.doc_id: r.component_id for r in rows} == root


def test_shards(spark, texts):
    rows = queries.op10_sharding(spark, DATA).collect()
    assert sorted((r.doc_id, r.text_sha256) for r in rows) == sorted((k, hashlib.sha256(t.encode()).hexdigest()) for k, t in texts.items())
