"""Words are never taken for others: alternating words and forced clashes of hashes."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from forgeboard.llm import bpe, encoder, jaccard, packing, tokens
from forgeboard.llm.frames import prepare
from forgeboard.llm.text import flat, runs, word_hashes

NAME = "byte_bpe_50k.json"


def thue_morse(size, a, b):
    """The word whose letter k is ``b`` where k has an odd number of bits, and its twin."""
    odd = [k.bit_count() & 1 for k in range(size)]
    return "".join(b if o else a for o in odd), "".join(a if o else b for o in odd)


PAIRS = [
    pair[::turn]
    for size in (32, 64, 1024, 4096)
    for letters in (("a", "b"), ("e", "r"), ("t", "h"), ("é", "ü"), ("日", "本"))
    for pair in [thue_morse(size, *letters)]
    for turn in (1, -1)
]


def plain(text):
    return encoder.library(NAME).encode(text, add_special_tokens=False).ids


def test_twins_have_hashes_of_their_own():
    every = sorted({w for pair in PAIRS for w in pair})
    points, at, _ = flat(pa.array(every))
    assert len(set(word_hashes(points, at[:-1], at[1:]).tolist())) == len(every)


def test_words_of_all_sizes_have_hashes_of_their_own():
    words = ["", *(c * n for c in ("a", "b", "\x00", "\U0010ffff") for n in range(1, 80))]
    points, at, _ = flat(pa.array(words))
    for seed in (0, 1):
        assert len(set(word_hashes(points, at[:-1], at[1:], seed).tolist())) == len(words)


@pytest.mark.parametrize("make", [encoder.encoder, bpe.numpy_encoder])
def test_twins_encode_as_the_library_does(make):
    for pair in PAIRS:
        for text in pair:
            assert make(NAME).encode(pa.array([text]))[0].tolist() == plain(text)
        ids, counts = make(NAME).encode(pa.array([" ".join(pair)]))
        assert ids.tolist() == plain(" ".join(pair))


@pytest.mark.parametrize("few", [1, 3, 1000])
def test_words_of_one_hash_encode_as_the_library_does(monkeypatch, few):
    real = encoder.word_hashes
    monkeypatch.setattr(
        encoder, "word_hashes", lambda p, s, e, seed=0: real(p, s, e, seed) % np.uint64(few) if seed == 0 else real(p, s, e, seed)
    )
    made = encoder.encoder.__wrapped__(NAME)
    for _ in range(2):
        for text in ["these words share their hashes", "other words do so too", "these words share their hashes", "ab ba ab ba aab"]:
            assert made.encode(pa.array([text, text[:9]]))[0].tolist() == plain(text) + plain(text[:9])


@pytest.fixture(scope="module")
def twins(spark):
    prepare(spark)
    texts = [text for pair in PAIRS for text in pair]
    rows = [(i, t) for i, t in enumerate(texts)]
    return texts, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_queries_tell_twins_apart(twins):
    texts, docs = twins
    ids = {i: [*plain(t)] for i, t in enumerate(texts)}
    assert all(r.n_tokens == len(ids[r.doc_id]) for r in tokens.token_counts(docs).collect())
    for r in bpe.encode_decode(docs).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(ids[r.doc_id], "<u4").tobytes()).hexdigest()
    got = {}
    for r in packing.pack(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, pieces in got.items():
        whole = np.array([*ids[i], 0], "<u4")
        assert all(zlib.crc32(whole[a : a + n].tobytes()) == crc for a, n, crc in pieces)


def test_sets_of_twins_differ(twins):
    texts, docs = twins
    groups = {}
    for r in jaccard.join_components(docs).collect():
        groups.setdefault(r.component_id, set()).add(texts[r.doc_id])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(texts))


def test_runs_helper_keeps_texts_apart():
    starts, ends = runs(np.array([True, True, False, True, True]), np.array([0, 1, 4]))
    assert list(zip(starts, ends)) == [(0, 1), (1, 2), (3, 4), (4, 5)]
