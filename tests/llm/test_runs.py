"""Runs of words against a plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from forgeboard.llm import runs
from forgeboard.llm.frames import prepare

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, START long, period string"


def plain_runs(words):
    """Every maximal stretch of each period, the smallest period of a stretch kept."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, size, q) for (s, size), q in best.items())


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(found),
        *(top or (None,) * 3),
        1000 * top[1] // top[2] if top else None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in found)),
        sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def random_words(rng, n):
    out = []
    while len(out) < n:
        block = [rng.choice("abcé") for _ in range(rng.randint(1, 9))]
        out += block * rng.choice([1, 1, 2, 4, 5, 9])
        if rng.random() < 0.3:
            out.append(rng.choice("xyz") * rng.randint(1, 40))
    return out[:n]


def test_cover_gives_every_difference():
    assert {(a - b) % runs.PERIOD for a in runs.COVER for b in runs.COVER} == set(range(runs.PERIOD))


def test_common_prefixes():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 300):
        x = np.append(rng.integers(0, 2, n).repeat(rng.integers(1, 9, n)), 7)
        lce = runs.CommonPrefixes(x)
        a, b = rng.integers(0, len(x), (2, 400))
        a, b = a[a != b], b[a != b]
        for i, j, got in zip(a, b, lce.of(a, b)):
            want = 0
            while max(i, j) + want < len(x) and x[i + want] == x[j + want]:
                want += 1
            assert got == want


def test_runs_of_many_texts():
    rng = random.Random(9)
    lists = [random_words(rng, rng.choice([0, 1, 5, 6, 7, 30, 200, 700])) for _ in range(150)]
    lists += [["a"] * 500, ["a", "b"] * 300, lists[-1], lists[-1]]
    names = {w: k for k, w in enumerate(sorted({w for ws in lists for w in ws}))}
    flat = np.array([names[w] for ws in lists for w in ws], np.int64)
    text, start, size, period = runs.find_runs(flat, np.array([len(ws) for ws in lists]))
    for k, words in enumerate(lists):
        at = text == k
        assert list(zip(start[at].tolist(), size[at].tolist(), period[at].tolist())) == plain_runs(words)


def test_strongest_is_exact():
    big = 3 * 10**8
    size, period = np.array([4 * big + 5, 4 * big + 1, 8]), np.array([big + 1, big, 2])
    assert runs.strongest(np.array([5, 9, 0]), size, period) == 1
    assert runs.strongest(np.array([9, 5]), np.array([8, 4]), np.array([2, 1])) == 1


@pytest.fixture(scope="module")
def table(spark):
    prepare(spark)
    rng = random.Random(2)
    rows = [(i, " \t\n"[i % 3].join(random_words(rng, rng.choice([0, 3, 9, 80, 400]))), "en", 1, "p") for i in range(400)]
    rows += [rows[7], (None, "a a a a a a b", None, None, None), (900, None, "en", 1, "p"), (901, "", "en", 1, "p")]
    rows += [(1000, "one two three four " * 70_000 + "end", "en", 1, "p")]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


def test_rows(table):
    rows, docs = table
    want = sorted((plain_row(i, t) for i, t, *_ in rows if i != 1000), key=str)
    got = sorted((tuple(r)[:8] for r in runs.periodic_runs(docs, tails=True).collect() if r.doc_id != 1000), key=str)
    assert got == want


def test_text_longer_than_a_block(table):
    _, docs = table
    row = runs.periodic_runs(docs.filter("doc_id = 1000")).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 210_000, 3)
    assert row.collapsed_sha256 == hashlib.sha256("one two three four end".encode()).hexdigest()


def test_result_does_not_depend_on_blocks(table, monkeypatch):
    rows, _ = table
    ids, texts = [r[0] for r in rows[:60]], [r[1] or "" for r in rows[:60]]
    whole = runs._block(ids, texts, True)
    monkeypatch.setattr(runs, "CHUNK", 7)
    assert runs._block(ids, texts, True) == whole
    alone = [runs._block([i], [t], True) for i, t in zip(ids, texts)]
    assert whole == {name: [a[name][0] for a in alone] for name in whole}


def test_empty_table(table):
    assert runs.periodic_runs(table[1].limit(0)).count() == 0
