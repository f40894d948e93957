"""Collocations against a plain count of all phrases."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from forgeboard.llm import phrases
from forgeboard.llm.frames import prepare
from forgeboard.llm.trie import DoubleArray, digits_for

DOCS = "doc_id long, lang string, text string, words string, STATE long, n long"


def plain(rows, least, longest=4, share=80, top=2000):
    held, n = collections.Counter(), collections.Counter()
    for _, lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    held[lang, tuple(words[i : i + size])] += 1
    found = {}
    for (lang, words), a in held.items():
        if len(words) > 1 and a >= least:
            cuts = [(held[lang, words[:k]], held[lang, words[k:]]) for k in range(1, len(words))]
            score, k = min((2_000_000 * a // (left + right), k) for k, (left, right) in enumerate(cuts))
            found[lang, words] = (a, *cuts[k], score)
    dropped = set()
    for lang, words in found:
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                if 100 * held[lang, words] >= share * held[lang, words[i : i + size]]:
                    dropped.add((lang, words[i : i + size]))
    out = []
    for lang in n:
        own = [(-s, -a, " ".join(w).encode(), left, right) for (g, w), (a, left, right, s) in found.items() if g == lang and (g, w) not in dropped]
        for rank, (s, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made_up(seed, size):
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        words = []
        while len(words) < rng.choice([0, 1, 4, 30, 90]):
            words += rng.choice([["New", "york", "City"], ["new", "york"], ["a", "b", "a", "b", "a"], ["x"], ["y,"], ["z\n"], ["Ünder", "the", "tree"], ["the"], [f"w{rng.randint(0, 99)}"]])
        text = "".join(w + rng.choice([" ", " ", "\t", "  ", ". "]) for w in words)
        rows.append((i, rng.choice(["en", "en", "de", None, "und", ""]), text, "w", 1, 2))
    return [*rows, *rows[:30], (None, "en", None, None, None, None), (None, None, "", None, None, None)]


@pytest.fixture(scope="module")
def table(spark):
    prepare(spark)
    rows = made_up(1, 500)
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_collocations(table):
    rows, docs = table
    want = plain(rows, 30)
    assert {r[0] for r in want} >= {"en", "und", "de"} and any(len(r[2].split()) == 4 for r in plain(rows, 5))
    assert result(phrases.collocations(docs)) == want


def test_many_small_tries_give_the_same(table, monkeypatch):
    rows, docs = table
    for name, value in (("WORDS_TOGETHER", 40), ("TRIE_PHRASES", 60)):
        monkeypatch.setattr(phrases, name, value)
    assert result(phrases.collocations(docs, least=4, top=50)) == plain(rows, 4, top=50)


def workers(plan):
    """Python workers that a task of this plan holds at once."""
    below = plan.children()
    return ("MapInArrow" in plan.nodeName()) + max((workers(below.apply(i)) for i in range(below.size())), default=0)


def test_more_tries_and_words_need_no_more_workers(table, monkeypatch):
    rows, docs = table
    for name, value in (("WORDS_TOGETHER", 40), ("TRIE_PHRASES", 8), ("HELD_TOGETHER", 300)):
        monkeypatch.setattr(phrases, name, value)
    real, held = phrases.stage_in, {}
    shards, tries = phrases._numbered, phrases._tries
    monkeypatch.setattr(phrases, "_numbered", lambda *a: held.update(shards=len(a[1])) or shards(*a))
    monkeypatch.setattr(phrases, "_tries", lambda *a: held.update(tries=len((found := tries(*a))[0])) or found)

    def stage_in(folder):
        def stage(name, df, *by):
            held[name] = workers(df._jdf.queryExecution().optimizedPlan())
            return real(folder)(name, df, *by)

        return stage

    monkeypatch.setattr(phrases, "stage_in", stage_in)
    assert result(phrases.collocations(docs, least=4, top=50)) == plain(rows, 4, top=50)
    assert held["shards"] > 1 and held["tries"] > 1
    assert held["texts-0"] == held["level-2"] == held["level-3"] == 1


def test_a_task_lets_go_of_what_it_read_once(spark):
    prepare(spark)
    shared = spark.sparkContext.broadcast(np.arange(9))

    def read(batches):
        for batch in batches:
            total = int(phrases._once(shared).sum() + phrases._once(shared).sum())
            yield pa.record_batch([pa.array([total]), pa.array([hasattr(shared, "_value")])], names=["total", "kept"])

    assert [tuple(r) for r in spark.range(1).mapInArrow(read, "total long, kept boolean").collect()] == [(72, False)]


def test_tries_share_out_first_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TRIE_PHRASES", 60)
    rng = np.random.default_rng(4)
    words = np.unique(np.concatenate([rng.integers(0, 90, (300, 2)), [(7, i) for i in range(200)]]), axis=0)
    rows = spark.createDataFrame([(w,) for w in words.tolist()], "words array<int>")
    ranges = phrases._ranges(rows, 90)
    assert sorted(part for low, high, part, parts in ranges if low <= 7 <= high) == list(range(4))
    for low, high, part, parts in ranges:
        here = int(((words[:, 0] >= low) & (words[:, 0] <= high)).sum())
        assert -(-here // parts) <= 60
    assert all(any(low <= w <= high for low, high, *_ in ranges) for w in words[:, 0])


def test_counts_in_several_steps(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(phrases, "COUNTS_TOGETHER", 4096)
    monkeypatch.setattr(phrases, "HELD_TOGETHER", 1000)
    state = np.random.default_rng(5).integers(-1, 9000, 3000).astype(np.int32)
    level = spark.createDataFrame([(len(state), phrases.pack(state))] * 2, "n long, state binary").repartition(2)
    got = {r.number: r.a for r in phrases._counts(level, 9000).collect()}
    assert got == {int(k): 2 * n for k, n in collections.Counter(state.tolist()).items() if k >= 0}


def test_full_buckets_lose_nothing(table, monkeypatch):
    rows, docs = table
    real = phrases._heavy_buckets
    monkeypatch.setattr(phrases, "_heavy_buckets", lambda level, width, bits, least: real(level, width, bits, 1))
    assert result(phrases.collocations(docs, least=25, longest=3)) == plain(rows, 25, longest=3)


def test_words_of_one_key_are_all_handed_out(monkeypatch):
    real = phrases.word_hashes
    monkeypatch.setattr(phrases, "word_hashes", lambda p, s, e, seed: real(p, s, e, seed) % np.uint64(1))
    texts = pa.array(["One two three. two", "three four"], pa.large_string())
    words = phrases.Words(texts, ["en", "en"], 0)
    wanted = np.unique(words.keys.view(np.int64))
    found = set(phrases.Names(wanted, 0).fresh(words, ["en", "en"]))
    assert len(wanted) == 1 and {w for _, _, w in found} == {"one", "two", "three", "four"}
    monkeypatch.undo()
    words = phrases.Words(texts, ["en", "de"], 0)
    names = phrases.Names(np.unique(words.keys.view(np.int64)), 0)
    rows = list(names.fresh(words, ["en", "de"]))
    assert not list(names.fresh(words, ["en", "de"]))
    assert sorted((g, w) for _, g, w in rows) == [("de", "four"), ("de", "three"), ("en", "one"), ("en", "three"), ("en", "two")]


def test_pieces_of_long_texts_give_the_same_words(monkeypatch):
    texts = [t for _, _, t, *_ in made_up(3, 40)] + ["x" * 900 + " y", ". ,a b c" * 100, "q" * 500]
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    cut = lambda: np.concatenate(list(phrases.streams(batch, 0)))
    whole = cut()
    for size in (1, 50, 300):
        monkeypatch.setattr(phrases, "BLOCK_BYTES", size)
        # Marks may repeat where a piece ends, words and the breaks between them may not differ.
        text = "".join(chr(33 + i) if k else "|" for k, i in zip(cut(), np.unique(cut(), return_inverse=True)[1]))
        want = "".join(chr(33 + i) if k else "|" for k, i in zip(whole, np.unique(whole, return_inverse=True)[1]))
        assert re.sub(r"\|+", "|", text).strip("|") == re.sub(r"\|+", "|", want).strip("|")


def test_nothing_to_find(table):
    _, docs = table
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs, least=10**6).count() == 0


def test_text_longer_than_a_block(spark):
    prepare(spark)
    words = ["deep", "blue", "sea,", "old", "man"] * 60_000
    rows = [(1, "en", " ".join(words), None, None, None), (2, "en", "x" * 2_000_000 + " deep blue sea", None, None, None)]
    assert result(phrases.collocations(spark.createDataFrame(rows, DOCS))) == plain(rows, 30)


@pytest.mark.parametrize("size, width, words", [(0, 2, 5), (1, 2, 1), (300, 2, 20), (5000, 3, 70_000), (3000, 4, 300)])
def test_trie(size, width, words):
    rng = np.random.default_rng(size)
    rows = np.unique(rng.integers(0, words, (size, width)), axis=0) if size else np.zeros((0, width), np.int64)
    trie = DoubleArray(rows, digits_for(words))
    numbers = {tuple(r): i for i, r in enumerate(rows.tolist())}
    text = np.concatenate([rows.ravel()[:3000], rng.integers(-1, words, 2000)]) if size else rng.integers(-1, words, 50)
    got = trie.walk(text, np.arange(len(text)))
    want = [numbers.get(tuple(text[i : i + width].tolist()), -1) for i in range(len(text))]
    assert got.tolist() == want


def test_only_pairs_with_the_support_are_heavy(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    words = rng.integers(0, 200, 20_000).astype(np.int32)
    words[rng.integers(0, len(words), 2_000)] = -1
    held = collections.Counter((int(a), int(b)) for a, b in zip(words, words[1:]) if a >= 0 and b >= 0)
    rows = [(len(words), phrases.pack(words), phrases.pack(words))] * 2
    level = spark.createDataFrame(rows, "n long, words binary, state binary").repartition(2)
    for bits in (16, 62):
        heavy = phrases._heavy_buckets(level, 2, bits, 4).collect()
        want = {a << bits // 2 | b for (a, b), n in held.items() if 2 * n >= 4}
        assert sorted(r.bucket for r in heavy) == sorted(want) and len(want) < len(held)


@pytest.mark.parametrize("bits", [12, 13, 38, 62])
def test_spread_numbers_come_back(bits):
    numbers = np.random.default_rng(1).integers(0, 1 << bits, 5_000, dtype=np.uint64)
    spread = phrases._spread(numbers, bits)
    assert (spread < 1 << bits).all() and (phrases._spread(spread, bits, phrases.UNSPREAD) == numbers).all()
