"""Operators for training data on small tables, against plain versions of what they state."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from forgeboard.llm import arrowfiles, bpe, divergence, encoder, jaccard, packing, quality, sharding, tokens, topk, toxicity
from forgeboard.llm.frames import prepare
from forgeboard.session import shared_dir

NAME = "byte_bpe_50k.json"
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Columns with names the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, SCORE double, shard int"
LONG = "some words that go on and on " * 400


def documents(spark, *texts):
    """Texts under ids 0, 1, ...; then a repeated row and one of nothing but nulls."""
    prepare(spark)
    rows = [(i, t, "en", f"s{i % 3}", None, 1, 0.5, 7) for i, t in enumerate(texts)]
    rows += rows[:1] + [(None,) * 8]
    return spark.createDataFrame(rows, DOCS)


TEXTS = [
    "It's the first text, isn't it?\n\n  Two  spaces\tand tabs. <|endoftext|> 12345 日本語 émile",
    "",
    None,
    " ",
    LONG,
    "same same same same",
    "same same same same",
    "a",
]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, *TEXTS)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return docs.limit(0)


def plain_ids(text):
    return encoder.library(NAME).encode(text or "", add_special_tokens=False).ids


def test_words_encode_as_the_library_does():
    random.seed(5)
    letters = [*"ab'strevmld 1.\n\t  éZ日", "<|endoftext|>", "'ll", "'re", "\r\n", "  ", "the", "ation", " ", "aaaa"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 2000, LONG * 200]
    want = [plain_ids(t) for t in texts]
    for words in (encoder.encoder(NAME), bpe.numpy_encoder(NAME)):
        ids, counts = words.encode(pa.array(texts))
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_token_counts(docs, empty):
    got = tokens.token_counts(docs).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(plain_ids(r.text))) for r in docs.collect()]
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.token_counts(empty).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_of_other_kinds(docs, name):
    assert tokens.token_counts(docs, name).count() == len(TEXTS) + 2


def test_encode_decode(docs, empty):
    by_id = {r.doc_id: r for r in bpe.encode_decode(docs).collect()}
    for i, text in enumerate(TEXTS):
        ids = np.array(plain_ids(text), "<u4")
        assert by_id[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert by_id[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(empty).count() == 0


def test_packing(docs, empty):
    packed = packing.pack(docs, capacity=256, keep_ids=True)
    rows = packed.collect()
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 256
    pieces = sorted((r.piece, r.ids) for r in rows if r.doc_id == 4)
    assert [i for _, ids in pieces for i in ids] == [*plain_ids(LONG), 0]
    assert len(fill) == -(-sum(r.length for r in rows) // 256)
    assert packing.sequences(packed).count() == len(fill)
    assert packing.pack(empty).count() == 0


def test_fullest_combination():
    random.seed(1)
    for _ in range(200):
        lengths = sorted({random.randint(1, 30): random.randint(1, 3) for _ in range(6)}.items(), reverse=True)
        room = random.randint(0, 60)
        reach = {0}
        for size, count in lengths:
            for _ in range(count):
                reach |= {r + size for r in reach if r + size <= room}
        chosen = packing.fullest(lengths, room)
        assert sum(s * n for s, n in chosen) == max(reach)
        assert all(n <= dict(lengths)[s] for s, n in chosen)


def test_arrow_files(spark, docs, empty):
    folder = shared_dir(spark, "files")
    manifest = arrowfiles.write(docs, folder, sequence=64)
    rows = arrowfiles.read_documents(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 0, 0, 1, 2, 3, 4, 5, 6, 7]
    at = 0
    for r in rows:
        ids = plain_ids(TEXTS[r.doc_id] if r.doc_id is not None else "") + [2]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    reader = arrowfiles.Reader(manifest.first().file + ".arrow")
    ids, mask = reader.row(0)
    assert len(ids) == 64 and mask.all()
    assert arrowfiles.read_documents(spark, arrowfiles.write(empty, folder)).count() == 0


def test_sharding(spark, docs, empty):
    assert sorted(r.size for r in sharding.shard(docs, 3).select("size").collect()) == sorted(
        16 + len((r.text or "").encode()) for r in docs.collect()
    )
    random.seed(3)
    many = documents(spark, *["x" * random.randint(1, 400) for _ in range(1500)], *["copy"] * 700)
    rows = sharding.shard(many, 8).collect()
    sums, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == 2202 and len(sums) == 8
    assert max(sums.values()) < 1.05 * min(sums.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(empty).count() == 0


def test_top_k(spark):
    prepare(spark)
    random.seed(2)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 8), (2003, [None] * 8), (None, rows[1][1]), (2050, [1.0])]
    rows += [rows[5], (2100, [1e30] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").dropDuplicates().collect()
    ok = {
        r.vec_id: [int(np.floor(256 * float(x))) for x in r.embedding]
        for r in table
        if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)
    }
    clip = lambda s: max(1 - (1 << 63), min((1 << 63) - 1, s))
    want = []
    for q in ok:
        if q % 50 == 0:
            found = [
                (-clip(sum(a * b for a, b in zip(ok[q], ok[c]))), c) for c in ok if c != q and len(ok[c]) == len(ok[q])
            ]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(sorted(found)[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_divergence_counts(docs, empty):
    by_id = {r.doc_id: r for r in divergence.judge(docs).collect()}
    for i, text in enumerate(TEXTS):
        text = text or ""
        words = WORD.findall(text)
        windows = list(zip(words, words[1:], words[2:]))
        held = collections.Counter(windows)
        covered = {k + d for k, w in enumerate(windows) if held[w] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.kept and r.base_failed)
    assert divergence.judge(empty).count() == 0


def test_divergence_classes(spark):
    prepare(spark)
    text = "Ab\u00c9\u00e9 \U0001d400\U0001d41a 12\u0663,\t<x>\x0b(y)[z]{-}_/\\\\'\"!?\n\u00a0#*$%&| \u01c5"
    kinds = {
        "n_symbols": lambda c: c in divergence.SYMBOLS, "n_breaks": lambda c: c in divergence.BREAK_CHARS,
        "n_capitals": lambda c: unicodedata.category(c) == "Lu", "n_digits": lambda c: c in "0123456789",
        "n_marks": lambda c: c in ".,;:!?'\"()[]{}-_/\\",
    }
    docs = spark.createDataFrame([(1, text, "en"), (2, None, "en"), (3, "abc", "en")], "doc_id long, text string, lang string")
    for row in divergence._measured(divergence._rows(docs)).collect():
        want = {name: sum(map(kind, row.text)) for name, kind in kinds.items()}
        assert {name: row[name] for name in kinds} == want and row.n_rest == len(row.text) - sum(want.values())
        assert row.word_chars == len(row.text) - want["n_breaks"]


def test_rare_languages_have_references_of_their_own(spark):
    prepare(spark)
    rng = random.Random(6)

    def text(common, letters, salad=False):
        own = ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(200)]
        return " ".join(own if salad else [w if i % 2 else rng.choice(common) for i, w in enumerate(own)])

    small, capital = "abcdefghij", "ABCDEFGHIJ"
    rows = [(i, text(["the", "of", "and", "to"], small), "en") for i in range(1200)]
    rows += [(2000 + i, text(["na", "ni", "wa", "ku"], small), "sw") for i in range(8)] + [(2100, text([], small, True), "sw")]
    rows += [(3000 + i, text(["DER", "DIE", "DAS"], capital), "de") for i in range(8)]
    got = {r.doc_id: r for r in divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert not got[2100].kept and got[2100].word_distance > divergence.MOST_WORD_DISTANCE
    assert all(r.kept for i, r in got.items() if i != 2100)


def test_jaccard(spark, docs, empty):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[random.choice(vocabulary) for _ in range(random.choice([3, 5, 12, 40, 90]))] for _ in range(25)]
    texts = []
    for base in bases:
        for _ in range(6):
            own = list(base)
            for _ in range(random.randint(0, max(1, len(own) // 15))):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            texts.append(" ".join(own).title())
    texts += ["", None, texts[0], *[" ".join(vocabulary[:30]) + f" tail{i} end" for i in range(50)]]
    got = {r.doc_id: r for r in jaccard.join_components(documents(spark, *texts)).collect()}
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    low = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = low[a], low[b]
                low = [min(x, y) if v in (x, y) else v for v in low]
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [
        (len(s), c) for s, c in zip(sets, low)
    ]
    assert got[None].component_id is None
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 6").isEmpty()
    assert jaccard.join_components(empty).count() == 0


def test_rows_of_one_id_speak_for_their_own_sets(spark):
    prepare(spark)
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(40):
        # Id i has two texts; a near copy of each must be linked with its own.
        one, two = ([f"{c}{i}x{rng.randrange(10**6)}" for _ in range(60)] for c in "ab")
        rows += [(i, " ".join(one)), (i, " ".join(two)), (200 + i, " ".join([*one, "more"])), (300 + i, " ".join([*two, "more"]))]
        want |= {200 + i: i, 300 + i: i}
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id >= 200} == want
    assert all(r.component_id == r.doc_id for r in got if r.doc_id < 200)


def test_one_row_of_each_group_stays(spark):
    prepare(spark)
    text = {c: " ".join(f"{c}{k}" for k in range(50)) for c in "abcd"}
    near = {c: t + " more" for c, t in text.items()}
    rows = [(1, text["a"], "x")] * 30 + [(1, text["a"], "y"), (None, near["a"], "x"), (2, near["a"], None), (2, near["b"], "x")]
    rows += [(3, text["b"], "x"), (None, text["c"], "x"), (None, text["c"], "x"), (None, near["c"], "x"), (4, text["d"], "x")]
    rows += [(5, "", "x"), (5, "", "x"), (6, None, None), (None, "", "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, (r.text or "").removesuffix(" more")) for r in kept.collect()]
    want = [(1, text["a"]), (2, text["b"]), (None, text["c"]), (4, text["d"]), (5, ""), (6, ""), (None, ""), (None, "")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_bands_stay_as_they_are_however_often_they_are_asked():
    bands = jaccard.Bands(80)
    band = bands.of(np.array([1, 7, 40, 5000]))
    first = bands.last(band).tolist()
    for _ in range(1000):
        assert bands.last(band).dtype == np.int64
    assert bands.last(band).tolist() == first
    assert (bands.of(bands.last(band)) == band).all() and (bands.of(bands.last(band) + 1) == band + 1).all()


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(7)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, size=int(rng.integers(1, 400)), dtype=np.uint64)
        a, b = (np.unique(pool[rng.random(len(pool)) < share]) for share in rng.random(2))
        if len(a) and len(b):
            assert jaccard.apart_at_least(jaccard.parities(a), jaccard.parities(b)) <= len(np.setxor1d(a, b))
            assert jaccard.apart_at_least(jaccard.parities(a), jaccard.parities(a)) == 0


@pytest.fixture(scope="module")
def judged(spark):
    random.seed(4)
    words = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(600):
        own = random.choices(words, k=random.randint(40, 120))
        toxic, bad = i % 4 == 0, i % 5 == 0
        for _ in range(3 * toxic):
            own[random.randrange(len(own))] = random.choice(["zorgul", "zorgulim", "krazzet"])
        text = " ".join(w.upper() + "!!" if bad else w for w in own)
        rows.append((i, text, "en", f"s{i % 3}", None, 1, 0.5, 7))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(600, None, None, None, None, 1, 0.5, 7), (None, "", "en", "s1", None, 1, 0.5, 7)]
    prepare(spark)
    known = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(rows, DOCS), known


def test_toxicity_on_held_out_rows(judged, empty):
    docs, labels = judged
    field = toxicity.learn(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, field).collect()}
    for i in range(600):
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [i for i in range(600) if rows[i].held_out]
    right = sum(rows[i].predicted == int(i % 4 == 0) for i in held)
    assert right / len(held) > 0.97
    assert rows[600].score == 0 and rows[None].score == 0 and not rows[None].held_out
    hit = rows[0]
    text = docs.filter("doc_id = 0").first().text.lower()
    assert {text[s.start : s.end][:5] for s in hit.spans} <= {"zorgu", "krazz"}
    kept = toxicity.without_toxic(docs, field)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in rows.values())
    assert toxicity.score(empty, toxicity.learn(empty, labels.limit(0))).count() == 0


def test_toxic_words_of_a_small_language_are_learnt(spark):
    prepare(spark)
    rng = random.Random(8)
    known = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(2000)]
    other = ["".join(rng.choices("mnopqrstuv", k=rng.randint(2, 7))) for _ in range(2000)]
    rows, labels = [], []
    for i in range(900):
        small = i % 15 == 7
        own = rng.choices(other if small else known, k=60)
        if toxic := i % 90 == 7 if small else i % 4 == 0:
            own[rng.randrange(60)] = own[rng.randrange(60)] = "wyxxaz" if small else "zorgul"
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, field).filter("held_out").collect()}
    rare = [i for i in found if "wyxxaz" in rows[i][1]]
    assert rare and all(found[i] for i in rare)
    assert sum(found[i] != labels[i][1] for i in found) <= 0.03 * len(found)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    emission, pairs = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    held = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    marginal, _, _ = toxicity.forward_backward(emission, held, pairs)
    for row in range(3):
        n = int(held[row].sum())
        total, on = 0.0, np.zeros(n)
        for path in np.ndindex(*[2] * n):
            score = sum(emission[row, k] * path[k] for k in range(n))
            score += sum(pairs[path[k], path[k + 1]] for k in range(n - 1))
            total += np.exp(score)
            on += np.exp(score) * np.array(path)
        assert np.allclose(marginal[row, :n], on / total)


def test_quality(judged, empty):
    docs, labels = judged
    rows = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert sum(rows[i].kept == (i % 5 != 0) for i in range(600)) > 590
    assert len(rows) == 602 and 0 <= rows[600].quality <= 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows.values())
    assert quality.score(empty, labels.limit(0)).count() == 0


def test_sparse_sites_shrink_toward_the_whole(spark):
    prepare(spark)
    evidence = [("large", "x", 0.9)] * 400 + [("large", "y", 0.5)] * 300 + [("other", "x", 0.2)] * 300 + [("tiny", "x", 0.0)]
    stage = quality.stage_in(shared_dir(spark, "sites"))
    sites = quality.posteriors(spark.createDataFrame(evidence, "host string, path string, p double"), stage)
    rate = {r.host: r.host_rate for r in sites.table.collect()}
    assert abs(rate["large"] - 0.73) < 0.02 and 0.1 < rate["tiny"] < sites.rate
