"""The near-copy join on hot groups, against all pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from forgeboard.llm import jaccard
from forgeboard.llm.frames import prepare
from forgeboard.session import stage_in


def components_of(texts: list[str], width: int, percent: int) -> list[int]:
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))})
    low = list(range(len(texts)))

    def root(v):
        while low[v] != v:
            v = low[v]
        return v

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            low[y] = x
    return [root(v) for v in range(len(texts))]


def hot_texts() -> list[str]:
    """A large group of copies with edits, some just too far from each other, and a passage that many share."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(60)]
    texts = []
    for i in range(160):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(60)] = word()
        if i % 5 == 0:
            own = own[: 60 - rng.randrange(9)]
        texts.append(" ".join(own))
    passage = [word() for _ in range(30)]
    texts += [" ".join([*passage, *[word() for _ in range(i % 12)]]) for i in range(80)]
    texts += [" ".join(word() for _ in range(40)) for _ in range(20)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small, block", [(32, 2048), (2, 16)])
def test_hot_groups_against_all_pairs(spark, monkeypatch, small, block):
    prepare(spark)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = hot_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.join_components(docs).collect()}
    want = components_of(texts, 4, 85)
    assert 20 < len(set(want)) < 200
    assert [got[i] for i in range(len(texts))] == want


def test_blocks_hold_every_pair_that_may_be_linked(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(3)
    every = {}
    base = rng.integers(0, 1 << 63, size=80, dtype=np.uint64)
    for node in range(90):
        own = rng.random(80) < rng.choice([0.8, 0.95, 1.0])
        every[node] = np.unique(np.append(base[own], rng.integers(0, 1 << 63, size=int(rng.integers(0, 9)), dtype=np.uint64)))
    rows = [(0, v, len(h), int(rng.choice([1, 2, 3, 4, 8])), v % 7) for v, h in every.items()]
    rows += [(1 + v % 9, v, len(h), 3, v % 7) for v, h in every.items()]
    rows += [(50, 3, len(every[3]), 3, 3), (51, 4, len(every[4]), 3, 4), (51, 11, len(every[11]), 3, 4)]
    sketches = spark.createDataFrame(
        [(v, bytearray(jaccard.parities(h, jaccard.SKETCH))) for v, h in every.items()], "node long, sketch binary"
    )
    frame = spark.createDataFrame(rows, "key long, node long, n long, role int, comp long")
    bands, want = jaccard.Bands(80), set()
    probe, index = jaccard.PROBE | jaccard.PROBE_LESS, jaccard.INDEX | jaccard.INDEX_LESS
    for (k, a, n, r, c), (l, b, m, s, d) in itertools.permutations(rows, 2):
        if k == l and c != d and m <= n and 100 * m >= 80 * n and r & probe and s & index:
            least = jaccard.apart_at_least(*(jaccard.parities(every[v], jaccard.SKETCH) for v in (a, b)))
            if least <= bands.difference(np.array([n]), np.array([m]))[0]:
                want.add((min(a, b), max(a, b)))
    got = {tuple(r) for r in jaccard.compared(frame, sketches, 80).distinct().collect()}
    assert got == want and len(want) > 50
    assert jaccard.compared(frame.limit(0), sketches, 80).count() == 0
    near = {tuple(r) for r in jaccard.compared(frame, sketches, 80, nearest=True).collect()}
    assert near <= want and len(near) < len(want)
    # Every component that has a pair at all has one here.
    assert {v % 7 for p in near for v in p} == {v % 7 for p in want for v in p}


def test_texts_move_only_for_pairs_that_may_be_linked(spark, tmp_path):
    prepare(spark)
    plain, rows = stage_in(str(tmp_path)), {}

    def stage(name, df, *by):
        rows[name] = plain(name, df, *by)
        return rows[name]

    texts = hot_texts()
    # Repeated rows, of which one speaks.
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] * 2, "doc_id long, text string, row long")
    jaccard.links(docs, stage, 4, 85)
    assert rows["texts"].count() == rows["texts"].select("node").distinct().count()
    for name in ("links-1", "links-star-2"):
        wanted = {n for r in rows[f"possible-{name}"].collect() for n in r}
        assert wanted and {r.node for r in rows[f"met-{name}"].collect()} == wanted
    assert rows["met-links-star-2"].count() < rows["texts"].count()


def test_a_set_is_signed_and_moved_once(spark, tmp_path):
    prepare(spark)
    plain, rows, plans = stage_in(str(tmp_path)), {}, {}

    def stage(name, df, *by):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        rows[name] = plain(name, df, *by)
        return rows[name]

    texts = hot_texts()
    # Copies, of which none is signed, and two rows of an id that are the same.
    docs = [(i, t, i) for i, t in enumerate([*texts, *texts])] + [(0, texts[0], 0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, row long").repartition(5)
    jaccard.links(docs, stage, 4, 85)
    assert "Join" not in plans["spoken"]  # texts are picked out where they are read
    assert rows["speaker"].count() == len(set(texts)) and rows["again"].count() == 1
    assert rows["spoken"].count() == rows["spoken"].select("node").distinct().count() + 1
    marks = jaccard._marks(rows["speaker"].selectExpr("xxhash64(row) AS node"))
    signed = lambda docs: jaccard.signatures(docs.selectExpr("xxhash64(row) AS lot", "text").coalesce(1), marks, 4, 85)
    assert signed(docs.filter(f"row >= {len(texts)}")).isEmpty()
    assert signed(docs).count() == signed(docs.filter(f"row < {len(texts)}")).count() > 0
    assert rows["crowd-texts"].select("node").distinct().count() == rows["crowd"].select("node").distinct().count()


def test_shingles_that_no_other_set_holds_leave_no_row(spark, tmp_path):
    prepare(spark)
    texts = hot_texts()
    rng = random.Random(8)
    lone = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(50)) for _ in range(100)]
    every = spark.createDataFrame(list(enumerate([*texts, *lone])), "node long, text string")
    # Nodes are hashes in earnest, and their leading bits tell them apart.
    every = every.selectExpr("node AS at", "xxhash64(node) AS node", "text")
    crowd = every.selectExpr("node", "cast(size(split(text, ' ')) - 3 as long) AS n", "at AS comp")
    rare = jaccard._rarest(crowd, every.select("node", "text"), 4, 85, stage_in(str(tmp_path))).collect()
    assert {r.comp for r in rare} and max(r.comp for r in rare) < len(texts)
    keys = {}
    for r in rare:
        keys.setdefault(r.comp, set()).add(r.key)
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    linked = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            linked += 1
            assert keys.get(a, set()) & keys.get(b, set())
    assert linked > 100


def test_kept_texts_are_picked_out_where_they_are(spark):
    prepare(spark)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string").repartition(3)
    kept = jaccard.one_of_each(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


@pytest.mark.parametrize("bits", [6, 8, 12, 26])
def test_rows_of_are_exact_however_full_the_bitmaps_are(spark, monkeypatch, bits):
    prepare(spark)
    monkeypatch.setattr(jaccard, "MARK_BITS", bits)
    # Every third row goes; every seventh lies twice.
    rows = [(i, str(i)) for i in range(200) for _ in range(1 + (i % 7 == 0))]
    keyed = spark.createDataFrame(rows, "id long, text string").repartition(3).selectExpr("xxhash64(id) AS row", "id", "text")
    every = keyed.select("row").distinct()
    kept = keyed.filter("id % 3 > 0").groupBy("row").count().withColumnRenamed("count", "held")
    want = [i for i in range(200) if i % 3]
    assert sorted(r.id for r in jaccard._rows_of(keyed, every, kept).collect()) == want
    twice = keyed.selectExpr("row", "1L AS held").filter("row IS NOT NULL").distinct().join(kept.select("row"), "row", "left_semi")
    assert sorted(r.id for r in jaccard._rows_of(keyed, every, twice).collect()) == sorted(i for i, _ in rows if i % 3)
    assert jaccard._rows_of(keyed, every, kept.filter("held > 5")).count() == 0
