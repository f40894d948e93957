"""The whole pipeline on planted rows, every stage held against plain Python."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from forgeboard.llm import encoder, quality, toxicity
from forgeboard.llm.frames import prepare
from forgeboard.session import shared_dir

WORD = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
COPIED, NEAR = 901, 950  # originals of exact and near copies


@pytest.fixture(scope="module")
def folder(spark):
    prepare(spark)
    random.seed(9)
    words = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(400):
        own = random.choices(words, k=random.randint(40, 120))
        toxic, bad = i % 4 == 0, i % 5 == 0
        for _ in range(3 * toxic):
            own[random.randrange(len(own))] = random.choice(["zorgul", "krazzet"])
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in own), "en", f"s{i % 3}", None))
        labels.append((i, int(not bad), int(toxic)))
    copy = " ".join(random.choices(words, k=80))
    near = random.choices(words, k=120)
    rows += [(COPIED + k, copy, "en", "s0", None) for k in range(20)]
    rows += [(NEAR + k, " ".join([*near[:119], f"w{'abcdefghij'[k]}"]), "en", "s1", None) for k in range(6)]
    rows += [rows[1], rows[1], (990, None, None, None, None), (991, "", "en", "s1", None), (None, copy, "en", "s1", None)]
    path = shared_dir(spark, "corpus")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def shingles(text):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))) if own else frozenset()


def survivors(rows):
    """The smallest id of every group of near copies; rows without words stand for themselves."""
    sets = [shingles(r.text) for r in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_empty = not a and not b and rows[i].doc_id is not None and rows[i].doc_id == rows[j].doc_id
            if same_empty or (a and b and 100 * len(a & b) >= 80 * len(a | b)):
                group[top(i)] = top(j)
    found = collections.defaultdict(list)
    for i, r in enumerate(rows):
        found[top(i)].append(r.doc_id)
    return sorted((min((d for d in ids if d is not None), default=None) for ids in found.values()), key=str)


def ids(rows):
    return sorted((r.doc_id for r in rows), key=str)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "toxicity", "near copies", "packing"]

    def stage(name, given):
        made = steps[name](spark, given, folder)
        path = shared_dir(spark, "stage")
        made.write.parquet(path)
        return spark.read.parquet(path)

    good = stage("quality", docs)
    assert good.columns == docs.columns
    verdicts = quality.score(docs, labels).collect()
    assert ids(good.collect()) == ids([r for r in verdicts if r.kept])
    kept = {r.doc_id for r in good.collect()}
    assert sum(i in kept for i in range(0, 400, 5)) <= 2  # bad ones go
    assert sum(i not in kept for i in range(400) if i % 5) <= 4  # clean ones stay
    assert {*range(COPIED, COPIED + 20), *range(NEAR, NEAR + 6)} <= kept

    civil = stage("toxicity", good)
    scores = toxicity.score(good, toxicity.learn(good, labels)).collect()
    assert civil.columns == docs.columns
    assert ids(civil.collect()) == ids([r for r in scores if not r.predicted])
    left = {r.doc_id for r in civil.collect()}
    toxic = [i for i in kept if i is not None and i < 400 and i % 4 == 0]
    assert sum(i in left for i in toxic) <= 2 and sum(i not in left for i in kept - set(toxic)) <= 2

    single = stage("near copies", civil)
    assert single.columns == docs.columns
    assert ids(single.collect()) == survivors(civil.collect())
    assert [i for i in ids(single.collect()) if i and COPIED <= i < 990] == [COPIED, NEAR]

    held = {r.doc_id: r.text for r in single.collect()}
    library = encoder.library("byte_bpe_50k.json")
    packed = stage("packing", single).collect()
    fill = collections.defaultdict(list)
    for r in packed:
        own = np.array([*library.encode(held[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        fill[r.sequence_id].append((r.offset, r.length))
    assert ids(r for r in packed if r.piece == 0) == ids(single.collect())
    for parts in fill.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048

    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_each_text_is_measured_once_for_its_quality(spark):
    prepare(spark)
    rows = [(i, f"Some words of text {i}, plain ones.", "en", f"s{i % 3}", 30) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    plan = quality.keep_good(docs, labels)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
