"""The k-d tree next to one grown in plain Python, and what balance it reaches."""

from __future__ import annotations

import collections
import random

import pytest

from forgeboard.llm import sharding
from forgeboard.llm.frames import prepare

DIMS = ["d0", "d1", "d2", "d3"]
UNIT = "h long, text_crc32 long, cut long, bytes long, d0 int, d1 int, d2 int, d3 int, u int, node int"


def below(cells, share):
    """The first ordered place whose running weight reaches ``share``, and the weight before it."""
    before = 0
    for place, weight in sorted(cells.items()):
        if before + weight >= share:
            return place, before
        before += weight
    return place, before - weight


def grow(units, first, shards, least, out):
    if shards == 1 or not units:
        out.update({u[0]: first for u in units})
        return
    half = shards // 2
    dim = max(range(4), key=lambda d: (max(u[4 + d] for u in units) - min(u[4 + d] for u in units), -d))
    share = sum(u[3] for u in units) * half / shards
    whole = collections.Counter()
    for u in units:
        whole[u[4 + dim]] += u[3]
    step, _ = below(whole, share)
    left, room = [], share
    heavy = sorted((u for u in units if u[3] > least), key=lambda u: (min(max(u[4 + dim] - step, -1), 1), -u[3], u[:3]))
    for u in heavy:
        if u[4 + dim] < step or (u[4 + dim] == step and u[3] <= room):
            left.append(u)
            room -= u[3]
    light = [u for u in units if u[3] <= least]
    if light:
        cells = collections.Counter()
        for u in light:
            cells[u[4 + dim]] += u[3]
        step, before = below(cells, room)
        fine = collections.Counter()
        for u in light:
            if u[4 + dim] == step:
                fine[u[8]] += u[3]
        place, passed = below(fine, room - before)
        with_place = room - before - passed > fine[place] / 2
        left += [
            u for u in light if u[4 + dim] < step or (u[4 + dim] == step and (u[8] <= place if with_place else u[8] < place))
        ]
    held = {u[0] for u in left}
    grow(left, first, half, least, out)
    grow([u for u in units if u[0] not in held], first + half, shards - half, least, out)


@pytest.mark.parametrize(("shards", "heavies"), [(1, 0), (2, 5), (7, 0), (13, 12), (40, 30)])
def test_tree_against_plain_python(spark, shards, heavies):
    prepare(spark)
    random.seed(shards)
    units = [
        (i, i * 7 % 101, 0, random.randint(300, 900) if i < heavies else random.randint(1, 60),
         random.randint(0, 1023), random.choice([5, 900]), random.randint(0, 40), random.randint(0, 1023), random.randint(0, 9), 0)
        for i in range(700)
    ]
    got = sharding._tree(spark.createDataFrame(units, UNIT), shards, 299).collect()
    want: dict[int, int] = {}
    grow(units, 0, shards, 299, want)
    assert len(got) == len(units) and {r.h: r["shard"] for r in got} == want


def test_equal_texts_stay_whole_and_shards_equal(spark):
    prepare(spark)
    random.seed(11)
    texts = [f"{i} " + "word " * random.randint(1, 60) for i in range(6000)]
    for copies, size in ((2, 1500), (12, 300), (30, 100), (60, 40), (3, 900)):
        texts += [f"group of {copies} " + "copy " * size] * copies
    texts += ["hot " * 40] * 3000  # a quarter of all bytes, which no shard holds
    rows = [(i, t, random.choice(["en", "de", None]), f"s{i % 20}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    keys = {"spark.sql.codegen.fallback": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)  # code that does not compile fails the query
    try:
        got = sharding.shard(docs, 40).collect()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    sums, shards_of = collections.Counter(), collections.defaultdict(set)
    weight = collections.Counter()
    for r in got:
        sums[r["shard"]] += r.size
        shards_of[r.text_crc32].add(r["shard"])
        weight[r.text_crc32] += r.size
    target = sum(sums.values()) / 40
    assert len(got) == len(texts) and len(sums) == 40
    assert max(sums.values()) < 1.02 * min(sums.values())
    torn = [c for c, s in shards_of.items() if len(s) > 1]
    assert all(weight[c] > target / 2 for c in torn) and len(torn) < 10
    assert sum(weight[c] > target / 64 for c in weight) > len(torn)
