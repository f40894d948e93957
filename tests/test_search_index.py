from __future__ import annotations

import random

import pytest

from forgeboard.functions.text import contains_pattern, literal_runs
from forgeboard.operators import search
from forgeboard.plans import search_index
from forgeboard.plans.search_index import SearchIndex, term_grams
from forgeboard.session import shared_dir
from forgeboard.sources.snapshots import Snapshot, SnapshotStore
from tests.conftest import repo

WORDS = ["Parser", "kit", "100%", "a_b", "data\\base", "ΟΔΟΣ", "straße", "İstanbul", "日本語です", "💡lamp", "x", ""]
TERMS = [
    "parser", "PARSER k", "100%", r"100\%", "a_b", r"a\_b", r"data\\base", "data\\base", "οδοσ", "ΟΔΟΣ ki", "STRASSE",
    "straße", "i̇sta", "İST", "日本語", "本語で", "💡la", "la%kit", "kit%par", "zzz", "r k", "x", "", "%", "\\", "login-1",
    "user-17", "User", "e%r-3", "parser" * 40,
]


def stored(spark, make):
    random.seed(5)
    store = SnapshotStore(spark, shared_dir(spark, "store"), parts=6)
    users = [{"login": f"{random.choice(['user', 'User', 'uſer', 'login'])}-{i}"} for i in range(60)]
    repos = [
        repo(random.choice(users)["login"], f"{random.choice(WORDS)} {i}", i % 7,
             description=random.choice([None, " ".join(random.choices(WORDS, k=4))]))
        for i in range(150)
    ]
    return store, store.publish(Snapshot(make.users(*users), make.repos(*repos)))


def test_runs_and_grams():
    assert literal_runs(contains_pattern(r"ab_c\%d%\\e")) == ["ab", "c%d", "\\e"]
    assert literal_runs(contains_pattern("\\")) == ["%"]
    assert term_grams("%ab%cd_e%") == []
    assert term_grams("%abcabc%") == ["abc", "bca", "cab"]
    assert len(term_grams("%" + "".join(map(chr, range(200, 900))) + "%")) <= search_index.MOST_GRAMS


@pytest.mark.parametrize(("block_rows", "terms"), [(1, TERMS), (4096, TERMS[::6])])
def test_finds_what_a_whole_scan_finds(spark, make, monkeypatch, block_rows, terms):
    monkeypatch.setattr(search_index, "BLOCK_ROWS", block_rows)
    store, version = stored(spark, make)
    index, now = SearchIndex(store, shared_dir(spark, "index")), store.read(version)
    for term in terms:
        want = search.search_repos(now.repos, term, 1000).collect()
        assert index.search_repos(version, term, 1000).collect() == want, term
        want = search.search_users(now.users, now.repos, term, 1000, now.totals).collect()
        assert index.search_users(version, term, 1000).collect() == want, term


def test_reads_candidate_files_only(spark, make, monkeypatch):
    store = SnapshotStore(spark, shared_dir(spark, "store"), parts=8)
    owners = [f"owner{i}" for i in range(40)]
    repos = [repo(o, f"name{i}", i, description="plain words") for i, o in enumerate(owners)]
    repos[7]["description"] = "A Needle here"
    version = store.publish(Snapshot(make.users(*[{"login": o} for o in owners]), make.repos(*repos)))
    index = SearchIndex(store, shared_dir(spark, "index"))
    every = store.read(version).repos.inputFiles()
    found = index.search_repos(version, "needle")
    assert len(found.inputFiles()) == 1 < len(every) and found.count() == 1
    assert index.search_repos(version, "haystack").inputFiles() == []
    assert len(index.search_repos(version, "words").inputFiles()) >= len(every) - 1
    # With too many files to name, the parts they lie in are read whole.
    monkeypatch.setattr(search_index, "MOST_FILES", 2)
    assert index.search_repos(version, "words").count() == 39
    assert index.search_repos(version, "needle").inputFiles() == found.inputFiles()
    # Trigrams must meet in one field and one block.
    assert index.candidates("repos", version, "%name7 a needle%") == []


def test_a_new_version_costs_what_it_wrote(spark, make):
    store, first = stored(spark, make)
    index = SearchIndex(store, shared_dir(spark, "index"))
    before = index.build("repos", first)
    assert index.build("repos", first) == before and len(before) == 1
    owner = "user-new"
    touched = store.touched_parts(make.frame("owner string", (owner,)))
    held = store.read(first, touched)
    added = make.repos(repo(owner, "fresh needle", 1))
    newer = Snapshot(held.users.unionByName(make.users({"login": owner})), held.repos.unionByName(added))
    second = store.publish(newer, touched)
    after = index.build("repos", second)
    assert len(after) == 2 and before.items() <= after.items()
    assert [r.owner for r in index.search_repos(second, "fresh need").collect()] == [owner]
    assert index.search_repos(first, "fresh need").count() == 0
    for term in ("parser", "kit", "データ", "x 1"):
        want = search.search_repos(store.read(second).repos, term, 1000).collect()
        assert index.search_repos(second, term, 1000).collect() == want


def test_empty_store(spark, make):
    store = SnapshotStore(spark, shared_dir(spark, "store"), parts=2)
    version = store.publish(Snapshot(make.users(), make.repos()))
    index = SearchIndex(store, shared_dir(spark, "index"))
    assert index.search_repos(version, "any").count() == index.search_users(version, "any").count() == 0
