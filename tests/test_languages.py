from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from forgeboard.functions.params import ParameterError, page_bounds, sort_key
from forgeboard.operators import languages, paging
from forgeboard.plans.leaderboards import Leaderboards
from forgeboard.session import shared_dir
from forgeboard.sources.snapshots import Snapshot, SnapshotStore
from tests.conftest import column, repo


def test_popular_languages(make):
    repos = make.repos(
        repo("a", "1", language="Go", fork=False),
        repo("a", "2", language="Go", fork=False),
        repo("b", "3", language="go", fork=False),
        repo("b", "4", language="C", fork=False),
        repo("b", "5", language=None, fork=False),
        repo("c", "6", language="Go", fork=True),
        repo("c", "7", language="Go", fork=None),
        repo("c", "8", language="", fork=False),
    )
    got = [tuple(r) for r in languages.popular_languages(repos).collect()]
    assert got == [("Go", 2, 1), ("", 1, 1), ("C", 1, 1), ("go", 1, 1)]


def test_leaders_edges(make):
    users = make.users({"login": "a", "type": "User"}, {"login": "b", "name": "Bee"}, {"login": "n"})
    repos = make.repos(
        repo("a", "low", 1), repo("a", "unknown", None, "GO"), repo("a", "tie2", 5, "go"),
        repo("a", "tie1", 5), repo("b", "x", 50), repo("b", "c", 900, "C"),
        repo("n", "none", None), repo("orphan", "o", 999),
    )
    got = languages.language_leaders(repos, users, "gO").collect()
    assert [(r.owner, r.name, r.rownum, r.total_stars) for r in got] == [
        ("n", "none", 1, None),
        ("b", "x", 1, 50),
        ("a", "unknown", 1, 11),
        ("a", "tie1", 2, 11),
        ("a", "tie2", 3, 11),
    ]
    assert (got[1].display_name, got[1].type, got[2].stargazers_count) == ("Bee", "", 0)


@pytest.fixture(scope="module")
def board(spark):
    from tests.conftest import Maker

    make = Maker(spark)
    logins = [f"o{i:02}" for i in range(60)]
    users = make.users(*[{"login": l, "name": l.upper()} for l in logins])
    repos = make.repos(*[repo(l, f"r{j}", (i % 7) * 10 + j) for i, l in enumerate(logins) for j in range(5)])
    store = SnapshotStore(spark, shared_dir(spark, "board"), parts=4)
    store.publish(Snapshot(users, repos))
    return store, users, repos


def shape(page):
    return [(r.owner, r["count"], r.name, [x.name for x in r.repos]) for r in page.collect()]


def test_pages_are_slices(spark, board):
    store, users, repos = board
    boards = Leaderboards(store, shared_dir(spark, "boards"))
    whole = languages.by_owner(languages.leaders_of(repos, users, "go")).collect()
    whole = sorted(whole, key=lambda r: (-r["count"], r.owner))
    want = [(r.owner, r["count"], r.name, [x.name for x in r.repos]) for r in whole]
    assert len(want) == 60 and want[0][3] == ["r4", "r3", "r2"]
    for limit, offset in [(None, None), (25, 0), (25, 25), (25, 50), (7, 13), (25, 60), (25, 100)]:
        size, start = page_bounds(limit, offset)
        direct = languages.language_page(repos, users, "GO", limit, offset)
        stored = boards.page(1, "Go", limit, offset)
        assert shape(direct.languages) == shape(stored.languages) == want[start : start + size]
        assert direct.count.first()[0] == stored.count.first()[0] == 60
        assert direct.language == "GO"


def test_pages_begin_where_counting_says(spark, board):
    store, users, repos = board
    want = [
        r.owner
        for r in languages.by_owner(languages.leaders_of(repos, users, "go"))
        .orderBy("count", "owner", ascending=[False, True])
        .collect()
    ]
    # Nothing may be passed over by sorting: every start is counted out.
    boards = Leaderboards(store, shared_dir(spark, "boards"), few=0)
    assert len(boards.build(1)) > 1
    stored = [x[0] for at in range(0, 66, 11) for x in shape(boards.page(1, "go", 11, at).languages)]
    direct = [
        x[0]
        for at in range(0, 75, 25)
        for x in shape(languages.language_page(repos, users, "go", 25, at, few=0).languages)
    ]
    assert stored == direct == want


def test_key_and_step_follow_the_order(spark, make):
    totals = [None, 2**63 - 1, 2**40 + 1, 2**40, 129, 128, 127, 65, 64, 63, 3, 2, 1, 0, -1, -(2**63)]
    rows = [(t, o) for t in totals for o in ("", "B", "a", "a b", "é", "\uffee", "😀")]
    df = make.frame("total bigint, owner string", *rows).select(
        "*",
        paging.board_key(F.col("total"), F.col("owner")).alias("key"),
        paging.total_step(F.col("total")).alias("step"),
    )
    got = df.orderBy("key").collect()
    assert [(r.total, r.owner) for r in got] == rows
    steps = [r.step for r in got]
    assert steps == sorted(steps) and steps[0] == 0 and max(steps) <= 4096
    assert len({r.step for r in got if r.total in (2, 1, 0)}) == 3
    stage = df.select("key", "owner", "total").cache()
    for at in (0, 1, 6, 7, 50, len(rows) - 1):
        page = paging.slice_of(stage, "key", 3, at, few=0).collect()
        assert [(r.total, r.owner) for r in page] == rows[at : at + 3]
    for at in (len(rows), len(rows) + 5):
        assert paging.slice_of(stage, "key", 3, at, few=0).count() == 0
    assert paging.slice_of(stage.limit(0), "key", 3, 5, few=0).count() == 0
    stage.unpersist()


def test_a_new_version_costs_its_touched_parts(spark, make):
    store = SnapshotStore(spark, shared_dir(spark, "versions"), parts=8)
    logins = [f"o{i:02}" for i in range(40)]
    users = make.users(*[{"login": l} for l in logins])
    old = make.repos(*[repo(l, f"r{j}", i + j, "go" if j else "C", fork=False) for i, l in enumerate(logins) for j in range(4)])
    store.publish(Snapshot(users, old))
    boards = Leaderboards(store, shared_dir(spark, "boards"))
    before = boards.build(1)
    assert boards.build(1) == before
    touched = store.touched_parts(make.frame("owner string", ("o07",)))
    part = store.read(parts=touched)
    raised = part.repos.withColumn("stargazers_count", F.expr("IF(owner = 'o07', 1000, stargazers_count)"))
    store.publish(Snapshot(part.users, raised), touched)
    read = []
    whole, store.read = store.read, lambda version, parts: read.append(parts) or whole(version, parts)
    after = boards.build(2)
    assert read == [touched]
    assert {p for p in after if after[p] != before[p]} == set(touched)
    now = whole(2)
    want = languages.language_page(now.repos, now.users, "go", 25, 0)
    assert shape(boards.page(2, "go", 25, 0).languages) == shape(want.languages)
    assert column(boards.page(2, "go", 1, 0).languages, "count") == [3000]
    assert column(boards.page(1, "go", 1, 0).languages, "owner") == ["o39"]
    assert boards.popular_languages(2).collect() == languages.popular_languages(now.repos).collect()
    assert read == [touched]


def test_parts_without_languages(spark, make):
    store = SnapshotStore(spark, shared_dir(spark, "versions"), parts=4)
    store.publish(Snapshot(make.users({"login": "a"}), make.repos(repo("a", "r", 1, None))))
    boards = Leaderboards(store, shared_dir(spark, "boards"))
    for _ in range(2):
        assert boards.page(1, "go").languages.count() == 0
        assert boards.popular_languages(1).count() == 0
    store.publish(Snapshot(make.users(), make.repos()))
    assert boards.page(2, "go").count.first()[0] == 0


def test_unknown_language_has_an_empty_page(spark, board):
    boards = Leaderboards(board[0], shared_dir(spark, "boards"))
    page = boards.page(1, "cobol")
    assert page.languages.count() == 0 and page.count.first()[0] == 0


def test_stored_board_follows_the_version(spark, make):
    store = SnapshotStore(spark, shared_dir(spark, "versions"), parts=2)
    users = make.users({"login": "a"})
    store.publish(Snapshot(users, make.repos(repo("a", "r", 1), repo("a", "c", 5, "C"))))
    boards = Leaderboards(store, shared_dir(spark, "boards"))
    first = boards.page(1, "go").languages, boards.page(1, "c").languages
    assert [column(f, "count") for f in first] == [[1], [5]]
    store.publish(Snapshot(users, make.repos(repo("a", "r", 2), repo("a", "c", 6, "C"))))
    # One language read anew does not make the other's old board look fresh.
    assert column(boards.page(2, "go").languages, "count") == [2]
    assert column(boards.page(2, "c").languages, "count") == [6]
    assert column(boards.page(1, "GO").languages, "count") == [1]


def test_parameters():
    assert page_bounds(None, None) == (25, 0)
    for limit, offset in [(0, 0), (-1, 0), (5, -1)]:
        with pytest.raises(ParameterError):
            page_bounds(limit, offset)
    assert page_bounds(3, 4) == (3, 4)
    with pytest.raises(ParameterError):
        page_bounds(26, 0)
    assert [sort_key(k) for k in ("forks", "", None, "login")] == ["forks", "stars", "stars", "stars"]
