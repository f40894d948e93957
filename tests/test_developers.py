from __future__ import annotations

import pytest

from forgeboard.functions.params import ParameterError
from forgeboard.operators import developers, moderation, search
from forgeboard.plans.listings import list_devs, list_repos
from forgeboard.sources.snapshots import Snapshot
from tests.conftest import column, repo


@pytest.fixture
def three(make):
    users = make.users(
        {"login": "user1", "type": "User", "followers": 50, "public_repos": 30},
        {"login": "user2", "type": "User", "followers": 100, "public_repos": 10},
        {"login": "user3", "type": "User", "followers": 20, "public_repos": 100},
    )
    repos = make.repos(
        repo("user1", "repo1", 100, forks_count=10),
        repo("user2", "repo2", 50, forks_count=80),
        repo("user3", "repo3", 20, forks_count=30),
    )
    return users, repos


@pytest.mark.parametrize(
    ("sort_by", "want"),
    [
        ("stars", [1, 2, 3]),
        ("", [1, 2, 3]),
        (None, [1, 2, 3]),
        ("forks", [2, 3, 1]),
        ("followers", [2, 1, 3]),
        ("public_repos", [3, 1, 2]),
        ("invalid_sort", [1, 2, 3]),
    ],
)
def test_sorting(three, sort_by, want):
    got = developers.popular_devs(*three, "User", sort_by=sort_by)
    assert column(got, "login") == [f"user{i}" for i in want]


def test_company_filter(make):
    users = make.users({"login": "popular-dev", "company": "Acme Corp", "type": "User"})
    repos = make.repos(repo("popular-dev", "repo", 5, forks_count=1))
    assert developers.popular_devs(users, repos, "User").count() == 1
    assert developers.popular_devs(users, repos, "User", "acme").count() == 1
    assert developers.popular_devs(users, repos, "User", "A_me").count() == 1
    assert developers.popular_devs(users, repos, "User", "nonexistent").count() == 0


def test_nothing_to_list(make):
    empty = make.users(), make.repos()
    assert developers.popular_devs(*empty, "User", "company", "").count() == 0


def test_who_is_listed(make):
    users = make.users(
        {"login": "shown", "type": "User"},
        {"login": "hidden", "type": "User", "hide": True},
        {"login": "unsure", "type": "User", "hide": None},
        {"login": "idle", "type": "User"},
        {"login": "firm", "type": "Organization"},
        {"login": "untyped"},
    )
    repos = make.repos(*[repo(o, "r", 1) for o in ("shown", "hidden", "unsure", "firm", "orphan", "untyped")])
    assert column(developers.popular_devs(users, repos, "User"), "login") == ["shown"]
    assert developers.popular_devs(users, repos, "").count() == 0


def test_unknown_values_rank_first_and_show_as_zero(make):
    users = make.users(
        {"login": "a", "type": "User", "followers": 9},
        {"login": "b", "type": "User", "followers": None},
        {"login": "c", "type": "User", "followers": 9},
    )
    repos = make.repos(repo("a", "r", 1), repo("b", "r", None), repo("c", "r", 2))
    by_followers = developers.popular_devs(users, repos, "User", sort_by="followers").collect()
    assert [(r.login, r.followers) for r in by_followers] == [("b", 0), ("c", 9), ("a", 9)]
    by_stars = developers.popular_devs(users, repos, "User").collect()
    assert [(r.login, r.stars) for r in by_stars] == [("b", None), ("c", 2), ("a", 1)]


def test_limit_and_tie_break(make):
    users = make.users(*[{"login": f"u{i:03}", "type": "User"} for i in range(120)])
    repos = make.repos(*[repo(f"u{i:03}", "r", 7) for i in reversed(range(120))])
    got = column(developers.popular_devs(users, repos, "User"), "login")
    assert got == [f"u{i:03}" for i in range(100)]


def test_get_user_is_exact_and_defaulted(make):
    users = make.users({"login": "Bob"}, {"login": "idle", "followers": 3})
    repos = make.repos(repo("Bob", "r", None), repo("bob", "s", 9))
    assert developers.get_user(users, repos, "bob").count() == 0
    row = developers.get_user(users, repos, "Bob").first()
    assert (row.stars, row.email, row.followers, row.hireable, row.created_at) == (0, "", 0, False, None)
    assert developers.get_user(users, repos, "idle").first().forks == 0


def test_repos_for_user_order(make):
    repos = make.repos(
        repo("Bob", "x", 5, "go"),
        repo("bob", "y", None, None),
        repo("BOB", "w", 9, "Go"),
        repo("bob", "a", 9, "Go"),
        repo("eve", "z", 1),
    )
    got = developers.repos_for_user(repos, "bOb").collect()
    assert [(r.language, r.stargazers_count, r.name) for r in got] == [
        ("", 0, "y"), ("Go", 9, "a"), ("Go", 9, "w"), ("go", 5, "x"),
    ]
    in_words = developers.repos_for_user(repos, "bob", collation="UNICODE")
    assert column(in_words, "language") == ["", "go", "Go", "Go"]


def test_profile(make):
    users = make.users({"login": "bob"}, {"login": "idle"})
    repos = make.repos(repo("BOB", "x", 5), repo("bob", "y", None, None), repo("bob", "z", 1, ""))
    assert developers.profile(users, repos, "BOB").repos.count() == 0
    assert developers.nested_profile(users, repos, "BOB").count() == 0
    rows = developers.nested_profile(users, repos, "bob").orderBy("language").collect()
    assert [(r.language, r.page, [e.name for e in r.repos]) for r in rows] == [("", 0, ["z", "y"]), ("Go", 0, ["x"])]
    assert {r.user.stars for r in rows} == {1}
    idle = developers.nested_profile(users, repos, "idle").collect()
    assert [(r.user.login, r.language, r.page, r.repos) for r in idle] == [("idle", None, 0, [])]


def test_pages_of_a_profile_follow_one_rule(make):
    users = make.users({"login": "big"})
    repos = make.repos(*[repo("big", f"r{i:03}", i * 7 % 50, f"L{i % 3}") for i in range(200)])
    flat = [(r.language, r.name) for r in developers.profile(users, repos, "big").repos.collect()]
    for size in (20, 66, 67, 1000):
        pages = [
            developers.nested_profile(users, repos, "big", page_rows=size).orderBy("language", "page").collect()
            for _ in range(2)
        ]
        assert pages[0] == pages[1]
        assert [(p.language, e.name) for p in pages[0] for e in p.repos] == flat
        for language in ("L0", "L1", "L2"):
            held = [len(p.repos) for p in pages[0] if p.language == language]
            assert held[:-1] == [size] * (len(held) - 1) and 0 < held[-1] <= size
            assert [p.page for p in pages[0] if p.language == language] == list(range(len(held)))


def test_listing_requests(make, three):
    snapshot = Snapshot(*three)
    for wrong in ({}, {"q": "", "dev_type": ""}, {"q": "a", "dev_type": "User"}):
        with pytest.raises(ParameterError):
            list_devs(snapshot, **wrong)
    assert column(list_devs(snapshot, q="user"), "login") == ["user1", "user2", "user3"]
    assert column(list_devs(snapshot, dev_type="User", sort="forks"), "login")[0] == "user2"
    assert column(list_repos(snapshot, "REPO2"), "name") == ["repo2"]
    with pytest.raises(ParameterError):
        list_repos(snapshot, "")


def test_hiding_is_seen_in_the_profile(make):
    users, repos = make.users({"login": "bob"}), make.repos()
    for hide in (True, False):
        users = moderation.hide_users(users, make.frame("login string, hide boolean", ("bob", hide))).users
        assert developers.nested_profile(users, repos, "bob").first().user.hide is hide


def test_totals_beyond_32_bits(make):
    users = make.users({"login": "big", "type": "User"}, {"login": "bare", "type": "User"})
    most = 2**31 - 1
    repos = make.repos(*[repo("big", name, most, forks_count=most) for name in "abc"])
    assert tuple(developers.get_user(users, repos, "big").select("stars", "forks").first()) == (3 * most, 3 * most)
    assert column(developers.popular_devs(users, repos, "User"), "stars") == [3 * most]
    assert column(search.search_users(users, repos, "big"), "stars") == [3 * most]
    pages = developers.nested_profile(users, repos, "big", page_rows=2).orderBy("page").collect()
    assert [(p.user.stars, [r.name for r in p.repos]) for p in pages] == [(3 * most, ["a", "b"]), (3 * most, ["c"])]
    bare = developers.nested_profile(users, repos, "bare").collect()
    assert [(p.user.stars, p.language, p.page, p.repos) for p in bare] == [(0, None, 0, [])]


def test_pages_of_a_profile_are_not_broadcast(make):
    """The one profile is what is sent to the pages, never the other way round."""
    users, repos = make.users({"login": "big"}), make.repos(repo("big", "a"), repo("big", "b"))
    plan = developers.nested_profile(users, repos, "big")._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoopJoin" not in plan and "LeftOuter" not in plan
