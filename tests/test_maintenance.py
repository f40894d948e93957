from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from forgeboard.operators import candidates, maintenance, moderation, runs
from forgeboard.sources import payload, schema
from forgeboard.sources.seeds import read_seeds
from tests.conftest import at, column, repo

T0, T1, T2 = at("2024-01-01"), at("2024-02-01"), at("2024-03-01")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_upsert_users(make):
    target = make.users(
        {"login": "kept", "bio": "old", "hide": True},
        {"login": "Bob", "bio": "old", "hide": True, "is_admin": True, "followers": 4},
    )
    incoming = make.users(
        {"login": "Bob", "bio": None, "followers": 1, "refreshed_at": T1},
        {"login": "Bob", "bio": None, "followers": 5, "refreshed_at": T2},
        {"login": "bob", "bio": "new", "hide": True, "is_admin": True},
    )
    got = maintenance.upsert_users(target, incoming)
    assert rows(got, "login", "bio", "followers", "hide", "is_admin") == sorted(
        [
            ("kept", "old", None, True, False),
            ("Bob", None, 5, True, True),
            ("bob", "new", None, False, False),
        ],
        key=str,
    )
    again = maintenance.upsert_users(got, incoming)
    assert rows(again, *schema.USER.names) == rows(got, *schema.USER.names)


def test_upsert_repos_takes_the_last_arrival(make):
    target = make.repos(repo("a", "x", 1, homepage="h"), repo("a", "y", 2))
    incoming = make.repos(
        repo("a", "x", 10), repo("a", "x", 30), repo("a", "x", 20), repo("b", "x", 7)
    ).withColumn("arrival", F.when(F.col("stargazers_count") == 30, 9).otherwise(1))
    got = maintenance.upsert_repos(target, incoming)
    assert rows(got, "owner", "name", "stargazers_count", "homepage") == [
        ("a", "x", 30, None), ("a", "y", 2, None), ("b", "x", 7, None),
    ]


@pytest.fixture
def stamped(make):
    repos = make.repos(
        repo("a", "old", refreshed_at=T0), repo("a", "new", refreshed_at=T1),
        repo("a", "never"), repo("A", "other", refreshed_at=T0), repo("b", "old", refreshed_at=T0),
        repo("empty", "old", refreshed_at=T0),
    )
    listed = make.frame("owner string, started_at timestamp", ("a", T0), ("a", T1), ("empty", T1))
    return repos, listed


def test_prune(stamped):
    got = maintenance.prune_stale_repos(*stamped)
    assert rows(got, "owner", "name") == [("A", "other"), ("a", "never"), ("a", "new"), ("b", "old")]


def test_replace_equals_upsert_then_prune(make, stamped):
    target, listed = stamped
    incoming = make.repos(
        repo("a", "old", 3, refreshed_at=T1), repo("a", "gone again", 3, refreshed_at=T0),
        repo("b", "old", 3, refreshed_at=T0), repo("c", "first", refreshed_at=T1),
    )
    want = maintenance.prune_stale_repos(maintenance.upsert_repos(target, incoming), listed)
    got = maintenance.replace_repos(target, incoming, listed)
    assert rows(got, *schema.REPO.names) == rows(want, *schema.REPO.names)
    assert ("a", "gone again") not in rows(got, "owner", "name")


def test_runs(make):
    log = make.frame("created_at timestamp")
    assert runs.last_run(log).first()[0] is None
    log = runs.append_run(runs.append_run(log, T2), T1)
    assert log.count() == 2
    assert runs.last_run(log).select(F.unix_timestamp("created_at")).first()[0] == T2.timestamp()


def test_moderation(make):
    users = make.users({"login": "bob"}, {"login": "alice", "hide": True}, {"login": "eve"})
    asked = make.frame(
        "login string, hide boolean, arrival int",
        ("bob", False, 1), ("bob", True, 2), ("alice", False, 1), ("nobody", True, 1), ("Bob", True, 5),
    )
    hidden = moderation.hide_users(users, asked)
    assert rows(hidden.users, "login", "hide") == [("alice", False), ("bob", True), ("eve", False)]
    assert rows(hidden.rejects, "login", "reason") == [
        ("Bob", "affected no users"), ("nobody", "affected no users"),
    ]
    repos = make.repos(repo("bob", "r"), repo("eve", "r"), repo("ghost", "r"))
    left = moderation.delete_users(users, repos, make.frame("login string", ("bob",), ("ghost",), ("x",)))
    assert rows(left.users, "login") == [("alice",), ("eve",)]
    assert rows(left.repos, "owner") == [("eve",)]


@pytest.mark.parametrize(
    ("actor", "admin", "action", "target", "allowed"),
    [
        ("bob", False, "hide", "bob", True),
        ("bob", False, "hide", "alice", False),
        ("bob", True, "hide", "alice", True),
        ("bob", False, "delete", "bob", False),
        ("bob", True, "delete", "alice", True),
        ("bob", True, "rename", "alice", False),
        ("stranger", True, "delete", "alice", False),
        ("stranger", True, "hide", "stranger", True),
        ("bob", False, "hide", "Bob", False),
    ],
)
def test_authorization(make, actor, admin, action, target, allowed):
    users = make.users({"login": "bob", "is_admin": admin}, {"login": "alice"})
    asked = make.frame("actor string, action string, target string", (actor, action, target))
    decided = moderation.authorize(asked, users)
    assert (decided.allowed.count(), decided.denied.count()) == ((1, 0) if allowed else (0, 1))


def test_candidates(make, spark, tmp_path):
    def person(login, created, **more):
        base = {"login": login, "type": "User", "location": "St. Louis", "public_repos": 5}
        return base | {"created_at": at(created)} | more

    profiles = make.users(
        person("early", "2012-12-31T23:59:59"),
        person("edge", "2014-01-01T10:00:00", location="STL area"),
        person("late", "2025-01-02"),
        person("last day", "2025-01-01", location="saint louis, MO"),
        person("first day", "2013-01-01T00:00:00", location="ST LOUIS"),
        person("one repo", "2015-05-05", public_repos=1),
        person("firm", "2015-05-05", type="Organization"),
        person("far", "2015-05-05", location="Chicago"),
        person("nowhere", "2015-05-05", location=None),
    )
    (tmp_path / "seeds.txt").write_text("acme\nedge\nAcme\n\n")
    seeds = read_seeds(spark, str(tmp_path / "seeds.txt"))
    found = {"early", "edge", "late", "last day", "first day"}
    assert set(column(candidates.candidate_logins(profiles, seeds), "login")) == found | {"acme", "Acme"}
    assert candidates.candidate_logins(profiles, seeds).count() == 7
    counts = {r.window: (r.candidates, r.near_ceiling) for r in
              candidates.candidate_window_counts(profiles, cap=1).collect()}
    assert counts == {
        "<2013-01-01": (1, False),
        "2013-01-01..2014-01-01": (2, True),
        "2014-01-01..2015-01-01": (1, False),
        "2024-01-01..2025-01-01": (1, False),
        ">2025-01-01": (1, False),
    }
    assert len(candidates.yearly_windows()) == 14


def test_payloads(spark, tmp_path):
    lines = [
        json.dumps({"login": "a", "followers": 3, "created_at": "2020-01-02T03:04:05Z", "hide": True,
                    "is_admin": True, "extra": [1]}),
        json.dumps({"login": "b", "company": "Acme", "disk_usage": 2**31 + 5, "hireable": None}),
        json.dumps({"login": "", "followers": 1}),
        json.dumps({"followers": 1}),
        json.dumps({"login": "c", "followers": "many"}),
        '{"login": "d", "follow',
    ]
    (tmp_path / "u.json").write_text("\n".join(lines) + "\n")
    raw = payload.read_payload(spark, str(tmp_path / "u.json"), payload.USER_PAYLOAD)
    got = payload.normalize_users(raw, T1)
    a, b = got.rows.orderBy("login").collect()
    assert (a.followers, a.company, a.email, a.hide, a.is_admin) == (3, "", None, False, False)
    assert (b.company, b.disk_usage, b.hireable) == ("Acme", -(2**31) + 5, None)
    assert got.rows.select(F.unix_timestamp("created_at"), F.unix_timestamp("refreshed_at")).first() == (
        int(at("2020-01-02T03:04:05").timestamp()), int(T1.timestamp()),
    )
    assert sorted(column(got.rejects, "reason")) == [
        "malformed payload", "malformed payload", "user missing login", "user missing login",
    ]


def test_repo_payloads_and_arrival(spark, tmp_path):
    good = [{"owner": {"login": "a"}, "name": "r", "stargazers_count": n} for n in range(50)]
    bad = [{"owner": {"login": ""}, "name": "r"}, {"name": "r"}, {"owner": {"login": "a"}}]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(x) for x in [*good, *bad]))
    raw = payload.read_payload(spark, str(tmp_path), payload.REPO_PAYLOAD)
    got = payload.normalize_repos(raw, T1)
    assert column(maintenance.last_arrival(got.rows, schema.REPO_KEY), "stargazers_count") == [49]
    assert sorted(column(got.rejects, "reason")) == [
        "repo missing name", "repo missing owner", "repo missing owner",
    ]


def test_evolve_is_repeatable(make):
    older = make.users({"login": "a", "company": "Acme"}).select("login", "company", "followers")
    once = schema.evolve(older, schema.USER)
    row = once.first()
    assert once.columns == schema.USER.names
    assert (row.hide, row.is_admin, row.company, row.type) == (False, False, "Acme", None)
    assert schema.evolve(once, schema.USER).collect() == [row]


def test_key_checks(make):
    users = make.users(
        {"login": "a"}, {"login": "a"}, {"login": "a"}, {"login": None}, {"login": "b", "hide": None},
        {"login": "c", "company": None}, {"login": "x" * 256}, {"login": "y" * 255, "name": "n" * 300},
    )
    got = {(r.rule, r.column): r.rows for r in schema.user_violations(users).collect()}
    assert got == {
        ("duplicate_key", "login"): 3, ("null_key", "login"): 1, ("null_required", "hide"): 1,
        ("null_required", "company"): 1, ("too_long", "login"): 1, ("too_long", "name"): 1,
    }
    assert schema.repo_violations(make.repos(repo("a", "x"), repo("b", "x"))).isEmpty()


def test_windows_are_cut_until_they_show_all(make):
    day = lambda n: at(f"2020-01-{n:02d}")
    people = [(f"u{i}", day(1 + i % 5)) for i in range(20)] + [(f"v{i}", day(20)) for i in range(9)]
    profiles = make.users(
        *[
            {"login": name, "created_at": when, "type": "User", "public_repos": 2, "location": "STL"}
            for name, when in [*people, people[0], ("w", None)]
        ]
    )
    windows = [
        candidates.CreationWindow("month", date(2020, 1, 1), date(2020, 1, 31)),
        candidates.CreationWindow("gap", date(2020, 1, 6), date(2020, 1, 19)),
        candidates.CreationWindow("before", None, date(2020, 1, 3)),
        candidates.CreationWindow("after", date(2020, 1, 4), None),
    ]
    rows = candidates.candidate_split_windows(profiles, windows=windows, cap=8).collect()
    assert {r.window for r in rows} == {"month", "before", "after"}
    assert [r.candidates for r in rows if r.window == "month"] == [8, 8, 4, 9]
    assert [(r.first, r.last, r.near_ceiling) for r in rows if r.candidates == 9 and r.window == "month"] == [
        ("2020-01-20", "2020-01-20", True)
    ]
    assert [(r.first, r.last, r.candidates) for r in rows if r.window == "before"] == [("2020-01-01", "2020-01-02", 8)]
    assert sum(r.candidates for r in rows if r.window == "after") == 13
    assert candidates.candidate_split_windows(profiles.limit(0), windows=windows).isEmpty()
