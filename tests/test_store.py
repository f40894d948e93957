from __future__ import annotations

import glob
import json
import random

import pytest

from forgeboard.operators import developers
from forgeboard.plans.listings import get_nested_profile, get_profile
from forgeboard.plans.moderate import moderate
from forgeboard.plans.refresh import land, refresh, run
from forgeboard.session import shared_dir, together
from forgeboard.sources.payload import ENVELOPE, read_items
from forgeboard.sources.schema import REPO, USER, repo_violations, user_violations
from forgeboard.sources.snapshots import InvalidSnapshot, Snapshot, SnapshotStore
from forgeboard.streaming.landing import stream_refresh
from tests.conftest import at, column, repo

T0, T1, T2 = at("2024-01-01"), at("2024-02-01"), at("2024-03-01")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def line(kind, login, when=T1, ok=True, body=None):
    return json.dumps({
        "kind": kind, "login": login, "fetched_at": when.isoformat(), "ok": ok,
        "body": None if body is None else json.dumps(body),
    })


def profile(login, when=T1, ok=True, **body):
    return line("profile", login, when, ok, {"login": login} | body)


def listed(login, *names, when=T1, ok=True, stars=1):
    sent = [
        line("repo", login, when, True, {"owner": {"login": login}, "name": n, "stargazers_count": stars})
        for n in names
    ]
    return [*sent, line("listing", login, when, ok)]


@pytest.fixture
def store(spark, make):
    store = SnapshotStore(spark, shared_dir(spark, "store"), parts=8)
    users = make.users(*[
        {"login": l, "hide": l == "hidden", "refreshed_at": T0}
        for l in ("full", "empty", "broken", "failed", "hidden", "absent")
    ])
    repos = make.repos(*[
        repo(o, n, 10, refreshed_at=T0)
        for o in ("full", "empty", "broken", "failed", "hidden", "absent") for n in ("x", "y")
    ])
    store.publish(Snapshot(users, repos))
    return store


LINES = [
    profile("full", followers=5), *listed("full", "x", "z"),
    profile("empty"), *listed("empty"),
    profile("broken"), *listed("broken", "x", ok=False),
    profile("failed", ok=False), *listed("failed", "x"),
    profile("hidden"), *listed("hidden", "x", "y"),
    profile("fresh"), *listed("fresh", "one"),
    "not json", line("surprise", "full"),
]
AFTER = sorted([
    ("full", "x", 1), ("full", "z", 1),
    ("broken", "x", 1), ("broken", "y", 10),
    ("failed", "x", 10), ("failed", "y", 10),
    ("hidden", "x", 1), ("hidden", "y", 1),
    ("absent", "x", 10), ("absent", "y", 10),
    ("fresh", "one", 1),
], key=str)


def landing(tmp_path, lines=LINES, name="items.json"):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_refresh_rules(spark, store, tmp_path):
    items = read_items(spark, landing(tmp_path))
    assert run(store, items, T1) == 2
    after = store.read()
    assert rows(after.repos, "owner", "name", "stargazers_count") == AFTER
    users = {r.login: r for r in after.users.collect()}
    assert users["full"].followers == 5
    assert users["hidden"].hide and not users["fresh"].hide
    assert rows(after.totals, "owner", "stars")[0] == ("absent", 20)
    assert set(column(spark.read.parquet(f"{store.root}/rejects"), "reason")) == {"unknown item", "profile not fetched"}
    assert store.runs().count() == 1
    # The first version is still there.
    assert store.read(1).repos.count() == 12
    # The pure form gives the same tables.
    pure = refresh(store.read(1), land(items))
    assert user_violations(after.users).isEmpty() and repo_violations(after.repos).isEmpty()
    assert rows(pure.repos, *REPO.names) == rows(after.repos, *REPO.names)
    assert rows(pure.users, *USER.names) == rows(after.users, *USER.names)
    # The same items once more change nothing.
    assert run(store, items, T2) == 3
    assert rows(store.read().repos, *REPO.names) == rows(after.repos, *REPO.names)
    assert rows(store.read().users, *USER.names) == rows(after.users, *USER.names)


def test_a_value_too_long_spoils_its_listing(spark, store, tmp_path):
    lines = [
        profile("full", name="n" * 256), *listed("full", "x"),
        profile("hidden"), *listed("hidden", "x", "n" * 256),
    ]
    run(store, read_items(spark, landing(tmp_path, lines)), T1)
    got = rows(store.read().repos, "owner", "name", "stargazers_count")
    assert {("full", "x", 10), ("full", "y", 10), ("hidden", "x", 1), ("hidden", "y", 10)} <= set(got)
    assert column(spark.read.parquet(f"{store.root}/rejects"), "reason") == ["value too long"] * 2


def test_only_candidates_are_visited(spark, store, make, tmp_path):
    items = read_items(spark, landing(tmp_path))
    run(store, items, T1, candidates=make.frame("login string", ("full",)))
    got = rows(store.read().repos, "owner", "name", "stargazers_count")
    assert ("full", "z", 1) in got and ("empty", "x", 10) in got and ("hidden", "x", 10) in got


def test_accounts_are_known_by_the_name_visited(spark, store, tmp_path):
    # Visited as FULL, stored as full: upserts go by the payload, pruning by the name visited.
    lines = [
        line("profile", "FULL", body={"login": "full", "followers": 8}),
        line("repo", "FULL", body={"owner": {"login": "full"}, "name": "x", "stargazers_count": 3}),
        line("listing", "FULL"),
    ]
    run(store, read_items(spark, landing(tmp_path, lines)), T1)
    got = rows(store.read(owner="full").repos.filter("owner = 'full'"), "name", "stargazers_count")
    assert got == [("x", 3), ("y", 10)]


def test_untouched_parts_carry_over(spark, store, tmp_path):
    _, before = store._layout(1)
    items = read_items(spark, landing(tmp_path, [profile("full"), *listed("full", "x")]))
    run(store, items, T1)
    _, after = store._layout(2)
    changed = {p for p in before["repos"] if before["repos"][p] != after["repos"].get(p)}
    assert len(changed) == 1
    assert store.read().users.count() == 6


def test_a_part_may_run_empty(spark, make):
    store = SnapshotStore(spark, shared_dir(spark, "store"), parts=4)
    store.publish(Snapshot(make.users({"login": "a"}, {"login": "b"}), make.repos(repo("a", "x"))))
    store.publish(Snapshot(make.users({"login": "b"}), make.repos()))
    assert column(store.read().users, "login") == ["b"]
    assert store.read().repos.columns == REPO.names and store.read().repos.isEmpty()
    assert store.read(1).repos.count() == 1


def test_nothing_stored_yet(spark):
    store = SnapshotStore(spark, shared_dir(spark, "store"))
    assert store.latest() is None and store.read().users.isEmpty() and store.runs().isEmpty()


def test_broken_keys_are_not_published(spark, store, make):
    twice = make.users({"login": "a"}, {"login": "a"})
    with pytest.raises(InvalidSnapshot, match="duplicate_key"):
        store.publish(Snapshot(twice, make.repos()))
    with pytest.raises(InvalidSnapshot, match="null_required"):
        store.publish(Snapshot(make.users({"login": "a", "hide": None}), make.repos()))
    assert store.latest() == 1 and store.read().users.count() == 6


def test_lookup_reads_one_part(store):
    snapshot = store.read(owner="FULL")
    assert len({f.split("/part=")[1].split("/")[0] for f in snapshot.repos.inputFiles()}) == 1
    assert column(developers.repos_for_user(snapshot.repos, "FULL"), "name") == ["x", "y"]
    row = developers.get_user(snapshot.users, snapshot.repos, "full", snapshot.totals).first()
    assert row.stars == 20


def test_stream_equals_one_run(spark, store, tmp_path):
    place = tmp_path / "landing"
    place.mkdir()
    first = [profile("full", followers=5), *listed("full", "x", "z"), profile("empty"), *listed("empty")]
    landing(place, first, "1.json")
    landing(place, [l for l in LINES if l not in first], "2.json")
    checkpoint = shared_dir(spark, "stream")
    stream_refresh(store, str(place), checkpoint, files_per_batch=1).awaitTermination()
    assert store.latest() == 3
    assert rows(store.read().repos, "owner", "name", "stargazers_count") == AFTER
    # Started again with nothing new, it publishes nothing.
    stream_refresh(store, str(place), checkpoint, files_per_batch=1).awaitTermination()
    assert store.latest() == 3
    # A lost checkpoint replays both batches, which the store knows by their files.
    stream_refresh(store, str(place), shared_dir(spark, "stream"), files_per_batch=1).awaitTermination()
    assert store.latest() == 3
    # A fresh checkpoint over another folder starts at batch 0 again and is taken in.
    other = tmp_path / "other"
    other.mkdir()
    landing(other, [profile("full", followers=77)], "1.json")
    stream_refresh(store, str(other), shared_dir(spark, "stream")).awaitTermination()
    assert store.latest() == 4
    assert store.read().users.filter("login = 'full'").first().followers == 77


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_over_split_accounts_equals_one_run(spark, store, make, tmp_path, seed):
    rng = random.Random(seed)
    whole, split = tmp_path / "whole", tmp_path / "split"
    whole.mkdir(), split.mkdir()
    alone = type(store)(spark, shared_dir(spark, "alone"), parts=3)
    alone.publish(Snapshot(store.read().users, store.read().repos))
    run(alone, read_items(spark, landing(whole)), T1, hold=True)
    dealt = {n: [] for n in range(4)}
    for text in LINES:
        dealt[rng.randrange(4)].append(text)
    for n, lines in dealt.items():
        landing(split, lines, f"{n}.json")
    stream_refresh(store, str(split), shared_dir(spark, "stream"), files_per_batch=1).awaitTermination()
    assert rows(store.read().repos, *REPO.names) == rows(alone.read().repos, *REPO.names) != []
    assert rows(store.read().users, *USER.names) == rows(alone.read().users, *USER.names)
    assert set(rows(store.rejects(), "kind", "owner", "reason")) == set(rows(alone.rejects(), "kind", "owner", "reason"))
    assert store.pending(ENVELOPE).isEmpty()


def test_lines_wait_for_their_profile(spark, store, tmp_path):
    def batch(n, *lines):
        folder = tmp_path / str(n)
        folder.mkdir()
        run(store, read_items(spark, landing(folder, lines)), T1, hold=True)

    batch(1, *listed("fresh", "one"), *listed("full", "x"), *listed("late", "a"))
    assert {r.login for r in store.pending(ENVELOPE).collect()} == {"fresh", "full", "late"}
    assert store.rejects().isEmpty() and ("full", "y") in rows(store.read().repos, "owner", "name")
    batch(2, profile("fresh"), profile("full", ok=False))
    assert rows(store.read().repos.filter("owner = 'fresh'"), "name", "stargazers_count") == [("one", 1)]
    assert {r.login for r in store.pending(ENVELOPE).collect()} == {"late"}
    assert rows(store.rejects(), "kind", "owner", "reason") == [("account", "full", "profile not fetched")]
    # More of the same visits: what came of the profile holds for them too.
    batch(3, line("repo", "fresh", body={"owner": {"login": "fresh"}, "name": "two"}), *listed("full", "z"))
    assert rows(store.read().repos.filter("owner = 'fresh'"), "name") == [("one",), ("two",)]
    assert ("full", "z") not in rows(store.read().repos, "owner", "name")
    # A run that does not hold leaves a reject, and what waited goes on waiting.
    folder = tmp_path / "4"
    folder.mkdir()
    run(store, read_items(spark, landing(folder, listed("nobody", "x"))), T2)
    assert ("account", "nobody", "no profile") in rows(store.rejects(), "kind", "owner", "reason")
    assert {r.login for r in store.pending(ENVELOPE).collect()} == {"late"}


def test_lines_are_parsed_once(spark, store, tmp_path):
    landed = land(read_items(spark, landing(tmp_path)))
    for df in (landed.users, landed.repos, landed.listed, landed.rejects):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan json" not in plan and "FileScan parquet" in plan


def test_a_row_that_cannot_be_read_prunes_nothing(spark, store, tmp_path):
    lines = [profile("full"), *listed("full", "x")]
    cut_off = json.loads(line("repo", "full", body={})) | {"body": '{"name": "y", "owner": {"log'}
    lines.insert(1, json.dumps(cut_off))
    before = rows(store.read().repos.filter("owner = 'full'"), "name")
    run(store, read_items(spark, landing(tmp_path, lines)), T1)
    assert rows(store.read().repos.filter("owner = 'full'"), "name") == before
    assert column(store.rejects(), "reason") == ["malformed payload"]


def test_rejects_of_a_run_that_failed_do_not_count(spark, store):
    found = spark.createDataFrame([("repo", "o", "n", "why")], "kind string, owner string, name string, reason string")
    store.keep(store.new_write(), "rejects", found)
    assert store.rejects().isEmpty()


def test_second_writer_of_a_version_fails(spark, store, make):
    version = store.latest()
    again = type(store)(spark, store.root)
    again.latest = lambda: version
    store.publish(Snapshot(make.users({"login": "a"}), make.repos()))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        again.publish(Snapshot(make.users({"login": "b"}), make.repos()))


def test_later_line_wins_within_a_file(spark, store, tmp_path):
    lines = [profile("full", followers=n) for n in range(30)]
    run(store, read_items(spark, landing(tmp_path, lines)), T1)
    assert store.read().users.filter("login = 'full'").first().followers == 29


def test_envelope_schema():
    assert ENVELOPE.names == ["kind", "login", "fetched_at", "ok", "body"]


def test_moderation_in_order_of_arrival(store, make):
    asked = make.frame(
        "actor string, action string, target string, hide boolean, arrival int",
        ("chief", "hide", "full", True, 1),
        ("chief", "delete", "full", None, 2),
        ("chief", "hide", "full", False, 3),
        ("chief", "delete", "full", None, 4),
        ("chief", "delete", "empty", None, None),
        ("chief", "hide", "empty", True, 1),
        ("chief", "hide", "hidden", False, None),
        ("chief", "hide", "hidden", True, 9),
        ("chief", "delete", "broken", None, 5),
        ("chief", "hide", "broken", True, 5),
        ("broken", "hide", "broken", None, 6),
    )
    before = store.read()
    store.publish(Snapshot(before.users.union(make.users({"login": "chief", "is_admin": True})), before.repos))
    version, rejects = moderate(store, asked)
    after = store.read(version)
    assert not {"full", "empty", "broken"} & set(column(after.users, "login"))
    assert ("hidden", True) in rows(after.users, "login", "hide")
    assert rows(rejects, "actor", "target", "hide", "arrival", "reason") == sorted([
        ("broken", "broken", None, 6, "affected no users"),
        ("chief", "broken", True, 5, "affected no users"),
        ("chief", "empty", True, 1, "affected no users"),
        ("chief", "full", False, 3, "affected no users"),
    ], key=str)


def test_moderation_of_stored_tables(store, make):
    asked = make.frame(
        "actor string, action string, target string, hide boolean, arrival int",
        ("full", "hide", "full", True, 1),
        ("full", "hide", "empty", True, 2),
        ("full", "delete", "full", None, 3),
        ("chief", "hide", "hidden", False, 4),
        ("chief", "hide", "nobody", True, 5),
        ("chief", "delete", "absent", None, 6),
        ("chief", "delete", "nobody", None, 7),
        ("chief", "hide", "broken", None, 8),
    )
    before = store.read()
    users = before.users.union(make.users({"login": "chief", "is_admin": True}))
    store.publish(Snapshot(users, before.repos))
    version, rejects = moderate(store, asked)
    after = store.read(version)
    assert rows(after.users.filter("hide"), "login") == [("full",)]
    assert "absent" not in column(after.users, "login")
    assert after.repos.filter("owner = 'absent'").isEmpty() and after.repos.count() == 10
    assert rows(rejects, "actor", "target", "reason") == [
        ("chief", "broken", "hide is required"),
        ("chief", "nobody", "affected no users"),
        ("full", "empty", "Users can only modify themselves"),
        ("full", "full", "Only admins can delete users"),
    ]


def test_profiles_come_from_one_part(spark, make):
    store = SnapshotStore(spark, shared_dir(spark, "profiles"), parts=4)
    users = make.users(*[{"login": f"o{i}", "hide": False} for i in range(9)])
    rows = [repo("o3", "b", 2, "Go"), repo("O3", "a", 5, "Go"), repo("o4", "c", 1), repo("lost", "d", 1)]
    store.publish(Snapshot(users, make.repos(*rows)))
    parts, read = [], store._load
    store._load = lambda table, where: parts.append(len(where)) or read(table, where)
    held = get_profile(store, "o3")
    assert max(parts) == 1
    assert [(r.login, r.stars) for r in held.user.collect()] == [("o3", 2)]
    assert column(held.repos, "name") == ["a", "b"]
    nested = get_nested_profile(store, "o3").collect()
    assert [(r.language, [x.name for x in r.repos]) for r in nested] == [("Go", ["a", "b"])]
    # No profile, no repositories: neither without a row nor in another case.
    for login in ("lost", "O3", "nobody"):
        assert get_profile(store, login).user.count() == get_profile(store, login).repos.count() == 0
        assert get_nested_profile(store, login).count() == 0


def test_streamed_lines_are_staged_once(spark, store, tmp_path):
    """They are numbered and laid out by kind in one write, not copied again for each batch."""
    (tmp_path / "in").mkdir()
    landing(tmp_path / "in", [profile("full"), *listed("full", "x")], "1.json")
    stream_refresh(store, str(tmp_path / "in"), shared_dir(spark, "stream")).awaitTermination()
    staged = glob.glob(f"{store.root}/staging/*/*")
    assert staged and not [s for s in staged if s.endswith("/items")]
    assert store.read().repos.filter("owner = 'full' AND name = 'x'").count() == 1


def test_steps_run_together_all_end_before_a_failure_shows():
    done = []
    with pytest.raises(ZeroDivisionError):
        together(lambda: 1 // 0, lambda: done.append(1))
    assert done == [1] and together(lambda: 1, lambda: 2) == [1, 2]
