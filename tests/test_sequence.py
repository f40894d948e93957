"""Refresh runs against the same runs done one account and one row at a time."""

from __future__ import annotations

import json
import random

import pytest

from forgeboard.plans.refresh import run
from forgeboard.session import shared_dir
from forgeboard.sources.payload import read_items
from forgeboard.sources.snapshots import Snapshot, SnapshotStore
from tests.conftest import at

LOGINS = [f"dev{i}" for i in range(12)] + ["Dev1", "DEV2"]
NAMES = [f"repo{i}" for i in range(6)]
COMPANIES = [None, "Acme", "x" * 300]


def visits(rng: random.Random, when: str) -> list[dict]:
    """What a collector would meet: failing profiles, broken and empty listings, bad rows, repeats."""
    out = []
    for login in rng.sample(LOGINS, 10):
        body = {"login": login if rng.random() > 0.1 else "", "followers": rng.randrange(99)}
        if rng.random() < 0.1:
            body["name"] = "n" * 256
        if rng.random() < 0.5:
            body["company"] = rng.choice(COMPANIES)
        rows = []
        for _ in range(rng.choice([0, 1, 4, 8])):
            row = {"owner": {"login": login}, "stargazers_count": rng.randrange(50)}
            if rng.random() > 0.1:
                row["name"] = rng.choice(NAMES)
            if rng.random() < 0.3:
                row["language"] = rng.choice(["Go", "C"])
            rows.append(row)
        out.append({
            "login": login, "when": when, "profile_ok": rng.random() > 0.1, "profile": body,
            "rows": rows, "listing_ok": rng.random() > 0.2,
        })
    return out


def apply_one_by_one(users: dict, repos: dict, seen: list[dict]) -> None:
    for visit in seen:
        body = visit["profile"]
        if not visit["profile_ok"] or not body["login"] or len(body.get("name") or "") > 255:
            continue
        flags = users.get(body["login"], {"hide": False})
        users[body["login"]] = {
            "followers": body["followers"], "company": body.get("company") or "",
            "name": body.get("name"), "hide": flags["hide"],
        }
        for row in visit["rows"]:
            if "name" in row:
                repos[row["owner"]["login"], row["name"]] = (
                    row["stargazers_count"], row.get("language"), visit["when"]
                )
        if visit["listing_ok"]:
            for key in [k for k, v in repos.items() if k[0] == visit["login"] and v[2] < visit["when"]]:
                del repos[key]


def lines(seen: list[dict]) -> str:
    out = []
    for visit in seen:
        head = {"login": visit["login"], "fetched_at": visit["when"] + "T00:00:00Z"}
        out.append(head | {"kind": "profile", "ok": visit["profile_ok"], "body": json.dumps(visit["profile"])})
        out += [head | {"kind": "repo", "ok": True, "body": json.dumps(r)} for r in visit["rows"]]
        out.append(head | {"kind": "listing", "ok": visit["listing_ok"]})
    return "\n".join(json.dumps(x) for x in out) + "\n"


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_single_steps(spark, make, tmp_path, seed):
    rng = random.Random(seed)
    store = SnapshotStore(spark, shared_dir(spark, "sequence"), parts=3)
    users = {login: {"followers": None, "company": "", "name": None, "hide": i % 3 == 0}
             for i, login in enumerate(LOGINS[:8])}
    repos = {(login, name): (1, None, "2020-01-01") for login in LOGINS[:8] for name in NAMES[:3]}
    store.publish(Snapshot(
        make.users(*[{"login": l} | u for l, u in users.items()]),
        make.repos(*[
            {"owner": o, "name": n, "stargazers_count": v[0], "refreshed_at": at(v[2])}
            for (o, n), v in repos.items()
        ]),
    ))
    for day in (1, 2, 3):
        seen = visits(rng, f"2021-01-0{day}")
        apply_one_by_one(users, repos, seen)
        folder = tmp_path / f"day{day}"
        folder.mkdir()
        (folder / "items.json").write_text(lines(seen))
        run(store, read_items(spark, str(folder)), at(f"2021-01-0{day}"))
        now = store.read()
        got_users = {
            r.login: {"followers": r.followers, "company": r.company, "name": r["name"], "hide": r.hide}
            for r in now.users.collect()
        }
        got_repos = {
            (r.owner, r["name"]): (r.stargazers_count, r.language, r.day)
            for r in now.repos.selectExpr("*", "date_format(refreshed_at, 'yyyy-MM-dd') AS day").collect()
        }
        assert got_users == users
        assert got_repos == repos
        totals = {}
        for (owner, _), (stars, *_) in repos.items():
            totals[owner] = totals.get(owner, 0) + stars
        assert {r.owner: r.stars for r in now.totals.collect()} == totals
