"""The listing requests a caller makes, with their parameter rules."""

from __future__ import annotations

from pyspark.sql import DataFrame

from forgeboard.functions.params import ParameterError
from forgeboard.operators.developers import Profile, nested_profile, popular_devs, profile
from forgeboard.operators.search import search_repos, search_users
from forgeboard.sources.snapshots import Snapshot, SnapshotStore


def list_devs(
    snapshot: Snapshot,
    q: str | None = None,
    dev_type: str | None = None,
    company: str | None = None,
    sort: str | None = None,
) -> DataFrame:
    """Search by ``q`` or rank by ``dev_type``; exactly one of them must be given."""
    if bool(q) == bool(dev_type):
        raise ParameterError("provide either dev_type or q")
    if q:
        return search_users(snapshot.users, snapshot.repos, q, totals=snapshot.totals)
    return popular_devs(
        snapshot.users, snapshot.repos, dev_type, company, sort, totals=snapshot.totals
    )


def list_repos(snapshot: Snapshot, q: str) -> DataFrame:
    """Search repositories; a term is required."""
    if not q:
        raise ParameterError("q is required")
    return search_repos(snapshot.repos, q)


def get_profile(store: SnapshotStore, login: str, version: int | None = None) -> Profile:
    """A stored profile and its repositories, read from the one part that can hold them."""
    held = store.read(version, owner=login)
    return profile(held.users, held.repos, login, held.totals)


def get_nested_profile(store: SnapshotStore, login: str, version: int | None = None) -> DataFrame:
    """The same with the repositories listed by language, in pages."""
    held = store.read(version, owner=login)
    return nested_profile(held.users, held.repos, login, held.totals)
