"""One collection run over landed payloads."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeboard.operators.maintenance import replace_repos, upsert_users
from forgeboard.session import Stage, shared_dir, stage_in, together
from forgeboard.sources.payload import (
    ARRIVAL,
    ENDS_LISTING,
    VISITED,
    REPO_PAYLOAD,
    USER_PAYLOAD,
    judge_repos,
    judge_users,
    parse_body,
    split,
)
from forgeboard.sources.schema import REPO_KEY, USER_KEY
from forgeboard.sources.snapshots import Snapshot, SnapshotStore


@dataclass(frozen=True)
class Landed:
    """What a run brought in.

    ``users`` and ``repos`` are normalized rows of the accounts whose profile
    came through. ``listed`` holds ``(owner, started_at)`` for their listings
    that ended well, with or without repositories. ``through`` names the
    accounts whose lines count, as they were visited.
    """

    users: DataFrame
    repos: DataFrame
    listed: DataFrame
    rejects: DataFrame
    through: DataFrame


#: What callers look for in rejects of accounts that were passed over.
NOT_FETCHED, NO_PROFILE, NOT_WANTED = "profile not fetched", "no profile", "not a candidate"


def kind_of() -> Column:
    """The kind of a line, ``none`` for one that is not known."""
    return F.when(F.col("kind").isin("profile", "repo", "listing"), F.col("kind")).otherwise("none").alias("of")


def by_kind(items: DataFrame, stage: Stage) -> DataFrame:
    """The lines in a table with a folder for each kind, so that they are parsed once and read by kind."""
    if "of" in items.columns:
        return items
    return stage("items", items.select("*", kind_of()), "of")


def land(
    items: DataFrame,
    stage: Stage | None = None,
    candidates: DataFrame | None = None,
    followed: DataFrame | None = None,
) -> Landed:
    """Sort envelope rows into profiles, repositories and finished listings.

    An account whose profile failed is passed over with its repositories and
    its listing, under the name it was visited by, and leaves one reject. A
    listing that broke off still brings the rows it got, and a row that cannot
    be read or does not fit the table makes its listing one that broke off.
    With ``candidates`` only those logins are visited. ``followed`` names
    accounts whose profile came through earlier.

    The lines are read once, into a table by kind; whatever follows reads the
    rows of its kind there. Payloads are parsed once, and the few accounts to
    pass over have a known size, so leaving them out moves no repository. The
    finished listings, one row per owner, are staged as well; adaptive
    execution can only split a hot owner where both join sides come straight
    from a shuffle.
    """
    order = [ARRIVAL] if ARRIVAL in items.columns else []
    stage = stage or stage_in(shared_dir(items.sparkSession, "staging"))
    items = by_kind(items, stage)

    def bodies(kind: str) -> DataFrame:
        return items.filter(
            (F.col("of") == kind) & F.col("ok") & F.col("login").isNotNull()
        ).select(F.col("login").alias(VISITED), "fetched_at", "body", *order)

    profiles, judged = together(
        lambda: stage("users", judge_users(parse_body(bodies("profile"), USER_PAYLOAD), "fetched_at")),
        lambda: stage("repos", judge_repos(parse_body(bodies("repo"), REPO_PAYLOAD), "fetched_at")),
    )
    users, repos = split(profiles, USER_KEY), split(judged, REPO_KEY)
    listed = items.filter("of = 'listing' AND ok AND login IS NOT NULL").select(
        F.col("login").alias("owner"), F.col("fetched_at").alias("started_at")
    )

    good = users.rows
    if candidates is not None:
        good = good.join(candidates.select(F.col("login").alias(VISITED)), VISITED, "left_semi")
    through = good.select(VISITED)
    if followed is not None:
        through = through.union(followed.select("login"))
    through = stage("through", through.distinct())
    # One row for every account that was asked for and did not come through.
    profile = F.col("kind") == "profile"
    asked = items.filter("login IS NOT NULL AND of <> 'none'").groupBy(F.col("login").alias(VISITED)).agg(
        F.max(profile & ~F.coalesce("ok", F.lit(False))).alias("failed"), F.max(profile).alias("tried")
    )
    if candidates is None:
        asked = asked.withColumn("wanted", F.lit(True))
    else:
        wanted = candidates.select(F.col("login").alias(VISITED), F.lit(True).alias("wanted")).distinct()
        asked = asked.join(wanted, VISITED, "left")
    passed_over = stage("passed_over", asked.join(through, VISITED, "left_anti"))

    broke_off = judged.filter(F.col("reason").isin(*ENDS_LISTING)).select(VISITED)
    without_listing = passed_over.select(VISITED).union(broke_off).distinct()

    no_name = F.lit(None).cast("string").alias("name")
    unknown = items.filter("login IS NULL OR of = 'none'")
    # An account whose profile came but is of no use has the reject of that profile.
    accounts = passed_over.select(
        F.lit("account").alias("kind"),
        F.col(VISITED).alias("owner"),
        no_name,
        F.when(F.col("wanted").isNull(), NOT_WANTED).when(F.col("failed"), NOT_FETCHED).when(~F.col("tried"), NO_PROFILE).alias("reason"),
    ).filter("reason IS NOT NULL")
    rejects = (
        users.rejects.select(
            F.lit("profile").alias("kind"), F.col("login").alias("owner"), no_name, "reason"
        )
        .unionByName(repos.rejects.select(F.lit("repo").alias("kind"), "owner", "name", "reason"))
        .unionByName(
            unknown.select(
                "kind", F.col("login").alias("owner"), no_name, F.lit("unknown item").alias("reason")
            )
        )
        .unionByName(accounts)
    )
    return Landed(
        good.drop(VISITED),
        repos.rows.join(passed_over, VISITED, "left_anti").drop(VISITED),
        stage(
            "listed",
            listed.join(without_listing, F.col("owner") == F.col(VISITED), "left_anti")
            .groupBy("owner")
            .agg(F.max("started_at").alias("started_at")),
        ),
        rejects,
        through,
    )


class Settled(NamedTuple):
    """A batch of lines after looking at earlier ones.

    ``items`` can be decided now, ``held`` not before a profile comes.
    ``followed`` holds ``(login, profile_at, started)`` of the accounts whose
    profile came through in an earlier batch and whose lines go on in this one.
    """

    items: DataFrame
    held: DataFrame
    followed: DataFrame


def settle(items: DataFrame, pending: DataFrame, visits: DataFrame, stage: Stage, hold: bool) -> Settled:
    """Tell the lines whose account is known from those that wait for a profile.

    A line with a profile of its account beside it, be it a failed one, is
    decided now. Else it belongs to the visit whose listing began when its own
    did, or to one of which nothing but the profile has come. Lines of a visit
    whose profile failed are dropped, as the account is in the rejects. What
    is left waits, or counts as an account without profile if not ``hold``;
    what waited before goes on waiting.
    """
    # Both lie in files; what waited is not written again to be read by kind.
    waited = pending.drop("of").select("*", kind_of()).withColumn("waited", F.lit(True))
    lines = by_kind(items, stage).withColumn("waited", F.lit(False)).unionByName(waited, True)
    profiles = lines.filter("of = 'profile' AND login IS NOT NULL").select("login").distinct()
    loose = F.col("of").isin("repo", "listing") & F.col("login").isNotNull()
    undecided = stage(
        "undecided",
        lines.filter(loose).groupBy("login", F.col("fetched_at").alias("started")).agg(F.min("waited").alias("waited"))
        .join(profiles, "login", "left_anti"),
    )
    known = visits.join(undecided.select("login").distinct(), "login", "left_semi").groupBy("login", "profile_at").agg(
        F.max("came").alias("came"), F.max("started").alias("bound")
    )
    same = F.col("bound").eqNullSafe(F.col("started"))
    first = F.col("bound").isNull() & (F.col("profile_at") <= F.col("started"))
    decided = stage(
        "decided",
        undecided.join(known, "login").filter(same | first).groupBy("login", "started")
        .agg(F.max(F.struct(same.alias("same"), "profile_at", "came")).alias("visit"))
        .select("login", "started", "visit.profile_at", "visit.came"),
    )
    waiting = undecided.join(decided, ["login", "started"], "left_anti")
    waiting = stage("waiting", waiting if hold else waiting.filter("waited"))

    def those_of(found: DataFrame, how: str) -> DataFrame:
        keys = found.select(F.col("login").alias("_login"), F.col("started").alias("_started"))
        same_visit = (F.col("login") == F.col("_login")) & F.col("fetched_at").eqNullSafe(F.col("_started"))
        return lines.join(keys, loose & same_visit, how)

    away = waiting.select("login", "started").union(decided.filter("NOT came").select("login", "started"))
    held = those_of(waiting, "left_semi")
    return Settled(
        those_of(away, "left_anti").drop("waited"),
        (held if hold else held.filter("waited")).drop("waited", "of"),
        decided.filter("came").select("login", "profile_at", "started"),
    )


def _visits(items: DataFrame, landed: Landed, followed: DataFrame) -> DataFrame:
    """``login, profile_at, came, started`` of the visits that this batch saw begin or go on."""
    profile = F.col("of") == "profile"
    begun = (
        items.filter("login IS NOT NULL AND of <> 'none'")
        .groupBy("login")
        .agg(
            F.max(F.when(profile, F.col("fetched_at"))).alias("profile_at"),
            F.max(profile).alias("tried"),
            F.max(F.when(~profile, F.col("fetched_at"))).alias("started"),
        )
        .filter("tried")
        .join(landed.through.select(F.col(VISITED).alias("login"), F.lit(True).alias("came")), "login", "left")
        .select("login", "profile_at", F.coalesce("came", F.lit(False)).alias("came"), "started")
    )
    return begun.unionByName(followed.withColumn("came", F.lit(True)))


def refresh(snapshot: Snapshot, landed: Landed, stage: Stage | None = None) -> Snapshot:
    """The next snapshot: users upserted, their repositories upserted, then pruned."""
    return Snapshot(
        upsert_users(snapshot.users, landed.users),
        replace_repos(snapshot.repos, landed.repos, landed.listed, stage),
    )


def run(
    store: SnapshotStore,
    items: DataFrame,
    started_at: datetime,
    candidates: DataFrame | None = None,
    source: str | None = None,
    batch: int | None = None,
    files: DataFrame | None = None,
    hold: bool = False,
) -> int | None:
    """Log the run, refresh the parts the items touch, publish; returns the version.

    A batch already published under ``source`` is passed over, which makes a
    replay after a lost driver harmless. ``files`` are the landed files (path
    and modification time) that the items come from, recorded with the version.
    Lines that ``hold`` keeps for want of a profile are recorded with it too,
    and join the next run. All of these are written before the commit and
    count through it.
    """
    if source is not None and store.has_batch(source, batch):
        return None
    store.log_run(started_at)
    stage = store.staged(started_at)
    settled = settle(items, store.pending(items.schema), store.visits(), stage, hold)
    landed = land(settled.items, stage, candidates, settled.followed)
    owners = (
        landed.users.select(F.col("login").alias("owner"))
        .unionByName(landed.repos.select("owner"))
        .unionByName(landed.listed.select("owner"))
    )

    def refreshed() -> tuple[Snapshot, list[int]]:
        touched = store.touched_parts(owners)
        return refresh(store.read(parts=touched), landed, stage), touched

    write = store.new_write()
    beside = {
        "rejects": landed.rejects,
        "pending": settled.held,
        "visits": _visits(settled.items, landed, settled.followed),
    }
    if files is not None:
        beside["files"] = files
    (after, touched), *_ = together(
        refreshed, *[functools.partial(store.keep, write, name, rows) for name, rows in beside.items()]
    )
    # Rows kept come from a published version, and rows that arrived were
    # checked one by one and reduced to one per key.
    return store.publish(after, touched, source, batch, check=False, write=write)
