"""Ranked developers, single profiles and the repositories of an owner."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeboard.functions.defaults import defaulted
from forgeboard.functions.params import sort_key
from forgeboard.functions.text import collated, contains_folded, same_folded
from forgeboard.operators.totals import owner_totals
from forgeboard.session import shared_dir, stage_in
from forgeboard.sources.schema import REPO, USER

PROFILE_COLUMNS = [
    "login", "email", "name", "location", "hireable", "blog", "bio", "followers", "following",
    "public_repos", "public_gists", "avatar_url", "type", "disk_usage", "created_at",
    "updated_at", "company", "hide", "is_admin",
]
PROFILE_RAW = ["login", "company", "hide", "is_admin"]
# Totals of an owner that may have no repository. They stay 64 bits wide: one owner's sum can pass 32.
KNOWN_TOTALS = ["coalesce(stars, 0L) AS stars", "coalesce(forks, 0L) AS forks"]
# Repositories of a language on one page of a nested profile.
PAGE_ROWS = 1_000


def popular_devs(
    users: DataFrame,
    repos: DataFrame,
    dev_type: str,
    company: str | None = None,
    sort_by: str | None = "stars",
    limit: int = 100,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Visible profiles of one type that own repositories, best first.

    Ranks by the stored value of the chosen key, with unknown values first,
    and shows the defaulted one. ``totals`` may be the stored owner totals of
    a snapshot; without it they are added up here, before the join.
    """
    totals = owner_totals(repos) if totals is None else totals
    wanted = users.filter((F.col("type") == F.lit(dev_type or None)) & F.col("hide").eqNullSafe(False))
    if company:
        wanted = wanted.filter(contains_folded(F.col("company"), company))
    ranked = (
        wanted.select(
            "login", "name", "company", "avatar_url", "followers", "public_repos", "type"
        )
        .join(totals, F.col("owner") == F.col("login"))
        .orderBy(
            F.desc_nulls_first(sort_key(sort_by)), F.desc_nulls_first("stars"), F.asc("login")
        )
        .limit(limit)
    )
    shown = ["login", "name", "company", "avatar_url", "followers", "public_repos"]
    return ranked.selectExpr(
        *defaulted(USER, shown, raw=["login", "company"]),
        "stars",
        "forks",
        *defaulted(USER, ["type"]),
    )


def user_profiles(
    users: DataFrame, repos: DataFrame, totals: DataFrame | None = None
) -> DataFrame:
    """Every profile with its owner totals and read defaults.

    A filter on ``login`` put on this reaches both scans, so a lookup adds up
    only the one owner.
    """
    totals = owner_totals(repos) if totals is None else totals
    return users.join(totals, F.col("owner") == F.col("login"), "left").selectExpr(
        *defaulted(USER, PROFILE_COLUMNS, raw=PROFILE_RAW), *KNOWN_TOTALS
    )


def get_user(
    users: DataFrame, repos: DataFrame, login: str, totals: DataFrame | None = None
) -> DataFrame:
    """The profile of exactly ``login``, or no row."""
    return user_profiles(users, repos, totals).filter(F.col("login") == F.lit(login))


def repo_listing(repos: DataFrame) -> DataFrame:
    """Every repository with read defaults."""
    return repos.selectExpr(*defaulted(REPO, REPO.names, raw=["owner", "name"]))


def listing_order(collation: str | None = None) -> list[Column]:
    """Language, stars downwards, name; the owner parts names that differ only by owner case."""
    return [
        F.asc(collated("language", collation)),
        F.desc("stargazers_count"),
        F.asc(collated("name", collation)),
        F.asc("name"),
        F.asc("owner"),
    ]


def repos_for_user(repos: DataFrame, login: str, collation: str | None = None) -> DataFrame:
    """Repositories of an owner, matched without case.

    Sorted by the shown language and stars. The repository name in the sort
    key lets the range exchange split even one owner's one language.
    """
    return repo_listing(repos.filter(same_folded(F.col("owner"), login))).orderBy(
        *listing_order(collation)
    )


class Profile(NamedTuple):
    """A profile row (none when absent) and the owner's repositories."""

    user: DataFrame
    repos: DataFrame


def _repos_of_known(users: DataFrame, repos: DataFrame, login: str) -> DataFrame:
    """Repositories of ``login`` in any case, none unless the exact login has a profile."""
    known = users.filter(F.col("login") == F.lit(login)).select(F.lower("login").alias("_login"))
    return repo_listing(repos.filter(same_folded(F.col("owner"), login))).join(
        known.distinct(), F.lower("owner") == F.col("_login"), "left_semi"
    )


def profile(
    users: DataFrame, repos: DataFrame, login: str, totals: DataFrame | None = None
) -> Profile:
    """Profile by exact login, repositories by login without case.

    Without a profile row there are no repositories either. This flat form
    stays distributed whatever the owner holds.
    """
    return Profile(
        get_user(users, repos, login, totals),
        _repos_of_known(users, repos, login).orderBy(*listing_order()),
    )


def nested_profile(
    users: DataFrame,
    repos: DataFrame,
    login: str,
    totals: DataFrame | None = None,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """``(user, language, page, repos)``: a profile with its repositories by language.

    A page lists up to ``page_rows`` repositories of a language in listing
    order; the repository at position n of its language is on page
    n / ``page_rows``, whatever the owner holds. An owner without
    repositories has one row with an unknown language and an empty list, an
    unknown login none. The sorted listing is written to the shared folder,
    as positions need its chunks to stay as they are.
    """
    stage = stage_in(shared_dir(repos.sparkSession, "profile"))
    listed = _repos_of_known(users, repos, login)
    names = listed.columns
    chunks = stage(
        "chunks",
        listed.repartitionByRange(*listing_order()).withColumn("_chunk", F.spark_partition_id()),
    )
    # One row per chunk and language, so the running sum stays small.
    earlier = Window.partitionBy("language").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        chunks.groupBy("language", "_chunk")
        .agg(F.count("*").alias("_rows"))
        .select("language", "_chunk", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    in_chunk = Window.partitionBy("language", "_chunk").orderBy(*listing_order()[1:])
    placed = (
        chunks.withColumn("_n", F.row_number().over(in_chunk) - 1)
        .join(starts, ["language", "_chunk"])
        .withColumn("_position", F.col("_start") + F.col("_n"))
    )
    entry = F.struct("_position", *names)
    pages = (
        # Listed rows differ in the case of their owner at most.
        placed.groupBy(
            F.lower("owner").alias("_login"),
            "language",
            F.floor(F.col("_position") / page_rows).cast("int").alias("page"),
        )
        .agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
        .withColumn("repos", F.transform("_rows", lambda e: F.struct(*[e[c].alias(c) for c in names])))
    )
    # Staged, the profile is the side known to be small: pages meet it where they are.
    user = get_user(users, repos, login, totals)
    user = stage("user", user.select(F.struct(*user.columns).alias("user")))
    same = F.lower("user.login") == F.col("_login")
    held = chunks.select(F.lower("owner").alias("_login")).distinct()
    return (
        pages.join(user, same)
        .select("user", "language", "page", "repos")
        .unionByName(
            user.join(held, same, "left_anti").select(
                "user",
                F.lit(None).cast("string").alias("language"),
                F.lit(0).alias("page"),
                F.array().cast(pages.schema["repos"].dataType).alias("repos"),
            )
        )
    )
