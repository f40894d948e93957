"""Language popularity and the leaderboard of one language."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgeboard.functions.defaults import defaulted
from forgeboard.functions.params import page_bounds
from forgeboard.functions.text import collated, same_folded
from forgeboard.operators.paging import FEW, board_key, slice_of
from forgeboard.session import shared_dir, stage_in
from forgeboard.sources.schema import REPO

BOARD_REPO_COLUMNS = [
    "name", "description", "forks_count", "stargazers_count", "watchers_count", "fork",
]


def popular_languages(repos: DataFrame, limit: int = 50) -> DataFrame:
    """Languages of non-fork repositories by number of repositories.

    Counted in two steps, per ``(language, owner)`` and then per language, so
    neither a dominant language nor a dominant owner ends up as one group of
    raw rows.
    """
    return most_popular(language_counts(repos), limit)


def language_counts(repos: DataFrame, *by: str) -> DataFrame:
    """``language, count, users`` of non-fork repositories, apart for each value of ``by``.

    Where an owner meets one value of ``by`` only, as with the parts of a
    snapshot, the counts of all values add up to those of the whole, owners
    included.
    """
    return (
        repos.filter(F.col("language").isNotNull() & (F.col("fork") == F.lit(False)))
        .groupBy(*by, "language", "owner")
        .agg(F.count("*").alias("owned"))
        .groupBy(*by, "language")
        .agg(F.sum("owned").alias("count"), F.count("owner").alias("users"))
    )


def most_popular(counts: DataFrame, limit: int = 50) -> DataFrame:
    """The languages of most repositories."""
    return counts.orderBy(F.desc("count"), F.asc("language")).limit(limit)


def leaders(repos: DataFrame, users: DataFrame, k: int = 3) -> DataFrame:
    """Every owner's ``k`` most starred repositories per language, unordered.

    The total comes from an aggregate and the ranking from a window, never
    from one window that would need all rows of an owner in one task: the
    aggregate adds up before its shuffle, and the ``rownum <= k`` test lets
    each scan task pass on at most ``k`` rows per owner and language. Both
    sides are partitioned alike, so joining them moves nothing again.
    """
    known = repos.filter(F.col("language").isNotNull()).withColumn("lang_key", F.lower("language"))
    totals = known.groupBy("lang_key", "owner").agg(F.sum("stargazers_count").alias("total_stars"))
    best_first = Window.partitionBy("lang_key", "owner").orderBy(
        F.desc_nulls_first("stargazers_count"), F.asc("name")
    )
    ranked = (
        known.select("lang_key", "owner", *BOARD_REPO_COLUMNS)
        .withColumn("rownum", F.row_number().over(best_first).cast("bigint"))
        .filter(F.col("rownum") <= k)
    )
    people = users.selectExpr(
        "login AS owner", "coalesce(name, '') AS display_name", "coalesce(type, '') AS type"
    )
    return (
        ranked.join(totals, ["lang_key", "owner"])
        .join(people, "owner")
        .selectExpr(
            "lang_key",
            "owner",
            *defaulted(REPO, BOARD_REPO_COLUMNS, raw=["name"]),
            "total_stars",
            "rownum",
            "display_name",
            "type",
        )
    )


def leaders_of(repos: DataFrame, users: DataFrame, lang: str, k: int = 3) -> DataFrame:
    """Leaders of one language, matched without case, unordered."""
    return leaders(repos.filter(same_folded(F.col("language"), lang)), users, k).drop("lang_key")


def language_leaders(
    repos: DataFrame, users: DataFrame, lang: str, k: int = 3, collation: str | None = None
) -> DataFrame:
    """Leaders of one language, best total first.

    Owners of equal total follow in binary order, or in that of a
    ``collation`` such as ``UNICODE``.
    """
    return leaders_of(repos, users, lang, k).orderBy(
        F.desc_nulls_first("total_stars"),
        F.asc(collated("owner", collation)),
        F.asc("owner"),
        F.asc("rownum"),
    )


def by_owner(board: DataFrame, *keys: str) -> DataFrame:
    """Fold leaderboard rows into one row per owner with its repositories.

    A group holds at most ``k`` rows. The nested rows keep the leaderboard's
    columns and order.
    """
    row = F.struct("rownum", *[c for c in board.columns if c not in ("rownum", *keys)])
    return (
        board.groupBy(*keys, "owner", "total_stars", "display_name", "type")
        .agg(F.array_sort(F.collect_list(row)).alias("repos"))
        .select(
            *keys,
            "owner",
            "repos",
            F.col("total_stars").alias("count"),
            F.col("display_name").alias("name"),
            "type",
        )
    )


class LanguagePage(NamedTuple):
    """One page of owners, the number of owners in all, and the language asked for."""

    languages: DataFrame
    count: DataFrame
    language: str


def language_page(
    repos: DataFrame,
    users: DataFrame,
    lang: str,
    limit: int | None = None,
    offset: int | None = None,
    few: int = FEW,
) -> LanguagePage:
    """A page of the leaderboard computed on the spot.

    Owners and totals alone are written, once, and serve the count and the
    search for where the page begins; nothing sorts all owners. Repositories
    are ranked only for the owners shown, at most a page of them, whose names
    reach the scans as a filter. Many pages of one table are better served
    from a stored leaderboard (``plans.leaderboards``).
    """
    limit, offset = page_bounds(limit, offset)
    stage = stage_in(shared_dir(repos.sparkSession, "page"))
    owners = stage(
        "owners",
        _owners_of(repos, users, lang).withColumn("key", board_key(F.col("total_stars"), F.col("owner"))),
    )
    shown = [row["owner"] for row in slice_of(owners, "key", limit, offset, few).collect()]
    board = leaders_of(
        repos.filter(F.col("owner").isin(shown)), users.filter(F.col("login").isin(shown)), lang
    )
    page = by_owner(board).orderBy(F.desc_nulls_first("count"), F.asc("owner")).limit(limit)
    return LanguagePage(page, owners.agg(F.count("*").alias("count")), lang)


def _owners_of(repos: DataFrame, users: DataFrame, lang: str) -> DataFrame:
    """Owners with a profile that have a repository in ``lang``, with their total."""
    totals = (
        repos.filter(same_folded(F.col("language"), lang))
        .groupBy("owner")
        .agg(F.sum("stargazers_count").alias("total_stars"))
    )
    return totals.join(users.select(F.col("login").alias("owner")), "owner", "left_semi")


def owner_count(repos: DataFrame, users: DataFrame, lang: str) -> DataFrame:
    """One row: how many owners with a profile have a repository in ``lang``."""
    return _owners_of(repos, users, lang).agg(F.count("*").alias("count"))
