"""Substring search over profiles and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeboard.functions.defaults import defaulted
from forgeboard.functions.text import contains, contains_folded
from forgeboard.operators.developers import KNOWN_TOTALS, repo_listing
from forgeboard.operators.totals import owner_totals
from forgeboard.sources.schema import USER


def search_users(
    users: DataFrame,
    repos: DataFrame,
    term: str,
    limit: int = 50,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Logins holding ``term``, case and all, by stars. Hidden profiles are included."""
    totals = owner_totals(repos) if totals is None else totals
    shown = ["login", "name", "followers", "public_repos", "public_gists", "avatar_url", "type"]
    return (
        users.filter(contains(F.col("login"), term))
        .join(totals, F.col("owner") == F.col("login"), "left")
        .selectExpr(
            *defaulted(USER, shown, raw=["login"]), "hide", "is_admin", *KNOWN_TOTALS
        )
        .orderBy(F.desc("stars"), F.asc("login"))
        .limit(limit)
    )


def search_repos(repos: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """Repositories whose name or whole description holds ``term``, by stars.

    Filter and top-k run inside the scan tasks; nothing is shuffled.
    """
    hit = contains_folded(F.col("name"), term) | contains_folded(F.col("description"), term)
    return (
        repo_listing(repos.filter(hit))
        .orderBy(F.desc("stargazers_count"), F.asc("owner"), F.asc("name"))
        .limit(limit)
    )
