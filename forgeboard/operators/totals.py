"""Stars and forks per owner, shared by the listing, lookup and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owner_totals(repos: DataFrame) -> DataFrame:
    """``(owner, stars, forks)``; a sum over nothing but NULLs stays NULL.

    Each scan task adds up its own rows first, so an owner of a third of all
    repositories crosses the shuffle as one row per task.
    """
    return repos.groupBy("owner").agg(
        F.sum("stargazers_count").alias("stars"), F.sum("forks_count").alias("forks")
    )
