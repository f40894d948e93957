"""Keeping the tables current: latest-row selection, upserts and pruning.

Each step is a function from the present table and the changes to the next
table. None of them writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgeboard.session import Stage
from forgeboard.sources.schema import MODERATION_FLAGS, REPO, REPO_KEY, USER, USER_KEY

ARRIVAL = "arrival"


def last_arrival(df: DataFrame, key: list[str]) -> DataFrame:
    """The last row per key, by arrival and then refresh time.

    Testing for the first row number lets every input task drop all but one
    row of a key before the shuffle, however often the key was copied.
    Rows that tie are told apart by a hash of their content, so reruns agree.
    """
    timed = [c for c in (ARRIVAL, "refreshed_at") if c in df.columns]
    content = F.xxhash64(*[c for c in df.columns if c not in timed])
    order = [*[F.desc_nulls_last(c) for c in timed], F.desc(content)]
    return (
        df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
        .filter("_n = 1")
        .drop("_n", ARRIVAL)
    )


def _without(target: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``target`` whose key is not among ``keys``.

    Only the key columns of the changes are read and moved. When their size
    is known to be small they are broadcast and the target stays in place;
    else both sides meet on the full key, which no hot owner can skew.
    """
    return target.join(keys.select(*key).distinct(), key, "left_anti").select(*target.columns)


def upsert_users(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Update by login, insert where absent.

    An incoming row replaces every payload column, with NULL where it holds
    NULL. The moderation flags stay as they are, and start out false. One
    full outer join by login, which no hot login can skew, reads each side
    once.
    """
    arrived = last_arrival(incoming, USER_KEY).select(F.lit(True).alias("_new"), *USER.names).alias("a")
    known = target.select(F.lit(True).alias("_known"), *USER.names).alias("k")

    def next_value(name: str) -> str:
        if name in MODERATION_FLAGS:
            return f"IF(_known, k.{name}, false) AS {name}"
        return f"IF(_new, a.{name}, k.{name}) AS {name}"

    both = known.join(arrived, F.col("k.login") == F.col("a.login"), "full_outer")
    return both.selectExpr(*[next_value(name) for name in USER.names])


def upsert_repos(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace whole rows by (owner, name), insert where absent."""
    kept = _without(target.select(*REPO.names), incoming, REPO_KEY)
    return kept.unionByName(last_arrival(incoming, REPO_KEY).select(*REPO.names))


def _stale(repos: DataFrame, refreshed_owners: DataFrame, how: str) -> DataFrame:
    """Repositories that a complete, later listing of their owner no longer showed, or the others.

    Should the listings be too many to broadcast, adaptive execution splits
    the partition of a hot owner on the repository side and copies that
    owner's listing. It does so only for sides that come straight from a
    shuffle, which is why the listings are not aggregated here.
    """
    listed = refreshed_owners.select(
        F.col("owner").alias("_owner"), F.col("started_at").alias("_started_at")
    )
    gone = (F.col("owner") == F.col("_owner")) & (F.col("refreshed_at") < F.col("_started_at"))
    return repos.join(listed, gone, how)


def prune_stale_repos(repos: DataFrame, refreshed_owners: DataFrame) -> DataFrame:
    """Drop what a complete listing no longer showed.

    ``refreshed_owners`` holds ``(owner, started_at)``, one row per listing
    that ended well, empty listings included. A repository of such an owner
    goes when it was refreshed before the listing began; one never stamped
    stays.
    """
    return _stale(repos, refreshed_owners, "left_anti")


def replace_repos(
    target: DataFrame,
    incoming: DataFrame,
    refreshed_owners: DataFrame,
    stage: Stage | None = None,
) -> DataFrame:
    """``prune_stale_repos(upsert_repos(target, incoming), refreshed_owners)`` in one pass.

    The join on the owner, which a hot owner skews, sees three narrow columns
    and yields keys. Whole target rows move once, matched by their full key
    against the keys that arrived and the keys that went stale. Where those
    keys are staged their size is known, and if it is small the target rows
    do not move for the match at all.
    """
    stale = _stale(target.select(*REPO_KEY, "refreshed_at"), refreshed_owners, "left_semi")
    superseded = incoming.select(*REPO_KEY).unionByName(stale.select(*REPO_KEY)).distinct()
    if stage is not None:
        superseded = stage("superseded", superseded)
    kept = _without(target.select(*REPO.names), superseded, REPO_KEY)
    arrived = last_arrival(incoming, REPO_KEY).select(*REPO.names)
    return kept.unionByName(prune_stale_repos(arrived, refreshed_owners))
