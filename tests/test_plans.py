"""What the plans look like where no side is small enough to broadcast."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from forgeboard.operators import (
    developers,
    languages,
    maintenance,
    moderation,
    search,
    totals,
)
from forgeboard.session import shared_dir
from forgeboard.sources.schema import REPO, USER, evolve


@pytest.fixture(scope="module")
def stored(spark):
    """Tables in files; one owner holds a third of the repositories."""
    path = shared_dir(spark, "plans")
    users = spark.range(300).selectExpr(
        "concat('u', id) AS login", "'User' AS type", "false AS hide", "false AS is_admin",
        "'' AS company", "CAST(id AS INT) AS followers",
    )
    repos = spark.range(30_000).selectExpr(
        "concat('u', IF(id % 3 = 0, 0, id % 300)) AS owner", "concat('r', id) AS name",
        "IF(id % 4 = 0, 'Go', 'C') AS language", "CAST(id % 1000 AS INT) AS stargazers_count",
        "false AS fork", "timestamp_seconds(1600000000 + id) AS refreshed_at",
        "concat('about ', uuid(7)) AS description",
    )
    evolve(users, USER).write.parquet(f"{path}/users")
    evolve(repos, REPO).repartition(6).write.parquet(f"{path}/repos")
    return spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/repos")


@pytest.fixture
def no_broadcast(spark):
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan that ran, after adaptive changes."""
    df._jdf.collectToPython()
    return plan(df)


def test_no_cross_joins(stored, no_broadcast):
    users, repos = stored
    for df in (
        languages.language_leaders(repos, users, "go"),
        languages.language_page(repos, users, "go").languages,
        languages.language_page(repos, users, "go").count,
        developers.popular_devs(users, repos, "User"),
        developers.nested_profile(users, repos, "u7"),
        search.search_users(users, repos, "u"),
        maintenance.replace_repos(
            repos, repos, users.selectExpr("login AS owner", "refreshed_at AS started_at")
        ),
    ):
        assert not re.search("CartesianProduct|NestedLoop", plan(df))


def test_leaders_pass_few_rows_per_task(stored, no_broadcast):
    users, repos = stored
    text = plan(languages.language_leaders(repos, users, "go"))
    partial = text.index("Partial")
    assert text.index("row_number(), 3, Final") < partial
    # Nothing but the group limit's own sort lies between it and the scan.
    assert "Exchange" not in text[partial:].split("FileScan")[0]
    # The total is added up before its shuffle, from two columns.
    assert "partial_sum(stargazers_count" in text
    assert "ReadSchema: struct<owner:string,language:string,stargazers_count:int>" in text


def test_first_page_sorts_no_more_than_it_shows(stored, no_broadcast):
    users, repos = stored
    text = plan(languages.language_page(repos, users, "go").languages)
    assert "TakeOrderedAndProject(limit=25" in text and "rangepartitioning" not in text


def test_top_k_queries_do_not_sort_globally(stored, no_broadcast):
    users, repos = stored
    for df in (
        languages.popular_languages(repos),
        developers.popular_devs(users, repos, "User", sort_by="forks"),
        search.search_users(users, repos, "u"),
        search.search_repos(repos, "r1"),
    ):
        text = plan(df)
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    assert "Exchange" not in plan(search.search_repos(repos, "r1"))


def test_totals_combine_before_the_shuffle(stored):
    text = plan(totals.owner_totals(stored[1]))
    assert text.index("partial_sum") > text.index("Exchange hashpartitioning(owner")
    assert "ReadSchema: struct<owner:string,forks_count:int,stargazers_count:int>" in text


def test_lookup_filter_reaches_both_scans(stored, no_broadcast):
    users, repos = stored
    text = plan(developers.get_user(users, repos, "u7"))
    assert "EqualTo(login,u7)" in text and "EqualTo(owner,u7)" in text


def test_last_arrival_drops_copies_before_the_shuffle(stored):
    text = plan(maintenance.last_arrival(stored[1], ["owner"]))
    assert text.index("row_number(), 1, Final") < text.index("row_number(), 1, Partial")


def wide_exchanges(text: str) -> int:
    """Shuffles that carry whole repository rows: those fed by a scan of the description."""
    scans = [s for s in re.findall(r"ReadSchema: struct<([^\n]*)", text)]
    return sum("description" in s for s in scans)


def test_refresh_reads_wide_rows_once_per_side(spark, stored, no_broadcast):
    users, repos = stored
    incoming = repos.withColumn("refreshed_at", F.col("refreshed_at") + F.expr("INTERVAL 1 DAY"))
    listed = users.selectExpr("login AS owner", "TIMESTAMP '2030-01-01' AS started_at")
    text = plan(maintenance.replace_repos(repos, incoming, listed))
    assert wide_exchanges(text) == 2
    # Whole target rows are placed by their full key, not by the owner alone.
    assert re.search(r"SortMergeJoin \[owner#\d+, name#\d+\], \[owner#\d+, name#\d+\], LeftAnti", text)


@pytest.fixture
def small_partitions(spark, no_broadcast):
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_owner_is_split(stored, small_partitions):
    users, repos = stored
    listed = users.selectExpr("login AS owner", "TIMESTAMP '2020-09-13 16:00:00' AS started_at")
    pruned = maintenance.prune_stale_repos(repos, listed)
    assert "skew=true" in final_plan(pruned)
    deleted = moderation.delete_users(users, repos, users.filter("followers > 290").select("login")).repos
    assert "skew=true" in final_plan(deleted)
    judged = moderation.authorize(
        repos.selectExpr("owner AS actor", "'hide' AS action", "owner AS target", "description"), users
    ).allowed
    assert "skew=true" in final_plan(judged)
    assert pruned.count() == repos.filter("refreshed_at >= '2020-09-13 16:00:00'").count()
    assert judged.count() == 30_000


def test_hot_owner_is_split_when_stored(spark, stored, small_partitions):
    from forgeboard.sources.snapshots import Snapshot, SnapshotStore

    users, repos = stored
    store = SnapshotStore(spark, shared_dir(spark, "hot"), parts=4)
    version = store.publish(Snapshot(users, repos))
    got = store.read(version, owner="u0").repos
    # The part of the hot owner is spread over several files.
    assert len(got.inputFiles()) > 2
    assert got.filter("owner = 'u0'").count() == repos.filter("owner = 'u0'").count()
    assert store.read(version).repos.count() == 30_000
