"""Named queries: ``(spark, folder of tables) -> DataFrame``.

Results are flat and times are shown as text, so that they can be compared
with any other engine.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeboard.operators import (
    candidates,
    developers,
    languages,
    maintenance,
    moderation,
    runs,
    search,
    totals,
)
from forgeboard.plans.leaderboards import Leaderboards
from forgeboard.plans.listings import get_nested_profile, get_profile, list_devs, list_repos
from forgeboard.plans.moderate import moderate
from forgeboard.plans.refresh import land, refresh, run
from forgeboard.plans.search_index import SearchIndex
from forgeboard.session import shared_dir, tune
from checks import mapping
from forgeboard.sources.payload import (
    ARRIVAL,
    ENVELOPE,
    REPO_PAYLOAD,
    USER_PAYLOAD,
    normalize_repos,
    normalize_users,
    read_items,
    read_payload,
)
from forgeboard.sources.schema import (
    MODERATION_FLAGS,
    REPO,
    USER,
    evolve,
    repo_violations,
    user_violations,
)
from forgeboard.sources.seeds import read_seeds
from forgeboard.sources.snapshots import Snapshot, SnapshotStore
from forgeboard.streaming.landing import stream_refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FETCHED = datetime(2002, 1, 1, tzinfo=UTC)
LISTED = datetime(1998, 7, 1, tzinfo=UTC)
LANGUAGE = "2-High"
LOGIN = "Customer#000000011"


def plain(df: DataFrame) -> DataFrame:
    """Times as text."""
    return df.selectExpr(
        *[
            f"date_format({f.name}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS {f.name}"
            if isinstance(f.dataType, T.TimestampType)
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def counted(df: DataFrame) -> DataFrame:
    """Totals of an owner in the 32 bits that the SQL states; unknown beyond them."""
    return df.withColumns({c: F.col(c).try_cast("int") for c in ("stars", "forks") if c in df.columns})


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, folder: plain(fn(tune(spark), folder))
    return fn


def model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mapping.users(spark, folder), mapping.repos(spark, folder)


# -- languages -----------------------------------------------------------


@query
def popular_languages(spark, folder):
    return languages.popular_languages(mapping.repos(spark, folder))


@query
def popular_languages_packages(spark, folder):
    return languages.popular_languages(mapping.packages(spark, folder))


@query
def language_leaders(spark, folder):
    users, repos = model(spark, folder)
    return languages.language_leaders(repos, users, LANGUAGE)


@query
def language_leaders_packages(spark, folder):
    return languages.language_leaders(
        mapping.packages(spark, folder), mapping.suppliers(spark, folder), "rf"
    )


@query
def leaders_of_every_language(spark, folder):
    users, repos = model(spark, folder)
    return languages.leaders(repos, users)


def _flat(page: DataFrame) -> DataFrame:
    return page.select(
        "owner", "count", F.col("name").alias("display_name"), "type", F.explode("repos").alias("r")
    ).select(
        "owner", "count", "display_name", "type", "r.rownum", "r.name", "r.description",
        "r.forks_count", "r.stargazers_count", "r.watchers_count", "r.fork",
    )


@query
def language_page_first(spark, folder):
    users, repos = model(spark, folder)
    return _flat(languages.language_page(repos, users, LANGUAGE).languages)


@query
def language_page_second(spark, folder):
    users, repos = model(spark, folder)
    return _flat(languages.language_page(repos, users, LANGUAGE, 25, 25).languages)


@query
def language_page_deep(spark, folder):
    """The page's start is counted out, down to ten rows."""
    users, repos = model(spark, folder)
    return _flat(languages.language_page(repos, users, LANGUAGE, 25, 33, few=10).languages)


@query
def language_page_count(spark, folder):
    users, repos = model(spark, folder)
    return languages.language_page(repos, users, LANGUAGE).count


def _published(spark, folder) -> tuple[SnapshotStore, int]:
    users, repos = model(spark, folder)
    store = SnapshotStore(spark, shared_dir(spark, "snapshots"), parts=8)
    # A stored profile says whether it is hidden.
    return store, store.publish(Snapshot(users.fillna(False, ["hide"]), repos))


@query
def stored_leaderboard_page(spark, folder):
    store, version = _published(spark, folder)
    boards = Leaderboards(store, shared_dir(spark, "boards"))
    return _flat(boards.page(version, LANGUAGE, 20, 30).languages)


def _boards_after_refresh(spark, folder) -> tuple[Leaderboards, int]:
    """Boards of the version before a refresh, then those of the version it made."""
    store = _stored_before(spark, folder)
    boards = Leaderboards(store, shared_dir(spark, "boards"), few=10)
    boards.build(store.latest())
    run(store, read_items(spark, _landing(spark, folder)), FETCHED)
    return boards, store.latest()


@query
def refreshed_leaderboard_page(spark, folder):
    boards, version = _boards_after_refresh(spark, folder)
    return _flat(boards.page(version, LANGUAGE, 25, 33).languages)


@query
def refreshed_popular_languages(spark, folder):
    boards, version = _boards_after_refresh(spark, folder)
    return boards.popular_languages(version)


# -- developers ----------------------------------------------------------


def _ranked(dev_type: str, company: str | None, sort_by: str) -> Query:
    def run_it(spark, folder):
        users, repos = model(spark, folder)
        return counted(developers.popular_devs(users, repos, dev_type, company, sort_by))

    return run_it


for _name, _args in {
    "popular_devs_stars": ("User", None, "stars"),
    "popular_devs_forks": ("User", None, "forks"),
    "popular_devs_followers": ("User", None, "followers"),
    "popular_devs_public_repos": ("User", None, "public_repos"),
    "popular_devs_unknown_sort": ("User", None, "newest"),
    "popular_devs_company": ("User", "building", "followers"),
    "popular_devs_company_wildcard": ("User", "ma%ery", "forks"),
    "popular_organizations": ("Organization", None, ""),
}.items():
    _fn = _ranked(*_args)
    _fn.__name__ = _name
    query(_fn)


@query
def popular_devs_packages(spark, folder):
    return counted(developers.popular_devs(
        mapping.suppliers(spark, folder), mapping.packages(spark, folder), "User"
    ))


@query
def user_profiles(spark, folder):
    return counted(developers.user_profiles(*model(spark, folder)))


@query
def get_user(spark, folder):
    return counted(developers.get_user(*model(spark, folder), LOGIN))


@query
def repo_listing(spark, folder):
    return developers.repo_listing(mapping.repos(spark, folder))


@query
def repos_for_user(spark, folder):
    return developers.repos_for_user(mapping.repos(spark, folder), LOGIN.upper())


@query
def profile_repos(spark, folder):
    return developers.profile(*model(spark, folder), LOGIN).repos


def _places(nested: DataFrame) -> DataFrame:
    """A row per repository of a nested profile, with its page and place in the language."""
    rows = nested.select("user.login", "user.stars", "language", "page", F.posexplode("repos").alias("at", "r"))
    return plain(
        rows.select(
            "login", F.col("stars").try_cast("int").alias("stars"), "language", "page",
            (F.col("page") * developers.PAGE_ROWS + F.col("at")).alias("place"),
            F.col("r.name").alias("repo"), *[f"r.{c}" for c in REPO.names if c not in ("name", "language")],
        )
    )


@query
def nested_profile(spark, folder):
    return _places(developers.nested_profile(*model(spark, folder), LOGIN))


@query
def nested_profile_packages(spark, folder):
    """All packages under one owner: many pages."""
    held = mapping.packages(spark, folder).withColumn("owner", F.lit(LOGIN))
    return _places(developers.nested_profile(mapping.users(spark, folder), held, LOGIN))


@query
def stored_profile(spark, folder):
    return counted(get_profile(_published(spark, folder)[0], LOGIN).user)


@query
def stored_nested_profile(spark, folder):
    return _places(get_nested_profile(_published(spark, folder)[0], LOGIN))


@query
def owner_totals(spark, folder):
    return totals.owner_totals(mapping.repos(spark, folder))


@query
def owner_totals_packages(spark, folder):
    return totals.owner_totals(mapping.packages(spark, folder))


# -- search --------------------------------------------------------------


@query
def search_users(spark, folder):
    return counted(search.search_users(*model(spark, folder), "#0000001"))


@query
def search_users_wildcard(spark, folder):
    return counted(search.search_users(*model(spark, folder), "er#%_7"))


@query
def search_repos_documents(spark, folder):
    return search.search_repos(mapping.document_repos(spark, folder), "THE OF")


@query
def search_repos_pages(spark, folder):
    return search.search_repos(mapping.page_repos(spark, folder), "</Article>")


@query
def search_repos_escaped(spark, folder):
    return search.search_repos(mapping.repos(spark, folder), r"der\_1-_RGENT 100\%")


@query
def list_devs_by_type(spark, folder):
    store, version = _published(spark, folder)
    return counted(list_devs(store.read(version), dev_type="User", company="ma", sort="forks"))


@query
def list_devs_by_term(spark, folder):
    store, version = _published(spark, folder)
    return counted(list_devs(store.read(version), q="5"))


@query
def list_repos_by_term(spark, folder):
    store, version = _published(spark, folder)
    return list_repos(store.read(version), "repo-1")


@query
def indexed_search_users(spark, folder):
    store, version = _published(spark, folder)
    return counted(SearchIndex(store, shared_dir(spark, "search")).search_users(version, "#0000001"))


@query
def indexed_search_repos(spark, folder):
    store, version = _published(spark, folder)
    return SearchIndex(store, shared_dir(spark, "search")).search_repos(version, r"der\_1-_RGENT 100\%")


@query
def refreshed_indexed_search(spark, folder):
    """A search after a refresh, with the index kept from the version before."""
    store = _stored_before(spark, folder)
    index = SearchIndex(store, shared_dir(spark, "search"))
    index.build("repos", store.latest())
    run(store, read_items(spark, _landing(spark, folder)), FETCHED)
    return index.search_repos(store.latest(), "Repo-10")


# -- runs ----------------------------------------------------------------


@query
def last_run(spark, folder):
    return runs.last_run(mapping.runs(spark, folder))


@query
def append_run(spark, folder):
    return runs.append_run(mapping.runs(spark, folder), datetime(2024, 2, 1, tzinfo=UTC))


# -- candidates ----------------------------------------------------------


@query
def candidate_logins(spark, folder):
    users = mapping.users(spark, folder)
    path = shared_dir(spark, "seeds")
    users.filter("type = 'Organization'").select("login").union(
        spark.range(1).select(F.lit(""))
    ).write.text(path)
    return candidates.candidate_logins(users, read_seeds(spark, path))


@query
def candidate_window_counts(spark, folder):
    return candidates.candidate_window_counts(mapping.users(spark, folder), cap=10)


@query
def candidate_split_windows(spark, folder):
    """Windows that overlap and leave gaps, cut until no part holds more than five candidates."""
    windows = [
        candidates.CreationWindow("early", None, date(2012, 1, 1)),
        candidates.CreationWindow("wide", date(2011, 6, 1), date(2019, 6, 30)),
        candidates.CreationWindow("inner", date(2014, 1, 1), date(2014, 12, 31)),
        candidates.CreationWindow("late", date(2021, 1, 1), None),
    ]
    return candidates.candidate_split_windows(mapping.users(spark, folder), windows=windows, cap=5)


# -- payloads ------------------------------------------------------------


def _user_bodies(users: DataFrame) -> DataFrame:
    sent = [c for c in USER.names if c not in (*MODERATION_FLAGS, "refreshed_at", "company")]
    company = F.when(F.col("company") != "", F.col("company")).alias("company")
    return users.withColumn("body", F.to_json(F.struct(*sent, company)))


def _repo_bodies(repos: DataFrame) -> DataFrame:
    sent = [c for c in REPO.names if c not in ("owner", "refreshed_at")]
    owner = F.struct(F.col("owner").alias("login")).alias("owner")
    return repos.withColumn("body", F.to_json(F.struct(owner, *sent)))


def _landed_payload(bodies: DataFrame, schema: T.StructType) -> DataFrame:
    """Write payload lines to files and read them as a collector's output is read."""
    spark = bodies.sparkSession
    path = shared_dir(spark, "payload")
    bodies.write.text(path)
    return read_payload(spark, path, schema)


def _spoilt_user_bodies(spark, folder) -> DataFrame:
    """A payload of every user: without a login, cut off, or sound."""
    users = mapping.users(spark, folder)
    named = users.withColumn("login", F.when(F.col("following") == 3, "").otherwise(F.col("login")))
    bodies = _user_bodies(named)
    cut = F.when(F.col("following") == 5, F.substring("body", 1, 20)).otherwise(F.col("body"))
    return _landed_payload(bodies.select(cut.alias("body")), USER_PAYLOAD)


def _spoilt_repo_bodies(spark, folder) -> DataFrame:
    repos = mapping.repos(spark, folder)
    spoilt = repos.withColumn(
        "owner", F.when(F.col("network_count") == 3, None).otherwise(F.col("owner"))
    ).withColumn("name", F.when(F.col("network_count") == 5, "").otherwise(F.col("name")))
    return _landed_payload(_repo_bodies(spoilt).select("body"), REPO_PAYLOAD)


@query
def normalize_user_payloads(spark, folder):
    return normalize_users(_spoilt_user_bodies(spark, folder), FETCHED).rows.drop(ARRIVAL)


@query
def normalize_user_rejects(spark, folder):
    rejects = normalize_users(_spoilt_user_bodies(spark, folder), FETCHED).rejects
    return rejects.groupBy("reason").agg(F.count("*").alias("rows"))


@query
def normalize_repo_payloads(spark, folder):
    return normalize_repos(_spoilt_repo_bodies(spark, folder), FETCHED).rows.drop(ARRIVAL)


@query
def normalize_repo_rejects(spark, folder):
    rejects = normalize_repos(_spoilt_repo_bodies(spark, folder), FETCHED).rejects
    return rejects.groupBy("reason").agg(F.count("*").alias("rows"))


# -- upserts and pruning -------------------------------------------------


def _before(spark, folder) -> Snapshot:
    """Users made before 2020 and repositories made before 1999."""
    users, repos = model(spark, folder)
    return Snapshot(users.filter("created_at < '2020-01-01'"), repos.filter("created_at < '1999-01-01'"))


def _newer_users(users: DataFrame) -> DataFrame:
    """Every user as fetched anew: more followers, no blog, flags turned round."""
    return users.filter("created_at >= '2015-01-01'").withColumns(
        {
            "followers": F.col("followers") + 1,
            "blog": F.lit(None).cast("string"),
            "hide": F.lit(True),
            "is_admin": F.lit(True),
            "refreshed_at": F.lit(FETCHED),
        }
    )


def _newer_repos(repos: DataFrame) -> DataFrame:
    return repos.filter("created_at >= '1998-01-01'").withColumns(
        {"stargazers_count": F.col("stargazers_count") + 1, "refreshed_at": F.lit(FETCHED)}
    )


@query
def upsert_users(spark, folder):
    users, _ = model(spark, folder)
    return maintenance.upsert_users(_before(spark, folder).users, _newer_users(users))


@query
def upsert_repos(spark, folder):
    _, repos = model(spark, folder)
    newer = _newer_repos(repos)
    # Every row arrives twice; the later copy counts.
    early = newer.withColumns({"homepage": F.lit("early"), "arrival": F.lit(1)})
    late = newer.withColumn("arrival", F.lit(2))
    return maintenance.upsert_repos(_before(spark, folder).repos, early.unionByName(late))


@query
def prune_stale_repos(spark, folder):
    users, repos = model(spark, folder)
    listed = users.filter("type = 'User'").select(
        F.col("login").alias("owner"), F.lit(LISTED).alias("started_at")
    )
    return maintenance.prune_stale_repos(repos, listed)


@query
def prune_stale_packages(spark, folder):
    packages = mapping.packages(spark, folder).withColumn("refreshed_at", F.col("created_at"))
    listed = mapping.suppliers(spark, folder).filter("type = 'User'").select(
        F.col("login").alias("owner"), F.lit(LISTED).alias("started_at")
    )
    return maintenance.prune_stale_repos(packages, listed).select(
        "owner", "name", "stargazers_count", "refreshed_at"
    )


def _items(spark, folder) -> DataFrame:
    """A run's landed items: profiles of companies fail without a company, some listings break off."""
    users, repos = model(spark, folder)
    at = F.lit(FETCHED)
    newer = _newer_users(users)
    profiles = _user_bodies(newer).select(
        F.lit("profile").alias("kind"), "login", at.alias("fetched_at"),
        (F.col("company") != "").alias("ok"), "body",
    )
    listed = _repo_bodies(_newer_repos(repos)).select(
        F.lit("repo").alias("kind"), F.col("owner").alias("login"), at.alias("fetched_at"),
        F.lit(True).alias("ok"), "body",
    )
    ends = newer.select(
        F.lit("listing").alias("kind"), "login", at.alias("fetched_at"),
        (F.col("type") == "User").alias("ok"), F.lit(None).cast("string").alias("body"),
    )
    return profiles.unionByName(listed).unionByName(ends).select(*ENVELOPE.names)


def _landing(spark, folder) -> str:
    """The items as files; all items of an account lie in one of them."""
    path = shared_dir(spark, "landing")
    _items(spark, folder).repartition(4, "login").write.json(path)
    return path


def _refreshed(spark, folder) -> Snapshot:
    landed = land(read_items(spark, _landing(spark, folder)))
    return refresh(_before(spark, folder), landed)


@query
def refresh_users(spark, folder):
    return _refreshed(spark, folder).users


@query
def refresh_repos(spark, folder):
    return _refreshed(spark, folder).repos


def _stored_before(spark, folder) -> SnapshotStore:
    store = SnapshotStore(spark, shared_dir(spark, "snapshots"), parts=8)
    before = _before(spark, folder)
    store.publish(Snapshot(before.users.fillna(False, ["hide"]), before.repos))
    return store


@query
def published_refresh_repos(spark, folder):
    store = _stored_before(spark, folder)
    run(store, read_items(spark, _landing(spark, folder)), FETCHED)
    return store.read().repos


@query
def published_refresh_totals(spark, folder):
    store = _stored_before(spark, folder)
    run(store, read_items(spark, _landing(spark, folder)), FETCHED)
    return store.read().totals


def _streamed(spark, folder) -> SnapshotStore:
    store = _stored_before(spark, folder)
    stream = stream_refresh(
        store, _landing(spark, folder), shared_dir(spark, "stream"), files_per_batch=2
    )
    stream.awaitTermination()
    return store


@query
def stream_refresh_users(spark, folder):
    return _streamed(spark, folder).read().users


@query
def stream_refresh_repos(spark, folder):
    return _streamed(spark, folder).read().repos


def _streamed_in_pieces(spark, folder) -> SnapshotStore:
    """Items dealt over files by what they say, so that an account's lines lie in several micro-batches."""
    store = _stored_before(spark, folder)
    path = shared_dir(spark, "landing")
    _items(spark, folder).repartition(3, F.xxhash64("kind", "body")).write.json(path)
    stream_refresh(store, path, shared_dir(spark, "stream"), files_per_batch=1).awaitTermination()
    return store


@query
def stream_refresh_straddling_users(spark, folder):
    return _streamed_in_pieces(spark, folder).read().users


@query
def stream_refresh_straddling_repos(spark, folder):
    return _streamed_in_pieces(spark, folder).read().repos


@query
def refresh_rejects(spark, folder):
    store = _stored_before(spark, folder)
    run(store, read_items(spark, _landing(spark, folder)), FETCHED)
    return store.rejects()


@query
def stream_pending_accounts(spark, folder):
    """Accounts whose lines still wait after the stream, with the number of lines."""
    store = _streamed_in_pieces(spark, folder)
    return store.pending(ENVELOPE).groupBy("login", "kind").agg(F.count("*").alias("lines"))


# -- moderation ----------------------------------------------------------


def _hide_requests(spark, folder) -> DataFrame:
    """One request per order, many for the same login, and one per supplier, who has no profile."""
    orders = mapping.repos(spark, folder).select(
        F.col("owner").alias("login"), (F.col("fork").eqNullSafe(True)).alias("hide"),
        F.col("name").alias("arrival"),
    )
    strangers = mapping.suppliers(spark, folder).select(
        "login", F.lit(True).alias("hide"), F.col("login").alias("arrival")
    )
    return orders.unionByName(strangers)


@query
def hide_users(spark, folder):
    users = mapping.users(spark, folder)
    return moderation.hide_users(users, _hide_requests(spark, folder)).users.select(
        "login", "hide", "is_admin", "company"
    )


@query
def hide_rejects(spark, folder):
    users = mapping.users(spark, folder)
    return moderation.hide_users(users, _hide_requests(spark, folder)).rejects


def _left_after_delete(spark, folder) -> moderation.Remaining:
    users, repos = model(spark, folder)
    logins = users.filter("company = 'BUILDING'").select("login").union(
        mapping.suppliers(spark, folder).select("login")
    )
    return moderation.delete_users(users, repos, logins)


@query
def delete_users_profiles(spark, folder):
    return _left_after_delete(spark, folder).users


@query
def delete_users_repos(spark, folder):
    return _left_after_delete(spark, folder).repos


def _requests(spark, folder) -> moderation.Decided:
    """One request per order: the owner asks about itself or about another login."""
    users, repos = model(spark, folder)
    asked = repos.select(
        F.col("owner").alias("actor"),
        F.when(F.col("network_count") < 10, "delete").otherwise("hide").alias("action"),
        F.when(F.col("subscribers_count") < 5, F.col("owner")).otherwise(F.lit(LOGIN)).alias("target"),
        F.col("name").alias("request"),
    )
    return moderation.authorize(asked, users)


@query
def authorize_allowed(spark, folder):
    return _requests(spark, folder).allowed


@query
def authorize_denied(spark, folder):
    return _requests(spark, folder).denied


def _moderated(spark, folder):
    store, _ = _published(spark, folder)
    asked = mapping.repos(spark, folder).select(
        F.col("owner").alias("actor"),
        F.when(F.col("network_count") < 10, "delete").otherwise("hide").alias("action"),
        F.when(F.col("subscribers_count") < 5, F.col("owner")).otherwise(F.lit(LOGIN)).alias("target"),
        F.col("fork").eqNullSafe(True).alias("hide"),
        F.col("name").alias("arrival"),
    )
    return store, moderate(store, asked)


@query
def moderated_users(spark, folder):
    store, outcome = _moderated(spark, folder)
    return store.read(outcome.version).users.select("login", "hide", "is_admin")


@query
def moderated_repos(spark, folder):
    store, outcome = _moderated(spark, folder)
    return store.read(outcome.version).repos.select("owner", "name", "stargazers_count")


@query
def moderate_rejects(spark, folder):
    _, outcome = _moderated(spark, folder)
    return outcome.rejects


# -- schema --------------------------------------------------------------


@query
def evolve_users(spark, folder):
    added = ["hide", "is_admin", "company", "refreshed_at", "type", "name"]
    older = mapping.users(spark, folder).drop(*added)
    return evolve(evolve(older, USER), USER)


@query
def user_key_violations(spark, folder):
    """Users under one key per company, some of which is missing."""
    users = mapping.users(spark, folder)
    return user_violations(users.withColumn("login", F.nullif("company", F.lit(""))))


@query
def repo_key_violations(spark, folder):
    """Documents under their language, with the whole text as the repository's language."""
    docs = mapping.document_repos(spark, folder)
    return repo_violations(
        docs.withColumns({"name": F.col("language"), "language": F.col("description")})
    )
