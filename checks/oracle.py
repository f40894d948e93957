"""The named queries stated in SQL over the same base tables."""

from __future__ import annotations

from pyspark.sql import types as T

from checks import mapping
from forgeboard.sources.schema import ADDED_DEFAULTS, REPO, USER

SQL_TYPES = {
    T.StringType: "VARCHAR",
    T.IntegerType: "INTEGER",
    T.BooleanType: "BOOLEAN",
    T.TimestampType: "TIMESTAMP",
}
LANGUAGE = "2-high"
LOGIN = "Customer#000000011"
PAGE_ROWS = 1_000
FETCHED = "TIMESTAMP '2002-01-01 00:00:00'"
LISTED = "TIMESTAMP '1998-07-01 00:00:00'"


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else f"'{value}'"


def _mapped(schema: T.StructType, expressions: dict[str, str], source: str) -> str:
    columns = ", ".join(
        f"CAST({expressions.get(f.name, _literal(ADDED_DEFAULTS.get(f.name)))}"
        f" AS {SQL_TYPES[type(f.dataType)]}) AS {f.name}"
        for f in schema.fields
    )
    return f"SELECT {columns} FROM {source}"


INPUTS = {
    "users": _mapped(USER, mapping.USER_EXPRESSIONS, mapping.USER_SQL),
    "repos": _mapped(REPO, mapping.REPO_EXPRESSIONS, mapping.REPO_SQL),
    "docs": _mapped(REPO, mapping.DOCUMENT_EXPRESSIONS, "documents"),
    "web": _mapped(REPO, mapping.PAGE_EXPRESSIONS, "pages"),
    "packages": _mapped(REPO, mapping.PACKAGE_EXPRESSIONS, mapping.PACKAGE_SQL),
    "suppliers": _mapped(USER, mapping.SUPPLIER_EXPRESSIONS, mapping.SUPPLIER_SQL),
}


def _with(inputs: str, body: str, extra: dict[str, str] | None = None) -> str:
    tables = {name: INPUTS[name] for name in inputs.split()} | (extra or {})
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in tables.items())
    return f"WITH {ctes}\n{body}"


def _time(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def _columns(schema: T.StructType, prefix: str = "") -> str:
    """All columns as stored, times as text."""
    return ", ".join(
        _time(prefix + f.name, f.name)
        if isinstance(f.dataType, T.TimestampType)
        else f"{prefix}{f.name} AS {f.name}"
        for f in schema.fields
    )


def _shown(schema: T.StructType, raw: tuple[str, ...], skip: tuple[str, ...] = (), prefix: str = "") -> str:
    """All columns with read defaults."""
    default = {T.StringType: "''", T.IntegerType: "0", T.BooleanType: "false"}
    out = []
    for f in schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.TimestampType):
            out.append(_time(prefix + f.name, f.name))
        elif f.name in raw:
            out.append(f"{prefix}{f.name} AS {f.name}")
        else:
            out.append(f"COALESCE({prefix}{f.name}, {default[type(f.dataType)]}) AS {f.name}")
    return ", ".join(out)


REPO_SHOWN = _shown(REPO, ("owner", "name"))
TOTALS = (
    "SELECT owner, CAST(SUM(stargazers_count) AS BIGINT) AS stars,"
    " CAST(SUM(forks_count) AS BIGINT) AS forks FROM {} GROUP BY owner"
)


def _places(source: str, held: str) -> str:
    """Repositories of LOGIN, which owns those that ``held`` says, by place in their language."""
    place = """ROW_NUMBER() OVER (PARTITION BY COALESCE(r.language, '')
        ORDER BY COALESCE(r.stargazers_count, 0) DESC, r.name) - 1"""
    return f"""SELECT login, CAST((SELECT SUM(stargazers_count) FROM {source}
            WHERE {"owner = '" + LOGIN + "'" if held != "TRUE" else held}) AS INTEGER) AS stars,
        COALESCE(r.language, '') AS language, CAST(floor(({place}) / {PAGE_ROWS}) AS INTEGER) AS page,
        CAST({place} AS INTEGER) AS place, r.name AS repo,
        {"r.owner" if held != "TRUE" else "'" + LOGIN + "'"} AS owner,
        {_shown(REPO, ("owner", "name"), ("owner", "name", "language"), "r.")}
        FROM users u, (SELECT * FROM {source} WHERE {held}) r WHERE u.login = '{LOGIN}'"""


# Stored profiles always say whether they are hidden.
FILLED = {
    "users": f"SELECT * REPLACE (COALESCE(hide, false) AS hide) FROM ({INPUTS['users']})"
}


def _popular(table: str, inputs: str = "", made: dict[str, str] | None = None) -> str:
    return _with(
        inputs or table,
        f"""SELECT language, COUNT(*) AS count, COUNT(DISTINCT owner) AS users FROM {table}
        WHERE language IS NOT NULL AND fork = FALSE
        GROUP BY language ORDER BY count DESC, language LIMIT 50""",
        made,
    )


def _ranked(repos: str, users: str, condition: str) -> dict[str, str]:
    """Ranked rows with the total as a correlated subquery."""
    return {
        "board": f"""SELECT r.owner, r.name,
          COALESCE(r.description, '') AS description,
          COALESCE(r.forks_count, 0) AS forks_count,
          COALESCE(r.stargazers_count, 0) AS stargazers_count,
          COALESCE(r.watchers_count, 0) AS watchers_count,
          COALESCE(r.fork, false) AS fork,
          CAST((SELECT SUM(x.stargazers_count) FROM {repos} x
                WHERE lower(x.language) = lower(r.language) AND x.owner = r.owner) AS BIGINT) AS total_stars,
          lower(r.language) AS lang_key,
          ROW_NUMBER() OVER (PARTITION BY lower(r.language), r.owner
            ORDER BY r.stargazers_count DESC NULLS FIRST, r.name) AS rownum,
          COALESCE(u.name, '') AS display_name, COALESCE(u.type, '') AS type
        FROM {repos} r JOIN {users} u ON u.login = r.owner WHERE {condition}"""
    }


BOARD = (
    "owner, name, description, forks_count, stargazers_count, watchers_count, fork,"
    " total_stars, rownum, display_name, type"
)


def _leaders(repos: str, users: str, lang: str) -> str:
    return _with(
        f"{repos} {users}",
        f"SELECT {BOARD} FROM board WHERE rownum < 4",
        _ranked(repos, users, f"lower(r.language) = '{lang}'"),
    )


def _page(limit: int, offset: int, repos: str = "repos", users: str = "users", made: dict[str, str] | None = None) -> str:
    owners = {
        "owners": f"""SELECT owner, MAX(total_stars) AS total FROM board GROUP BY owner
        ORDER BY total DESC NULLS FIRST, owner LIMIT {limit} OFFSET {offset}"""
    }
    return _with(
        "repos users",
        """SELECT owner, total_stars AS count, display_name, type, rownum, name, description,
        forks_count, stargazers_count, watchers_count, fork
        FROM board JOIN owners USING (owner) WHERE rownum < 4""",
        (made or {}) | _ranked(repos, users, f"lower(r.language) = '{LANGUAGE}'") | owners,
    )


def _devs(
    dev_type: str,
    order: str,
    company: str | None = None,
    repos: str = "repos",
    users: str = "users",
    stored: bool = False,
) -> str:
    if stored:
        inputs, extra = repos, dict(FILLED)
    else:
        inputs, extra = f"{repos} {users}", {}
    also = f"AND lower(company) LIKE lower('{company}')" if company else ""
    return _with(
        inputs,
        f"""SELECT login, COALESCE(u.name, '') AS name, company,
        COALESCE(avatar_url, '') AS avatar_url, COALESCE(u.followers, 0) AS followers,
        COALESCE(u.public_repos, 0) AS public_repos,
        CAST(stars AS INTEGER) AS stars, CAST(forks AS INTEGER) AS forks, COALESCE(type, '') AS type
        FROM {users} u JOIN totals ON owner = login
        WHERE type = '{dev_type}' AND hide IS FALSE {also}
        ORDER BY {order} DESC NULLS FIRST, totals.stars DESC NULLS FIRST, login LIMIT 100""",
        extra | {"totals": TOTALS.format(repos)},
    )


def _search_users(pattern: str, stored: bool = False) -> str:
    return _with(
        "repos" if stored else "repos users",
        f"""SELECT login, COALESCE(name, '') AS name, COALESCE(followers, 0) AS followers,
        COALESCE(public_repos, 0) AS public_repos, COALESCE(public_gists, 0) AS public_gists,
        COALESCE(avatar_url, '') AS avatar_url, COALESCE(type, '') AS type, hide, is_admin,
        CAST(COALESCE(totals.stars, 0) AS INTEGER) AS stars,
        CAST(COALESCE(totals.forks, 0) AS INTEGER) AS forks
        FROM users LEFT JOIN totals ON owner = login WHERE login LIKE '{pattern}'
        ORDER BY COALESCE(totals.stars, 0) DESC, login LIMIT 50""",
        (FILLED if stored else {}) | {"totals": TOTALS.format("repos")},
    )


def _search_repos(table: str, pattern: str, bases: str | None = None, extra: dict[str, str] | None = None) -> str:
    return _with(
        bases or table,
        f"""SELECT {REPO_SHOWN} FROM {table}
        WHERE lower(name) LIKE lower('{pattern}') ESCAPE '\\'
           OR lower(description) LIKE lower('{pattern}') ESCAPE '\\'
        ORDER BY COALESCE({table}.stargazers_count, 0) DESC, owner, name LIMIT 50""",
        extra,
    )


PROFILE = f"""SELECT {_shown(USER, ("login", "company", "hide", "is_admin"), ("refreshed_at",))},
    CAST(COALESCE(totals.stars, 0) AS INTEGER) AS stars,
    CAST(COALESCE(totals.forks, 0) AS INTEGER) AS forks
    FROM users LEFT JOIN totals ON owner = login"""

# Any of four spellings; more than one repository; type user.
NEAR = """lower(type) = 'user' AND public_repos > 1 AND (lower(location) LIKE '%st. louis%'
    OR lower(location) LIKE '%stl%' OR lower(location) LIKE '%st louis%'
    OR lower(location) LIKE '%saint louis%')"""
WINDOWS = """SELECT '<2013-01-01' AS "window", DATE '0001-01-01' AS a, DATE '2012-12-31' AS b
    UNION ALL SELECT '>2025-01-01', DATE '2025-01-02', DATE '9999-12-31'
    UNION ALL SELECT y || '-01-01..' || (y + 1) || '-01-01', make_date(y, 1, 1), make_date(y + 1, 1, 1)
    FROM (SELECT unnest(range(2013, 2025)) AS y)"""

# The payloads of every user or repository after some were spoilt.
SENT_USERS = "SELECT * FROM users WHERE following NOT IN (3, 5)"
SENT_REPOS = "SELECT * FROM repos WHERE network_count NOT IN (3, 5)"

BEFORE = {
    "old_users": "SELECT * FROM users WHERE created_at < TIMESTAMP '2020-01-01'",
    "old_repos": "SELECT * FROM repos WHERE created_at < TIMESTAMP '1999-01-01'",
    "new_users": f"""SELECT * REPLACE (followers + 1 AS followers, CAST(NULL AS VARCHAR) AS blog,
        true AS hide, true AS is_admin, {FETCHED} AS refreshed_at)
        FROM users WHERE created_at >= TIMESTAMP '2015-01-01'""",
    "new_repos": f"""SELECT * REPLACE (stargazers_count + 1 AS stargazers_count, {FETCHED} AS refreshed_at)
        FROM repos WHERE created_at >= TIMESTAMP '1998-01-01'""",
}


def _merged_users(arrived: str) -> str:
    return f"""SELECT * REPLACE (COALESCE(
          (SELECT o.hide FROM old_users o WHERE o.login = n.login),
          CASE WHEN n.login IN (SELECT login FROM old_users) THEN NULL ELSE false END) AS hide,
        COALESCE((SELECT o.is_admin FROM old_users o WHERE o.login = n.login), false) AS is_admin)
        FROM {arrived} n
        UNION ALL SELECT * FROM old_users WHERE login NOT IN (SELECT login FROM {arrived})"""


def _merged_repos(arrived: str) -> str:
    return f"""SELECT * FROM {arrived} UNION ALL SELECT * FROM old_repos o
        WHERE NOT EXISTS (SELECT 1 FROM {arrived} n WHERE n.owner = o.owner AND n.name = o.name)"""


# Only accounts whose profile came through bring their repositories.
REFRESHED = BEFORE | {
    "came_users": "SELECT * FROM new_users WHERE company <> ''",
    "came_repos": "SELECT * FROM new_repos WHERE owner IN (SELECT login FROM came_users)",
    "after_users": _merged_users("came_users"),
    "merged_repos": _merged_repos("came_repos"),
    "after_repos": f"""SELECT * FROM merged_repos
        WHERE NOT COALESCE(refreshed_at < {FETCHED}, false)
           OR owner NOT IN (SELECT login FROM came_users WHERE type = 'User')""",
}
REFRESH_USERS = _with("users repos", f"SELECT {_columns(USER)} FROM after_users", REFRESHED)
STORED_USERS = _with("repos", f"SELECT {_columns(USER)} FROM after_users", FILLED | REFRESHED)
REFRESH_REPOS = _with("users repos", f"SELECT {_columns(REPO)} FROM after_repos", REFRESHED)

HIDE_REQUESTS = {
    "asked": """SELECT owner AS login, COALESCE(fork, false) AS hide, name AS arrival FROM repos
        UNION ALL SELECT login, true, login FROM suppliers""",
}
GONE = {
    "gone": "SELECT login FROM users WHERE company = 'BUILDING' UNION SELECT login FROM suppliers"
}
JUDGED = {
    "asked": f"""SELECT owner AS actor, CASE WHEN network_count < 10 THEN 'delete' ELSE 'hide' END AS action,
        CASE WHEN subscribers_count < 5 THEN owner ELSE '{LOGIN}' END AS target, name AS request FROM repos""",
    "judged": """SELECT asked.*, COALESCE(users.is_admin, false) AS admin
        FROM asked LEFT JOIN users ON login = actor""",
}
ALLOWED = "(admin OR (action = 'hide' AND actor = target))"

MODERATED = JUDGED | {
    "asked": JUDGED["asked"].replace(
        "name AS request", "COALESCE(fork, false) AS hide, name AS arrival"
    ),
    "judged": JUDGED["judged"].replace("asked.*", "actor, action, target, asked.hide, arrival"),
    "allowed": f"SELECT action, target, hide, arrival FROM judged WHERE {ALLOWED}",
}

ORACLE: dict[str, str] = {
    "popular_languages": _popular("repos"),
    "popular_languages_packages": _popular("packages"),
    "language_leaders": _leaders("repos", "users", LANGUAGE),
    "language_leaders_packages": _leaders("packages", "suppliers", "rf"),
    "leaders_of_every_language": _with(
        "repos users",
        f"SELECT lang_key, {BOARD} FROM board WHERE rownum < 4",
        _ranked("repos", "users", "r.language IS NOT NULL"),
    ),
    "language_page_first": _page(25, 0),
    "language_page_second": _page(25, 25),
    "language_page_count": _with(
        "repos users",
        f"""SELECT COUNT(DISTINCT owner) AS count FROM repos JOIN users ON login = owner
        WHERE lower(language) = '{LANGUAGE}'""",
    ),
    "language_page_deep": _page(25, 33),
    "stored_leaderboard_page": _page(20, 30),
    "refreshed_leaderboard_page": _page(25, 33, "after_repos", "after_users", REFRESHED),
    "refreshed_popular_languages": _popular("after_repos", "users repos", REFRESHED),
    "popular_devs_stars": _devs("User", "totals.stars"),
    "popular_devs_forks": _devs("User", "totals.forks"),
    "popular_devs_followers": _devs("User", "u.followers"),
    "popular_devs_public_repos": _devs("User", "u.public_repos"),
    "popular_devs_unknown_sort": _devs("User", "totals.stars"),
    "popular_devs_company": _devs("User", "u.followers", "%building%"),
    "popular_devs_company_wildcard": _devs("User", "totals.forks", "%ma%ery%"),
    "popular_organizations": _devs("Organization", "totals.stars"),
    "popular_devs_packages": _devs("User", "totals.stars", repos="packages", users="suppliers"),
    "user_profiles": _with("users repos", PROFILE, {"totals": TOTALS.format("repos")}),
    "get_user": _with(
        "users repos", f"{PROFILE} WHERE login = '{LOGIN}'", {"totals": TOTALS.format("repos")}
    ),
    "repo_listing": _with("repos", f"SELECT {REPO_SHOWN} FROM repos"),
    "repos_for_user": _with(
        "repos", f"SELECT {REPO_SHOWN} FROM repos WHERE lower(owner) = lower('{LOGIN}')"
    ),
    "profile_repos": _with(
        "users repos",
        f"""SELECT {REPO_SHOWN} FROM repos WHERE lower(owner) = lower('{LOGIN}')
        AND EXISTS (SELECT 1 FROM users WHERE login = '{LOGIN}')""",
    ),
    "nested_profile": _with("users repos", _places("repos", f"lower(owner) = lower('{LOGIN}')")),
    "stored_profile": _with(
        "repos", f"{PROFILE} WHERE login = '{LOGIN}'", FILLED | {"totals": TOTALS.format("repos")}
    ),
    "stored_nested_profile": _with(
        "users repos", _places("repos", f"lower(owner) = lower('{LOGIN}')")
    ),
    "nested_profile_packages": _with("users packages", _places("packages", "TRUE")),
    "owner_totals": _with("repos", TOTALS.format("repos")),
    "owner_totals_packages": _with("packages", TOTALS.format("packages")),
    "search_users": _search_users("%#0000001%"),
    "search_users_wildcard": _search_users("%er#%_7%"),
    "search_repos_documents": _search_repos("docs", "%THE OF%"),
    "search_repos_pages": _search_repos("web", "%</Article>%"),
    "search_repos_escaped": _search_repos("repos", r"%der\_1-_RGENT 100\%%"),
    "list_devs_by_type": _devs("User", "totals.forks", "%ma%", stored=True),
    "list_devs_by_term": _search_users("%5%", stored=True),
    "list_repos_by_term": _search_repos("repos", "%repo-1%"),
    "indexed_search_users": _search_users("%#0000001%", stored=True),
    "indexed_search_repos": _search_repos("repos", r"%der\_1-_RGENT 100\%%"),
    "refreshed_indexed_search": _search_repos("after_repos", "%Repo-10%", "users repos", REFRESHED),
    "last_run": f"SELECT {_time('MAX(ts)', 'created_at')} FROM events",
    "append_run": f"""SELECT {_time('ts', 'created_at')} FROM events
        UNION ALL SELECT '2024-02-01 00:00:00.000000'""",
    "candidate_logins": _with(
        "users",
        f"""SELECT login FROM users WHERE {NEAR} AND created_at IS NOT NULL
        UNION SELECT login FROM users WHERE type = 'Organization'""",
    ),
    "candidate_split_windows": _with(
        "users",
        f"""SELECT "window", CAST(a AS VARCHAR) AS first, CAST(b AS VARCHAR) AS last, n AS candidates, n > 5 AS near_ceiling
        FROM (WITH RECURSIVE days AS (
            SELECT created, COUNT(*) AS n FROM (
              SELECT login, MIN(CAST(created_at AS DATE)) AS created FROM users WHERE {NEAR} GROUP BY login)
            WHERE created IS NOT NULL GROUP BY created),
          halves AS (
            SELECT "window", a, b, (SELECT SUM(n) FROM days WHERE created BETWEEN a AND b) AS n
            FROM (SELECT 'early' AS "window", (SELECT MIN(created) FROM days) AS a, DATE '2011-12-31' AS b
              UNION ALL SELECT 'wide', DATE '2011-06-01', DATE '2019-06-30'
              UNION ALL SELECT 'inner', DATE '2014-01-01', DATE '2014-12-31'
              UNION ALL SELECT 'late', DATE '2021-01-02', (SELECT MAX(created) FROM days))
            UNION ALL
            SELECT "window", a2, b2, (SELECT SUM(n) FROM days WHERE created BETWEEN a2 AND b2)
            FROM (SELECT "window", CASE side WHEN 0 THEN a ELSE a + CAST((b - a) // 2 + 1 AS INTEGER) END AS a2,
                CASE side WHEN 0 THEN a + CAST((b - a) // 2 AS INTEGER) ELSE b END AS b2
              FROM halves, (VALUES (0), (1)) s(side) WHERE n > 5 AND a < b))
          SELECT "window", a, b, CAST(n AS BIGINT) AS n FROM halves WHERE n > 0 AND (n <= 5 OR a = b))""",
    ),
    "candidate_window_counts": _with(
        "users",
        f"""SELECT "window", COUNT(DISTINCT login) AS candidates, COUNT(DISTINCT login) > 10 AS near_ceiling
        FROM windows JOIN users ON CAST(created_at AS DATE) BETWEEN a AND b
        WHERE {NEAR} GROUP BY "window" """,
        {"windows": WINDOWS},
    ),
    "normalize_user_payloads": _with(
        "users",
        f"SELECT {_columns(USER)} FROM sent",
        {"sent": f"""SELECT * REPLACE (false AS hide, false AS is_admin, {FETCHED} AS refreshed_at)
          FROM ({SENT_USERS})"""},
    ),
    "normalize_user_rejects": _with(
        "users",
        """SELECT CASE following WHEN 3 THEN 'user missing login' ELSE 'malformed payload' END AS reason,
        COUNT(*) AS rows FROM users WHERE following IN (3, 5) GROUP BY 1""",
    ),
    "normalize_repo_payloads": _with(
        "repos",
        f"SELECT {_columns(REPO)} FROM sent",
        {"sent": f"SELECT * REPLACE ({FETCHED} AS refreshed_at) FROM ({SENT_REPOS})"},
    ),
    "normalize_repo_rejects": _with(
        "repos",
        """SELECT CASE network_count WHEN 3 THEN 'repo missing owner' ELSE 'repo missing name' END AS reason,
        COUNT(*) AS rows FROM repos WHERE network_count IN (3, 5) GROUP BY 1""",
    ),
    "upsert_users": _with(
        "users repos",
        f"SELECT {_columns(USER)} FROM after_users",
        BEFORE | {"after_users": _merged_users("new_users")},
    ),
    "upsert_repos": _with(
        "users repos",
        f"SELECT {_columns(REPO)} FROM after_repos",
        BEFORE | {"after_repos": _merged_repos("new_repos")},
    ),
    "prune_stale_repos": _with(
        "users repos",
        f"""SELECT {_columns(REPO)} FROM repos WHERE refreshed_at IS NULL OR refreshed_at >= {LISTED}
        OR owner NOT IN (SELECT login FROM users WHERE type = 'User')""",
    ),
    "prune_stale_packages": _with(
        "packages suppliers",
        f"""SELECT owner, name, stargazers_count, {_time('created_at', 'refreshed_at')} FROM packages
        WHERE created_at >= {LISTED} OR owner NOT IN (SELECT login FROM suppliers WHERE type = 'User')""",
    ),
    "refresh_users": REFRESH_USERS,
    "refresh_repos": REFRESH_REPOS,
    "published_refresh_repos": REFRESH_REPOS,
    "published_refresh_totals": _with(
        "users repos", TOTALS.format("after_repos"), REFRESHED
    ),
    "refresh_rejects": _with("users repos", """
        SELECT 'account' AS kind, login AS owner, CAST(NULL AS VARCHAR) AS name, 'profile not fetched' AS reason
        FROM new_users WHERE NOT COALESCE(company <> '', false)
        UNION ALL SELECT DISTINCT 'account', owner, CAST(NULL AS VARCHAR), 'no profile'
        FROM new_repos WHERE owner NOT IN (SELECT login FROM new_users)""", BEFORE),
    "stream_pending_accounts": _with("users repos", """
        SELECT owner AS login, 'repo' AS kind, COUNT(*) AS lines
        FROM new_repos WHERE owner NOT IN (SELECT login FROM new_users) GROUP BY owner""", BEFORE),
    "stream_refresh_straddling_users": STORED_USERS,
    "stream_refresh_straddling_repos": REFRESH_REPOS,
    "stream_refresh_users": STORED_USERS,
    "stream_refresh_repos": REFRESH_REPOS,
    "hide_users": _with(
        "users repos suppliers",
        """SELECT login, CASE WHEN login IN (SELECT login FROM asked)
          THEN (SELECT arg_max(a.hide, a.arrival) FROM asked a WHERE a.login = users.login)
          ELSE hide END AS hide, is_admin, company FROM users""",
        HIDE_REQUESTS,
    ),
    "hide_rejects": _with(
        "users repos suppliers",
        """SELECT login, hide, arrival, 'affected no users' AS reason FROM asked
        WHERE login NOT IN (SELECT login FROM users)""",
        HIDE_REQUESTS,
    ),
    "delete_users_profiles": _with(
        "users suppliers",
        f"SELECT {_columns(USER)} FROM users WHERE login NOT IN (SELECT login FROM gone)",
        GONE,
    ),
    "delete_users_repos": _with(
        "users repos suppliers",
        f"SELECT {_columns(REPO)} FROM repos WHERE owner NOT IN (SELECT login FROM gone)",
        GONE,
    ),
    "authorize_allowed": _with(
        "users repos", f"SELECT actor, action, target, request FROM judged WHERE {ALLOWED}", JUDGED
    ),
    "authorize_denied": _with(
        "users repos",
        f"""SELECT actor, action, target, request, CASE action WHEN 'hide'
        THEN 'Users can only modify themselves' ELSE 'Only admins can delete users' END AS reason
        FROM judged WHERE NOT {ALLOWED}""",
        JUDGED,
    ),
    "moderated_users": _with(
        "repos",
        """SELECT login, COALESCE((SELECT arg_max(a.hide, a.arrival) FROM allowed a
          WHERE a.action = 'hide' AND a.target = users.login), hide) AS hide, is_admin
        FROM users WHERE login NOT IN (SELECT target FROM allowed WHERE action = 'delete')""",
        FILLED | MODERATED,
    ),
    "moderated_repos": _with(
        "repos",
        """SELECT owner, name, stargazers_count FROM repos
        WHERE owner NOT IN (SELECT target FROM allowed WHERE action = 'delete')""",
        FILLED | MODERATED,
    ),
    "moderate_rejects": _with(
        "repos",
        f"""SELECT actor, action, target, hide, arrival, CASE action WHEN 'hide'
        THEN 'Users can only modify themselves' ELSE 'Only admins can delete users' END AS reason
        FROM judged WHERE NOT {ALLOWED}
        UNION ALL SELECT actor, action, target, hide, arrival, 'affected no users' FROM judged j
        WHERE {ALLOWED} AND action = 'hide' AND (target NOT IN (SELECT login FROM users) OR arrival >=
          (SELECT MIN(d.arrival) FROM allowed d WHERE d.action = 'delete' AND d.target = j.target))""",
        FILLED | MODERATED,
    ),
    "evolve_users": _with(
        "users",
        f"""SELECT {_columns(USER)} FROM (SELECT * REPLACE (false AS hide, false AS is_admin,
        '' AS company, CAST(NULL AS TIMESTAMP) AS refreshed_at, CAST(NULL AS VARCHAR) AS type,
        CAST(NULL AS VARCHAR) AS name) FROM users)""",
    ),
    "user_key_violations": _with(
        "users",
        """SELECT 'null_key' AS rule, 'login' AS "column", '{}' AS key, COUNT(*) AS rows
          FROM keyed WHERE login IS NULL HAVING COUNT(*) > 0
        UNION ALL SELECT 'null_required', 'hide',
          COALESCE('{"login":"' || login || '"}', '{}'), COUNT(*) FROM keyed WHERE hide IS NULL GROUP BY login
        UNION ALL SELECT 'duplicate_key', 'login', '{"login":"' || login || '"}', COUNT(*)
          FROM keyed WHERE login IS NOT NULL GROUP BY login HAVING COUNT(*) > 1""",
        {"keyed": "SELECT * REPLACE (NULLIF(company, '') AS login) FROM users"},
    ),
    "repo_key_violations": _with(
        "docs",
        """SELECT 'too_long' AS rule, 'language' AS "column",
          '{"owner":"' || owner || '","name":"' || language || '"}' AS key, COUNT(*) AS rows
          FROM docs WHERE length(description) > 255 GROUP BY owner, language
        UNION ALL SELECT 'duplicate_key', 'owner,name',
          '{"owner":"' || owner || '","name":"' || language || '"}', COUNT(*)
          FROM docs GROUP BY owner, language HAVING COUNT(*) > 1""",
    ),
}
