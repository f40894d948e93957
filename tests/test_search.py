from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from forgeboard.functions.text import contains_pattern
from forgeboard.operators import search
from tests.conftest import column, repo


def test_users_by_case_and_stars(make):
    users = make.users(
        {"login": "bobby", "hide": True}, {"login": "Bob"}, {"login": "kebob"}, {"login": "eve"}
    )
    repos = make.repos(repo("kebob", "r", 3), repo("bobby", "r", 7, forks_count=2))
    got = search.search_users(users, repos, "bob").collect()
    assert [(r.login, r.stars, r.forks, r.hide) for r in got] == [
        ("bobby", 7, 2, True), ("kebob", 3, 0, False),
    ]


def test_repos_in_name_or_description(make):
    repos = make.repos(
        repo("a", "Parser", 1), repo("b", "x", None, description="a PARSER kit"),
        repo("c", "y", 5, description=None), repo("d", "parse", 9), repo("e", "parsers", 1),
    )
    assert column(search.search_repos(repos, "parser"), "owner") == ["a", "e", "b"]
    assert search.search_repos(repos, "x").count() == 1


def test_wildcards_and_escapes(make):
    names = ["100%", "100x", "a_b", "axb", r"a\b", "ab", "%"]
    repos = make.repos(*[repo("o", n, 1) for n in names])

    def found(term):
        return set(column(search.search_repos(repos, term), "name"))

    assert found("100%") == {"100%", "100x"}
    assert found(r"100\%") == {"100%"}
    assert found("a_b") == {"a_b", "axb", r"a\b"}
    assert found(r"a\_b") == {"a_b"}
    assert found(r"a\\b") == {r"a\b"}
    assert found(r"a\b") == {"ab"}
    # A closing backslash takes the final wildcard's meaning away.
    assert found("\\") == {"100%", "%"}
    assert found("") == set(names)


def like(pattern: str, text: str) -> bool:
    """LIKE with a backslash escape, spelled out."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(pattern[i], re.escape(pattern[i]))
        i += 1
    return re.fullmatch(out, text, re.DOTALL) is not None


TEXT = st.text(alphabet="ab%_\\", max_size=5)


@settings(max_examples=25, deadline=None)
@given(term=TEXT, texts=st.lists(TEXT, min_size=1, max_size=12, unique=True))
def test_pattern_against_like(spark, term, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    from pyspark.sql import functions as F

    got = column(rows.filter(F.like("v", F.lit(contains_pattern(term)))), "v")
    assert sorted(got) == sorted(t for t in texts if like(f"%{term}%", t))
