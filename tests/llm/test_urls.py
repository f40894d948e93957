"""Address rules against running every rule on every address."""

from __future__ import annotations

import random

import pytest

from forgeboard.llm import urls
from forgeboard.llm.frames import prepare

PAGES = "page_id long, url string, html string, HOST string, rule long"
RULES = [*urls.SITE_RULES, *urls.PATTERN_RULES]
ADDRESSES = [
    "http://a.example.com/en/1?x=/fr/",
    "HTTPS://WWW.Example.COM/en/2#top",
    "https://www.example.com/EN/2",
    "https://badexample.com/en/2",
    "http://x.net/es/3",
    "http://x.net/esx/3",
    "http://net/fr/",
    "http://x.com",
    "http://x.com?/",
    "http://x.com:80/a",
    "http://spam-farm.example.org/en/7",
    "http://www.cheap-pills.example.org/",
    "http://a.org/login",
    "http://a.org/login.html",
    "http://a.org/login-now/",
    "http://a.org/help/search?q=1",
    "http://a.org/search/x",
    "http://a.org/x://b.net/es/",
    "://",
    "no scheme/en/",
    "ftp://ÉXAMPLE.net/fr/ü\nnext",
    "",
    None,
]


def plain(url):
    """Every site rule by its own words, then every pattern."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        address = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        host, slash, path = address.partition("/")
        path = slash + path
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for name, verdict in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")):
        of, slash, start = name.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + start):
            fits.append((len(name), name, verdict))
    if fits:
        _, name, verdict = max(fits)
        return host, path, name, verdict
    import re

    hits = [r for r in urls.PATTERN_RULES if re.search(urls.expression(r.pattern), host + path, re.DOTALL)]
    return host, path, None, max(hits, key=urls.precedence).verdict if hits else "allow"


def pages(spark, addresses):
    prepare(spark)
    rows = [(i, u, "<p>", "h", 1) for i, u in enumerate(addresses)]
    return spark.createDataFrame([*rows, *rows[:2], (None, addresses[0], None, None, None)], PAGES)


def test_judge(spark):
    got = urls.judge(pages(spark, ADDRESSES)).collect()
    assert len(got) == len(ADDRESSES) + 3
    for row in got:
        want = plain(ADDRESSES[row.page_id or 0])
        assert (row.host, row.path, row.rule, row.verdict) == want, ADDRESSES[row.page_id or 0]
    assert {r.pattern for r in got if r.page_id in (10, 11, 12, 13, 15)} == {"||spam-*", "||cheap-*", "/login^", None, "/help/search^"}
    assert urls.judge(pages(spark, ADDRESSES).limit(0)).count() == 0


def test_groups_of_rules_give_the_same(spark, monkeypatch):
    table = pages(spark, ADDRESSES)
    whole = sorted(urls.judge(table).drop("n_tried").collect(), key=str)
    monkeypatch.setattr(urls, "GROUP_RULES", 4)
    assert sorted(urls.judge(table).drop("n_tried").collect(), key=str) == whole
    assert {r.verdict for r in urls.judge(table, (), ()).collect()} == {"allow"}


def test_index_loses_no_rule():
    rng = random.Random(3)
    signs = ["a", "b", "ab", "1", "-", ".", "/", "_", "é", "A"]

    def pattern():
        inner = "".join(rng.choices([*signs, "*", "^"], k=rng.randint(1, 6)))
        return rng.choice(["||", "|", "", ""]) + inner + rng.choice(["|", "", ""])

    rules = [urls.Rule(p, p, "block") for p in {pattern() for _ in range(600)}]
    held = {"a": 9, "b": 3, "ab": 5}
    index = urls.Index(rules, held)
    for _ in range(400):
        address = "".join(rng.choices(signs, k=rng.randint(0, 12)))
        want = {r.name for r, e in index.rules if e.search(address)}
        tried = {rules[i].name for i in index.candidates(address)}
        assert want <= tried
    assert 0 < len(index.always) < len(rules)


def test_rules_are_filed_under_their_rarest_token(spark):
    table = pages(spark, ["http://a.example.com/en/1", "http://b.example.com/fr/2", "http://c.example.org/en/3"])
    held = urls.token_counts(table.select("url"), frozenset({"example", "com", "en", "www"}))
    assert held == {"example": 6, "com": 5, "en": 4, "www": 0}
    index = urls.Index(urls.SITE_RULES[1:3], held)
    assert index.filed == {"en": [0], "www": [1]}
    assert index.candidates("x.example.com/fr/") == []


def test_expression_signs():
    fits = lambda pattern, address: urls.re.search(urls.expression(pattern), address) is not None
    assert fits("||b.c/", "a.b.c/") and fits("||b.c/", "b.c/") and not fits("||b.c/", "ab.c/") and not fits("||b.c/", "x/a.b.c/")
    assert fits("|b.c", "b.cd") and not fits("|b.c", "a.b.c") and fits("d|", "c/d") and not fits("d|", "d/")
    assert fits("a*z^", "a..z") and fits("a*z^", "az/") and not fits("a*z^", "az9")


@pytest.mark.parametrize("pattern, tokens", [("ads", []), ("/ads/", ["ads"]), ("|ads^", ["ads"]), ("/a*b/c.d|", ["c", "d"]), ("*", [])])
def test_literal_tokens(pattern, tokens):
    assert urls.literal_tokens(pattern) == tokens
