"""Address rules, found by their rarest word.

A rule is a pattern over an address without scheme, query and fragment
(``host/path``), with four special signs: ``||`` at its start stands for the
start of the host or of one of its parent domains, ``|`` at its start or end
for that end of the address, ``*`` for anything and ``^`` for a sign that is no
letter, digit, ``_``, ``-``, ``.`` or ``%``, or the end.

Words (runs of ASCII letters and digits) that every match of a rule must hold
whole are its literal tokens. How often they occur is counted over all
addresses; each rule is filed under the rarest of its own. An address looks up
its words, and only the rules filed under them run their regular expressions.
Rules without a literal token are candidates for every address.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeboard.llm.frames import pick

ALLOW, BLOCK = "allow", "block"
#: Rules that travel to the tasks together; more go in further groups, each a step of its own.
GROUP_RULES = 20_000
#: The verdict where no rule fits.
OTHERWISE = ALLOW

TOKEN = re.compile("[0-9a-z]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEPARATOR = r"(?:[^0-9A-Za-z_.%-]|\Z)"
ADDRESS = re.compile(r"(.*?)://([^/?#]*)([^?#]*)", re.DOTALL)


class Rule(NamedTuple):
    """``site`` rules name a host and the start of a path and overrule all others."""

    name: str
    pattern: str
    verdict: str
    site: bool = False


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and its subdomains where the path starts with ``path``."""
    return Rule(f"{host}{path}", f"||{host}{path}", verdict, True)


#: The rules of the named query. Fixed values.
SITE_RULES = (
    site_rule(ALLOW, "com", "/"),
    site_rule(BLOCK, "example.com", "/en/"),
    site_rule(ALLOW, "www.example.com", "/en/"),
    site_rule(BLOCK, "net", "/es/"),
    site_rule(BLOCK, "net", "/fr/"),
)
#: Rules of the method, for addresses that no site rule fits: hosts of spam, and pages
#: that hold no text of their own.
PATTERN_RULES = tuple(
    Rule(pattern, pattern, verdict)
    for verdict, patterns in {
        BLOCK: (
            "||spam-*", "||casino-*", "||cheap-*", "-pills.", "/wp-login.", "/wp-admin/", "/cgi-bin/", "/login^", "/cart^",
            "/search^",
        ),
        ALLOW: ("/spam-report^", "/help/search^"),
    }.items()
    for pattern in patterns
)


def parts(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of an address; both empty without ``://``."""
    found = ADDRESS.match(url) if url else None
    return (found[2].translate(LOWER), found[3]) if found else ("", "")


def expression(pattern: str) -> str:
    """The regular expression of a rule."""
    start = end = ""
    if pattern.startswith("||"):
        start, pattern = r"\A(?:[^/]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        start, pattern = r"\A", pattern[1:]
    if pattern.endswith("|"):
        end, pattern = r"\Z", pattern[:-1]
    signs = {"*": ".*", "^": SEPARATOR}
    return start + "".join(signs.get(c) or re.escape(c) for c in pattern) + end


def literal_tokens(pattern: str) -> list[str]:
    """Words that any address the rule fits must hold whole.

    A word at an open end of the pattern, or next to ``*``, may be part of a
    longer one and does not count.
    """
    closed_start = pattern.startswith("|")
    closed_end = pattern.endswith("|")
    inner = pattern.strip("|").translate(LOWER)
    found = []
    for word in TOKEN.finditer(inner):
        before = inner[word.start() - 1] if word.start() else ("|" if closed_start else "*")
        after = inner[word.end()] if word.end() < len(inner) else ("|" if closed_end else "*")
        if "*" not in (before, after):
            found.append(word[0])
    return found


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: Sequence[Rule], held: dict[str, int]):
        self.filed: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = [(r, re.compile(expression(r.pattern), re.DOTALL)) for r in rules]
        for number, rule in enumerate(rules):
            tokens = literal_tokens(rule.pattern)
            if tokens:
                self.filed.setdefault(min(tokens, key=lambda t: (held.get(t, 0), t)), []).append(number)
            else:
                self.always.append(number)

    def candidates(self, address: str) -> list[int]:
        found = list(self.always)
        for token in set(TOKEN.findall(address.translate(LOWER))):
            found += self.filed.get(token, ())
        return found

    def best(self, address: str) -> tuple[Rule | None, int]:
        """The rule that decides, and how many expressions ran."""
        tried = self.candidates(address)
        fits = [rule for rule, matches in (self.rules[i] for i in tried) if matches.search(address)]
        return max(fits, key=precedence, default=None), len(tried)


def precedence(rule: Rule) -> tuple:
    """Site rules before patterns, then the longer; of equal ones an allowing one, then by name."""
    return rule.site, len(rule.name), rule.verdict == ALLOW, rule.name


def token_counts(addresses: DataFrame, tokens: frozenset[str]) -> dict[str, int]:
    """In how many of all addresses each of the rules' tokens occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dict.fromkeys(tokens, 0)
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for token in tokens.intersection(TOKEN.findall("".join(parts(url)).translate(LOWER))):
                    held[token] += 1
        yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "held"])

    summed = addresses.mapInArrow(count, "token string, held long").groupBy("token").agg(F.sum("held").alias("held"))
    return {row["token"]: row["held"] for row in summed.collect()}  # one row for each token of the rules


JUDGED = "page_id long, url string, name string, pattern string, verdict string, site boolean, n_tried long"


def judge(
    pages: DataFrame, site_rules: Sequence[Rule] = SITE_RULES, pattern_rules: Sequence[Rule] = PATTERN_RULES
) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern, n_tried`` of every row of ``pages``.

    ``rule`` is the longest site rule that fits, null if none does. Its verdict
    counts; else that of the longest pattern rule that fits (``pattern``); else
    ``allow``. ``n_tried`` tells how many expressions ran.

    Null addresses and those without ``://`` have empty host and path and are
    allowed unless a rule fits the empty address. Null ids stay null, repeated
    rows are judged each, an empty table gives no rows. Only id and address are
    read, and nothing is shuffled but the counts of the rules' tokens.
    """
    rules = [*site_rules, *pattern_rules]
    tokens = frozenset(t for r in rules for t in literal_tokens(r.pattern))
    narrow = pick(pages, "page_id", "url").select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    held = token_counts(narrow.select("url"), tokens) if tokens else {}
    judged = narrow.select(
        "page_id", "url", *(F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in JUDGED.split(", ")[2:6])),
        F.lit(0).cast("long").alias("n_tried"),
    )
    for at in range(0, len(rules), GROUP_RULES):
        judged = judged.mapInArrow(_step(rules[at : at + GROUP_RULES], held), JUDGED)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = zip(*map(parts, batch["url"].to_pylist())) if len(batch) else ((), ())
            yield pa.record_batch(
                [batch["page_id"], pa.array(hosts, pa.string()), pa.array(paths, pa.string()), *(batch[c] for c in ("name", "pattern", "verdict", "site", "n_tried"))],
                names=["page_id", "host", "path", "name", "pattern", "verdict", "site", "n_tried"],
            )

    done = judged.mapInArrow(finish, JUDGED.replace("url string", "host string, path string"))
    return done.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("site"), F.col("name")).alias("rule"),
        F.coalesce("verdict", F.lit(OTHERWISE)).alias("verdict"),
        F.when(~F.col("site"), F.col("name")).alias("pattern"),
        "n_tried",
    )


def _step(rules: Sequence[Rule], held: dict[str, int]):
    """Judge by these rules; what a group before found stands unless one of these overrules it."""
    held = {t: held[t] for r in rules for t in literal_tokens(r.pattern) if t in held}
    rules = list(rules)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, held)
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            found = []
            for _, url, name, pattern, verdict, site, tried in zip(*columns):
                best, n = index.best("".join(parts(url)))
                before = None if name is None else Rule(name, pattern, verdict, site)
                first = max(filter(None, (before, best)), key=precedence, default=(None,) * 4)
                found.append((*first, tried + n))
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
            values = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), batch.column(1), *values], names=[f.split()[0] for f in JUDGED.split(", ")])

    return step
