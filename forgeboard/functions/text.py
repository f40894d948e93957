"""Case folding and substring patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def same_folded(column: Column, value: str) -> Column:
    """Equality that ignores case."""
    return F.lower(column) == F.lower(F.lit(value))


def collated(name: str, collation: str | None) -> Column:
    """A sort key for a text column: binary order, or that of a named collation."""
    return F.col(name) if collation is None else F.collate(F.col(name), collation)


def contains_pattern(term: str) -> str:
    r"""LIKE pattern for "holds ``term``", with ``%`` and ``_`` left live.

    A backslash makes the next character literal. Spark accepts an escape only
    before ``%``, ``_`` and ``\``; before any other character the backslash
    changes nothing and is dropped. A term that ends in one backslash turns
    the closing ``%`` into a literal percent sign.
    """

    def unescape(match: re.Match[str]) -> str:
        return match.group(0) if match.group(1) in "%_\\" else match.group(1)

    return _ESCAPED.sub(unescape, f"%{term}%")


def literal_runs(pattern: str) -> list[str]:
    """The stretches of a LIKE pattern that a match holds letter by letter."""
    runs, escaped = [""], False
    for letter in pattern:
        if not escaped and letter == "\\":
            escaped = True
            continue
        if not escaped and letter in "%_":
            runs.append("")
        else:
            runs[-1] += letter
        escaped = False
    return [run for run in runs if run]


def contains(column: Column, term: str) -> Column:
    """Case-sensitive match of ``%term%``."""
    return F.like(column, F.lit(contains_pattern(term)))


def contains_folded(column: Column, term: str) -> Column:
    """Match of ``%term%`` that ignores case."""
    return F.like(F.lower(column), F.lower(F.lit(contains_pattern(term))))
