"""Checks on caller-supplied parameters."""

from __future__ import annotations

SORT_KEYS = ("stars", "forks", "followers", "public_repos")
PAGE_SIZE = 25


class ParameterError(ValueError):
    """A parameter a caller may not pass."""


def sort_key(name: str | None) -> str:
    """A listed sort key; anything else means stars."""
    return name if name in SORT_KEYS else "stars"


def page_bounds(limit: int | None, offset: int | None) -> tuple[int, int]:
    """Page size and start. Absent ones mean a full page from the first."""
    limit = PAGE_SIZE if limit is None else limit
    offset = 0 if offset is None else offset
    if not 1 <= limit <= PAGE_SIZE:
        raise ParameterError(f"limit must lie between 1 and {PAGE_SIZE}, got {limit}")
    if offset < 0:
        raise ParameterError(f"offset must not be negative, got {offset}")
    return limit, offset
