"""Which logins a collection run should visit."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spellings a location is searched by.
LOCATIONS = ("St. Louis", "STL", "St Louis", "Saint Louis")

# The source shows at most ten pages of a hundred; more than nine full pages
# in one window means rows may be missing.
WINDOW_CEILING = 900


class CreationWindow(NamedTuple):
    """Creation dates from ``first`` to ``last``, both included; None leaves an end open."""

    label: str
    first: date | None
    last: date | None

    def holds(self, created: Column) -> Column:
        # An open end excludes the day the neighbouring window begins or ends on.
        if self.first is None:
            return created < F.lit(self.last)
        if self.last is None:
            return created > F.lit(self.first)
        return created.between(F.lit(self.first), F.lit(self.last))


def yearly_windows(first_year: int = 2013, last_year: int = 2025) -> list[CreationWindow]:
    """Before the first year, each year up to and including the next New Year, after the last."""
    new_years = [date(y, 1, 1) for y in range(first_year, last_year + 1)]
    inner = [CreationWindow(f"{a}..{b}", a, b) for a, b in zip(new_years, new_years[1:])]
    return [
        CreationWindow(f"<{new_years[0]}", None, new_years[0]),
        *inner,
        CreationWindow(f">{new_years[-1]}", new_years[-1], None),
    ]


def _matching(profiles: DataFrame, locations: Sequence[str]) -> DataFrame:
    place = F.lower("location")
    near = reduce(lambda a, b: a | b, [F.contains(place, F.lower(F.lit(l))) for l in locations])
    return profiles.filter(
        (F.lower("type") == "user") & (F.col("public_repos") > 1) & near
    ).select("login", F.to_date("created_at").alias("created"))


def candidate_logins(
    profiles: DataFrame,
    seeds: DataFrame,
    locations: Sequence[str] = LOCATIONS,
    windows: Sequence[CreationWindow] | None = None,
) -> DataFrame:
    """Distinct logins found by location and creation date, and the seed logins."""
    windows = yearly_windows() if windows is None else windows
    in_any = reduce(lambda a, b: a | b, [w.holds(F.col("created")) for w in windows])
    found = _matching(profiles, locations).filter(in_any).select("login")
    given = seeds.select("login").filter(F.col("login") != "")
    return found.unionByName(given).dropDuplicates(["login"])


def candidate_window_counts(
    profiles: DataFrame,
    locations: Sequence[str] = LOCATIONS,
    windows: Sequence[CreationWindow] | None = None,
    cap: int = WINDOW_CEILING,
) -> DataFrame:
    """``(window, candidates, near_ceiling)`` for windows with any candidate.

    Windows share their boundary days, so a profile lies in one or two. The
    window list is folded into the expression, which replaces a range join.
    """
    windows = yearly_windows() if windows is None else windows
    labels = F.array_compact(
        F.array(*[F.when(w.holds(F.col("created")), F.lit(w.label)) for w in windows])
    )
    return (
        _matching(profiles, locations)
        .select("login", F.explode(labels).alias("window"))
        .groupBy("window")
        .agg(F.count_distinct("login").alias("candidates"))
        .withColumn("near_ceiling", F.col("candidates") > cap)
    )


def _halved(
    first: date, last: date, days: list[date], upto: list[int], cap: int
) -> list[tuple[date, date, int]]:
    """A window cut in halves until no part holds more than ``cap`` or spans more than a day."""
    open_parts, done = [(first, last)], []
    while open_parts:
        a, b = open_parts.pop()
        held = upto[bisect_right(days, b)] - upto[bisect_left(days, a)]
        if held > cap and a < b:
            middle = a + timedelta(days=(b - a).days // 2)
            open_parts += [(middle + timedelta(days=1), b), (a, middle)]
        elif held:
            done.append((a, b, held))
    return done


def candidate_split_windows(
    profiles: DataFrame,
    locations: Sequence[str] = LOCATIONS,
    windows: Sequence[CreationWindow] | None = None,
    cap: int = WINDOW_CEILING,
) -> DataFrame:
    """``(window, first, last, candidates, near_ceiling)``: windows cut until each shows all its candidates.

    A window with more than ``cap`` candidates is halved by days until no
    part has more; a single day that still has is marked. Windows may overlap
    and leave gaps, and there may be any number of them. Parts without
    candidates are left out; open ends reach to the first or last day of any
    candidate. A login counts on the earliest day given for it.

    Candidates are counted by day first. One row a calendar day reaches the
    driver at most, where every window, and every half, is two lookups in sorted days.
    """
    windows = yearly_windows() if windows is None else windows
    by_day = (
        _matching(profiles, locations)
        .groupBy("login")
        .agg(F.min("created").alias("created"))
        .filter("created IS NOT NULL")
        .groupBy("created")
        .agg(F.count("*").alias("candidates"))
        .orderBy("created")
        .collect()
    )
    days = [row["created"] for row in by_day]
    upto = [0]
    for row in by_day:
        upto.append(upto[-1] + row["candidates"])
    parts = []
    for window in windows if days else ():
        first = days[0] if window.first is None else window.first + timedelta(days=window.last is None)
        last = days[-1] if window.last is None else window.last - timedelta(days=window.first is None)
        if first <= last:
            parts += [
                (window.label, a.isoformat(), b.isoformat(), n, n > cap)
                for a, b, n in _halved(first, last, days, upto, cap)
            ]
    return profiles.sparkSession.createDataFrame(
        parts, "window string, first string, last string, candidates long, near_ceiling boolean"
    )
