"""Periodic runs of words: every maximal stretch that repeats a period at least four times.

All texts of a block lie in one sequence of word numbers, each closed by a
number of its own, so that no match passes the end of a text.

How far two places agree is answered from a difference cover: of ``PERIOD``
residues only those in ``COVER`` have their suffixes sorted, yet any two places
reach sampled ones after the same few words. Those few are compared one by
one; the rest is a minimum over the common prefixes of neighbours in suffix
order, from a sparse table.

Runs are found on a harmonic grid: a run of period q and length 4q or more
holds a place i that is a multiple of 3q together with i + q, wherever it
starts. So n / 3q places are asked for each q, n log n in all, and those where
the two words agree are extended to both sides.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeboard.llm.frames import pick
from forgeboard.llm.text import BLOCK_BYTES, by_bytes

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Residues whose differences give every residue. The perfect difference set of order 4.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: A run holds its period so often, and so many words.
LEAST_REPEATS, LEAST_WORDS = 4, 6
#: Grid places looked at together.
CHUNK = 1 << 20

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
)


def _shifts() -> np.ndarray:
    """For residues a, b the least shift that takes both into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    a = np.arange(PERIOD)
    both = inside[(a[:, None, None] + a) % PERIOD] & inside[(a[None, :, None] + a) % PERIOD]
    return both.argmax(axis=2).astype(np.int64)


SHIFTS = _shifts()


class CommonPrefixes:
    """How many words two places of ``x`` have in common from there on.

    ``x`` must end in numbers that occur nowhere else, so that matches end
    before it does. Space is linear in the sampled places times the logarithm
    of the longest repeat.
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x = np.concatenate([x, np.full(2 * PERIOD, -1, x.dtype)])
        inside = np.zeros(PERIOD, bool)
        inside[list(COVER)] = True
        places = np.flatnonzero(np.resize(inside, n))
        self.number = np.full(n + PERIOD, -1, np.int64)  # of a sampled place among the sampled
        self.number[places] = np.arange(len(places))
        ranks = self._sorted(places)
        self.rank = ranks[-1]
        order = np.argsort(self.rank, kind="stable")
        self.table = self._minima(self._neighbours(places, order, ranks))

    def _first_words(self, places: np.ndarray) -> np.ndarray:
        """Ranks of the sampled places by their first ``PERIOD`` words."""
        bits = max(1, int(self.x.max(initial=0) + 2).bit_length())
        each = max(1, 63 // bits)
        rank = None
        for at in range(0, PERIOD, each):
            key = np.zeros(len(places), np.int64)
            for k in range(at, min(at + each, PERIOD)):
                key = (key << bits) | (self.x[places + k].astype(np.int64) + 1)
            rank = _dense(key) if rank is None else _dense(rank * (1 << 32) + _dense(key))
        return rank

    def _sorted(self, places: np.ndarray) -> list[np.ndarray]:
        """Ranks by the first PERIOD, 2 PERIOD, 4 PERIOD, ... words, the last all different."""
        ranks = [self._first_words(places)]
        step = PERIOD
        while len(places) and int(ranks[-1].max()) + 1 < len(places) and step < len(self.x):
            after = places + step
            follows = np.where(after < len(self.number), self.number[np.minimum(after, len(self.number) - 1)], -1)
            then = np.where(follows >= 0, ranks[-1][follows] + 1, 0)
            ranks.append(_dense(ranks[-1] * (1 << 32) + then))
            step *= 2
        return ranks

    def _neighbours(self, places: np.ndarray, order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Common words of each sampled suffix and the next one in order."""
        a, b = places[order[:-1]].copy(), places[order[1:]].copy()
        held = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 2, -1, -1):
            i, j = self.number[np.minimum(a, len(self.number) - 1)], self.number[np.minimum(b, len(self.number) - 1)]
            same = (i >= 0) & (j >= 0) & (ranks[level][i] == ranks[level][j])
            step = PERIOD << level
            a[same] += step
            b[same] += step
            held[same] += step
        return held + self._few(a, b, np.full(len(a), PERIOD))[0]

    def _few(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in common, up to ``most``, compared one by one, and whether all of them were."""
        held = np.zeros(len(a), np.int64)
        left = np.flatnonzero(most > 0)
        while len(left):
            i, j = a[left] + held[left], b[left] + held[left]
            left = left[self.x[i] == self.x[j]]
            held[left] += 1
            left = left[held[left] < most[left]]
        return held, held == most

    @staticmethod
    def _minima(lowest: np.ndarray) -> list[np.ndarray]:
        table = [lowest.astype(np.int32)]
        while len(table[-1]) > 1 << (len(table) - 1):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from ``a`` and from ``b`` on, for arrays of different places."""
        shift = SHIFTS[a % PERIOD, b % PERIOD]
        held, reached = self._few(a, b, shift)
        go = np.flatnonzero(reached)
        if len(go):
            i = self.rank[self.number[a[go] + shift[go]]]
            j = self.rank[self.number[b[go] + shift[go]]]
            low, high = np.minimum(i, j), np.maximum(i, j)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            found = np.empty(len(go), np.int64)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                found[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
            held[go] += found
        return held


def _dense(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order of ``keys``, equal ones alike."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _grid(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, period and place in the text of all grid places, some texts' periods at a time."""
    texts = np.flatnonzero(lengths >= LEAST_WORDS)
    most = lengths[texts] // LEAST_REPEATS
    text = np.repeat(texts, most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    places = (lengths[text] - period - 1) // ((LEAST_REPEATS - 1) * period) + 1
    upto = np.cumsum(places)
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        p, count = period[at:stop], places[at:stop]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        p = np.repeat(p, count)
        yield np.repeat(text[at:stop], count), p, step * (LEAST_REPEATS - 1) * p
        at = stop


def find_runs(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in the text, length and smallest period of all runs, by text, start and period.

    ``words`` holds the word numbers, from 0, of all texts one after the other.
    """
    opens = np.cumsum(lengths + 1) - (lengths + 1)
    total = int((lengths + 1).sum())
    x = np.empty(total, np.int64)
    ends = opens + lengths
    inside = np.ones(total, bool)
    inside[ends] = False
    x[inside] = words
    x[ends] = int(words.max(initial=-1)) + 1 + np.arange(len(lengths))
    found = []
    there = back = None
    for text, period, place in _grid(lengths):
        i = opens[text] + place
        hit = np.flatnonzero(x[i] == x[i + period])
        if not len(hit):
            continue
        text, period, i = text[hit], period[hit], i[hit]
        if there is None:
            there = CommonPrefixes(x)
        after = there.of(i, i + period)
        # Backward from the words before; where the text opens there are none.
        # In the reversed sequence a text is closed by the number of the one before it.
        if back is None:
            back = CommonPrefixes(np.append(x[::-1], total + int(x.max()) + 1))
        before = np.zeros(len(i), np.int64)
        some = np.flatnonzero(i > opens[text])
        before[some] = back.of(total - 1 - (i[some] - 1), total - 1 - (i[some] + period[some] - 1))
        size = before + after + period
        whole = size >= np.maximum(LEAST_WORDS, LEAST_REPEATS * period)
        found.append(np.stack([text[whole], (i - before - opens[text])[whole], size[whole], period[whole]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    every = np.concatenate(found, axis=1)
    # A stretch is found by several places, and by multiples of its period.
    text, start, size, period = every[:, np.lexsort((every[3], every[2], every[1], every[0]))]
    fresh = np.append(True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (size[1:] != size[:-1]))[: len(text)]
    text, start, size, period = text[fresh], start[fresh], size[fresh], period[fresh]
    order = np.lexsort((period, start, text))
    return text[order], start[order], size[order], period[order]


def strongest(start: np.ndarray, size: np.ndarray, period: np.ndarray) -> int:
    """Where the run of the greatest size / period lies; of equal ones the first start, then period."""
    ratio = size / period
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9))
    best = int(near[0])
    for k in map(int, near[1:]):
        left, right = int(size[k]) * int(period[best]), int(size[best]) * int(period[k])
        if left > right or (left == right and (start[k], period[k]) < (start[best], period[best])):
            best = k
    return best


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place where the id asks for a text with a repeating tail."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def _block(ids: list, texts: list[str], tails: bool) -> dict[str, list]:
    lists = [WORD.findall(t) for t in texts]
    lengths = np.array([len(w) for w in lists], np.int64)
    opens = np.cumsum(lengths) - lengths
    if tails:
        for i, doc_id in enumerate(ids):
            which = repeated_tail(doc_id, len(lists[i]))
            if which is not None:
                lists[i] = [lists[i][k] for k in which.tolist()]
    flat = np.empty(int(lengths.sum()), object)
    for i, words in enumerate(lists):
        flat[opens[i] : opens[i] + lengths[i]] = words
    text, start, size, period = find_runs(pd.factorize(flat)[0].astype(np.int64), lengths)

    marks = np.zeros(len(flat) + 1, np.int64)
    np.add.at(marks, opens[text] + start + period, 1)
    np.add.at(marks, opens[text] + start + size, -1)
    kept = np.cumsum(marks)[:-1] == 0
    low, high = (np.searchsorted(text, np.arange(len(texts)), side) for side in ("left", "right"))
    rows: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
    for i, doc_id in enumerate(ids):
        s, e, q = start[low[i] : high[i]], size[low[i] : high[i]], period[low[i] : high[i]]
        own = kept[opens[i] : opens[i] + lengths[i]]
        dropped = int(lengths[i] - own.sum())
        words = lists[i] if not dropped else [lists[i][k] for k in np.flatnonzero(own).tolist()]
        best = strongest(s, e, q) if len(s) else None
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), e.tolist(), q.tolist()))
        values = (
            doc_id,
            len(s),
            *((None,) * 4 if best is None else (int(s[best]), int(e[best]), int(q[best]), 1000 * int(e[best]) // int(q[best]))),
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(" ".join(words).encode()).hexdigest(),
            int(lengths[i]),
            dropped,
        )
        for column, value in zip(rows.values(), values):
            column.append(value)
    return rows


def periodic_runs(docs: DataFrame, tails: bool = False) -> DataFrame:
    """The runs of words of every row of ``docs``: how many, the strongest, and digests of all of them.

    Words part at space, tab and the four controls after it. A run has a
    smallest period q, at least ``max(6, 4 q)`` words, and no neighbouring word
    that keeps the period. ``start, length, period, exponent_milli`` are those
    of the run with the greatest exact length / period (ties: smallest start,
    then period), null without a run. ``runs_sha256`` covers all runs as lines
    ``start,length,period``, ``collapsed_sha256`` the text without the words
    that a run repeats, one space apart.

    ``tails`` first gives a text whose id asks for it a repeating tail (see
    ``repeated_tail``), as a check with known runs.

    A null text has no words: no runs, both digests those of nothing. A null
    id stays null and asks for no tail; repeated rows are answered each, an
    empty table gives no rows. Texts are taken whole, about 1 MB together; a
    longer one is a block of its own. Nothing is shuffled.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"doc_id": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
        for batch in batches:
            for start, stop in by_bytes(batch.column(1), BLOCK_BYTES):
                part = batch.slice(start, stop - start)
                rows = _block(part.column(0).to_pylist(), part.column(1).fill_null("").to_pylist(), tails)
                yield pa.record_batch(
                    [pa.array(v, types.get(name, pa.int64())) for name, v in rows.items()], names=list(rows)
                )

    narrow = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(answer, SCHEMA)
