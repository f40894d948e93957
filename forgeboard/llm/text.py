"""Texts of an Arrow batch as one flat array of code points, and words in it."""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Single allocations from this size on, and unused memory beyond it, go back to the system at once.
RETURNED_BYTES = 1 << 25


def return_memory() -> None:
    """Let a reused worker keep no more memory than it uses.

    The working arrays of a task are large and short-lived; left to itself the
    C library keeps them, and Arrow its buffers, for the life of the worker.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        allocator = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # a C library without this knob
        return
    for parameter in (-1, -3):  # M_TRIM_THRESHOLD and M_MMAP_THRESHOLD
        allocator(parameter, RETURNED_BYTES)


return_memory()

#: Classes of characters.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Bytes of text taken at a time; with it go the working arrays of a task.
BLOCK_BYTES = 1 << 20


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library sees it."""
    from tokenizers import Regex, pre_tokenizers

    found = np.zeros(0x110000, np.uint8)
    size = 0x800  # the time taken grows faster than the text
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        # Splitting by what the pattern leaves out gives the runs it matches.
        split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
        for low in range(0, 0x110000, size):
            if low != 0xD800:  # surrogates are no characters
                for _, (start, end) in split.pre_tokenize_str("".join(map(chr, range(low, low + size)))):
                    found[low + start : low + end] = kind
    return found


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, str]:
    """Code points of all texts, where each text starts (and the end), and the joined text.

    Null counts as an empty text.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64), ""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    joined = raw.tobytes().decode("utf-8")
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return points, before[at - at[0]], joined


def byte_lengths(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.diff(at)


def by_bytes(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text is a range of its own."""
    ends = np.cumsum(byte_lengths(column))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield start, stop
        start = stop


def safe_pieces(text: str, most: int) -> Iterator[str]:
    """Cut a long text before spaces that follow an ASCII letter or digit.

    Words with their leading space, as byte-level tokenizers form them, and
    special strings without spaces are never cut there, so the pieces encode
    to what the whole text does. A stretch without such a place stays whole.
    """
    start = 0
    while len(text) - start > most:
        at = text.find(" ", start + most)
        while at > 0 and not (text[at - 1].isascii() and text[at - 1].isalnum()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


#: Words of more code points are hashed by their bytes, one by one.
LONG_WORD = 33
#: Code points that fit into 64 bits, 21 bits each.
_TOGETHER = 3


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the stretches ``points[start:end]``.

    Three code points at a time go through a mixing step that maps no two
    values to one, so words of up to three are told apart for certain. Long
    words have a cryptographic hash of all their code points.
    """
    sizes = ends - starts
    h = np.full(len(starts), (0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded = np.concatenate([points, np.zeros(_TOGETHER, points.dtype)]).astype(np.uint64) + np.uint64(1)
    left = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    at, rest = starts[left], sizes[left]
    while len(left):
        packed = padded[at]
        for k in range(1, _TOGETHER):
            packed |= np.where(k < rest, padded[at + k], np.uint64(0)) << np.uint64(21 * k)
        h[left] = mix(h[left] ^ packed)
        more = rest > _TOGETHER
        left, at, rest = left[more], at[more] + _TOGETHER, rest[more] - _TOGETHER
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        raw = points[starts[i] : ends[i]].astype("<u4", copy=False).tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=key).digest(), "little")
    return h


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash the number of its kind, and for each kind where it occurs first."""
    codes, kinds = pd.factorize(hashes)
    first = np.empty(len(kinds), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, first


def all_alike(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each stretch holds the same code points as the stretch of number ``like``."""
    sizes = ends - starts
    return bool(
        (sizes == sizes[like]).all()
        and (gather(starts, sizes, points) == gather(starts[like], sizes, points)).all()
    )


def runs(inside: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches where ``inside`` holds, none across texts."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


#: Characters that part words: space and the five controls from tab on.
WORD_BREAKS = np.zeros(0x110000, bool)
WORD_BREAKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def plain_words(points: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the words between WORD_BREAKS."""
    starts, ends = runs(~WORD_BREAKS[points], text_starts)
    return starts, ends, np.searchsorted(text_starts, starts, "right") - 1


def gather(offsets: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The stretches ``values[offset:offset + length]`` one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(offsets - (ends - lengths), lengths) + np.arange(total)]
