"""Token ids of whole texts, with each distinct word encoded once.

A byte-level BPE cuts a text into words and encodes each by itself, so the
ids of a text are those of its words. The words are found with array
operations and known by a 64-bit hash. Within a block all words of a hash are
compared letter by letter; with the words kept from earlier blocks by a second
hash. How a word is encoded is left to the ``cold`` function given.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from forgeboard.llm.text import (
    BLOCK_BYTES,
    LETTER,
    SPACE,
    all_alike,
    by_bytes,
    classes,
    distinct,
    flat,
    gather,
    safe_pieces,
    word_hashes,
)

#: Words kept encoded in a worker; beyond it the store starts anew.
KEPT_WORDS = 800_000
#: Contractions that the pattern of byte-level BPE keeps as words of their own. Fixed values.
ONE_LETTER = (ord("s"), ord("t"), ord("m"), ord("d"))
TWO_LETTERS = ((ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l")))

Cold = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the words of byte-level BPE start, in all texts at once.

    A word is a run of letters, of numbers or of other characters, with one
    space before it; white space that is left over is a word; so are the
    contractions after an apostrophe.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    starts = first[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # The last of several blanks before a word is apart from the others, and
    # a space there belongs to the word.
    last_blank = np.zeros(n, bool)
    last_blank[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]
    starts |= last_blank
    joined = np.flatnonzero(last_blank & (points == 32))
    starts[joined + 1] = False

    quotes = np.flatnonzero((points == 39) & starts)
    if len(quotes):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        here = ~first[quotes + 1]
        single = here & np.isin(one, ONE_LETTER)
        double = np.zeros(len(quotes), bool)
        for a, b in TWO_LETTERS:
            double |= (one == a) & (two == b)
        double &= here & ~first[np.minimum(quotes + 2, n)]
        for found, size in ((quotes[single], 1), (quotes[double], 2)):
            starts[found + 1] = False
            after = found + 1 + size
            after = after[after < n]
            starts[after[(kind[after] == LETTER) & ~first[after]]] = True
    return np.flatnonzero(starts)


class WordEncoder:
    """Encodes texts through their words.

    ``special`` are strings that the library finds in texts before anything
    else; a text that holds one is encoded by ``whole``.
    """

    def __init__(self, cold: Cold, special: list[str], whole: Callable[[str], list[int]], dtype=np.uint32):
        self.cold, self.special, self.whole, self.dtype = cold, special, whole, dtype
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, np.uint64)  # sorted hashes of the words in the store
        self._places = np.zeros(0, np.int64)  # and the place of each
        self._checks = np.zeros(0, np.uint64)  # second hashes of the words by place
        self._offsets = np.zeros(0, np.int64)
        self._lengths = np.zeros(0, np.int64)
        self._ids = np.zeros(0, self.dtype)

    def _numbers(self, hashes: np.ndarray, checks: np.ndarray, word: Callable[[int], str]) -> np.ndarray:
        """The place of each of these different words in the store; new words are encoded."""
        if len(self._offsets) > KEPT_WORDS:
            self._forget()
        at = np.searchsorted(self._known, hashes)
        taken = np.zeros(len(hashes), bool)  # by some word of this hash
        inside = at < len(self._known)
        taken[inside] = self._known[at[inside]] == hashes[inside]
        numbers = np.full(len(hashes), -1, np.int64)
        numbers[taken] = self._places[at[taken]]
        numbers[taken] = np.where(self._checks[numbers[taken]] == checks[taken], numbers[taken], -1)
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            ids, lengths = self.cold([word(i) for i in fresh.tolist()])
            numbers[fresh] = len(self._offsets) + np.arange(len(fresh))
            self._offsets = np.concatenate([self._offsets, len(self._ids) + np.cumsum(lengths) - lengths])
            self._lengths = np.concatenate([self._lengths, lengths])
            self._checks = np.concatenate([self._checks, checks[fresh]])
            self._ids = np.concatenate([self._ids, ids.astype(self.dtype)])
            fresh = fresh[~taken[fresh]]  # a second word of a hash is encoded each time
            fresh = fresh[np.argsort(hashes[fresh])]
            self._known = np.insert(self._known, at[fresh], hashes[fresh])
            self._places = np.insert(self._places, at[fresh], numbers[fresh])
        return numbers

    def _block(self, column: pa.Array, count_only: bool) -> tuple[np.ndarray | None, np.ndarray]:
        points, at, joined = flat(column)
        starts = word_starts(points, at)
        ends = np.append(starts[1:], len(points)).astype(np.int64)
        # A word also ends where its text does; the next text starts a word there.
        hashes = word_hashes(points, starts, ends)
        codes, first = distinct(hashes)
        if not all_alike(points, starts, ends, first[codes]):  # two words of one hash
            codes = first = np.arange(len(starts))
        numbers = self._numbers(
            hashes[first],
            word_hashes(points, starts[first], ends[first], seed=1),
            lambda i: joined[starts[first[i]] : ends[first[i]]],
        )
        lengths = self._lengths[numbers][codes]
        upto = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=upto[1:])
        counts = np.diff(upto[np.searchsorted(starts, at)])
        if count_only:
            return None, counts
        return gather(self._offsets[numbers][codes], lengths, self._ids), counts

    def encode(self, column: pa.Array, count_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of all texts one after the other (None if only counted), and how many each has."""
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        column = column.cast(pa.large_string()).fill_null("")
        for start, stop in by_bytes(column):
            block = column.slice(start, stop - start)
            odd = self._odd(block)
            if stop - start == 1 and not odd and len(text := block[0].as_py()) > BLOCK_BYTES // 2:
                total = 0
                for piece in safe_pieces(text, BLOCK_BYTES // 2):
                    ids, n = self._block(pa.array([piece], pa.large_string()), count_only)
                    total += int(n.sum())
                    parts += [] if count_only else [ids]
                counts.append(np.array([total]))
                continue
            if not odd:
                ids, n = self._block(block, count_only)
                counts.append(n)
                parts += [] if count_only else [ids]
                continue
            for i in range(len(block)):  # texts with special strings go to the library, one by one
                if i in odd:
                    ids = np.asarray(self.whole(block[i].as_py()), self.dtype)
                    n = np.array([len(ids)])
                else:
                    ids, n = self._block(block.slice(i, 1), count_only)
                counts.append(n)
                parts += [] if count_only else [ids]
        lengths = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if count_only:
            return None, lengths
        return (np.concatenate(parts) if parts else np.zeros(0, self.dtype)), lengths

    def _odd(self, block: pa.Array) -> set[int]:
        import pyarrow.compute as pc

        found: set[int] = set()
        for text in self.special:
            found |= set(np.flatnonzero(pc.match_substring(block, text).to_numpy(zero_copy_only=False)).tolist())
        return found


def place(name: str) -> str:
    """A tokenizer file: a path, or the name of a public one."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def quiet() -> None:
    """One thread a task: Spark already runs a task on every core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


@functools.cache
def library(name: str):
    quiet()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(place(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.cache
def description(name: str) -> dict:
    with open(place(name), encoding="utf-8") as file:
        return json.load(file)


def is_byte_bpe(name: str) -> bool:
    """Whether a file is the kind whose words this module knows how to find."""
    if not name.endswith(".json"):
        return False
    whole = description(name)
    before = whole.get("pre_tokenizer") or {}
    return (
        whole["model"]["type"] == "BPE"
        and not whole.get("normalizer")
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and all(
            not (t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"])
            for t in whole.get("added_tokens", [])
        )
    )


def smallest_type(name: str):
    whole = description(name)
    ids = [*whole["model"]["vocab"].values(), *(t["id"] for t in whole.get("added_tokens", []))]
    return np.uint16 if max(ids) < 1 << 16 else np.uint32


@functools.cache
def encoder(name: str) -> WordEncoder:
    """A word encoder in which the tokenizers library encodes the words."""
    tokenizer = library(name)

    def cold(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), lengths

    return WordEncoder(
        cold,
        [t["content"] for t in description(name).get("added_tokens", [])],
        lambda text: tokenizer.encode(text, add_special_tokens=False).ids,
        smallest_type(name),
    )
