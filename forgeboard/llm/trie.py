"""Phrases of word numbers as a double-array trie that many places of a text walk at once.

A word number is spelled in bytes, so a state has at most 256 followers. State
t follows s by sign c where ``base[s] + c == t`` and ``check[t] == s``. All
places take a step together: one look into ``base`` and one into ``check``.
"""

from __future__ import annotations

import numpy as np

SIGNS = 256
#: States with so many followers get a stretch of their own.
WIDE = 32
#: Rounds in which states try places at random, before they get a stretch of their own too.
ROUNDS = 60


def digits_for(words: int) -> int:
    """Bytes that spell the numbers below ``words``."""
    return max(1, (max(1, words - 1).bit_length() + 7) // 8)


class DoubleArray:
    """The rows of ``phrases``, word numbers of one length each, which must differ and be sorted.

    It is built where the driver runs, so in small types.
    """

    def __init__(self, phrases: np.ndarray, digits: int):
        self.size, self.width = phrases.shape
        self.digits = digits
        signs = phrases.astype(">u4").view(np.uint8).reshape(self.size, self.width, 4)[:, :, 4 - digits :]
        signs = signs.reshape(self.size, self.width * digits)
        parent, sign, leaves = _edges(signs)
        slots, base = _place(parent, sign, 1 + len(parent))
        # Node numbers become places in the arrays; the root has place 0.
        length = int(slots.max(initial=0)) + SIGNS + 1
        place = np.append(np.int32(0), slots)
        self.base = np.zeros(length, np.int32)
        self.check = np.full(length, -1, np.int32)
        self.number = np.full(length, -1, np.int32)
        self.base[place] = base
        self.check[slots] = place[parent]
        self.number[place[leaves]] = np.arange(self.size, dtype=np.int32)

    def walk(self, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The number of the phrase that starts at each place, -1 where none does.

        ``words`` are word numbers, negative where no word stands.
        """
        found = np.full(len(places), -1, np.int64)
        left = np.flatnonzero(places + self.width <= len(words)) if self.size else np.zeros(0, np.int64)
        state = np.zeros(len(left), np.int64)
        for step in range(self.width):
            word = words[places[left] + step].astype(np.int64)
            known = word >= 0
            left, state, word = left[known], state[known], word[known]
            for digit in range(self.digits - 1, -1, -1):
                after = self.base[state] + ((word >> (8 * digit)) & (SIGNS - 1))
                there = self.check[after] == state
                left, state, word = left[there], after[there], word[there]
        found[left] = self.number[state]
        return found


def _edges(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent and sign of the nodes 1, 2, ... (0 is the root), by parent, and the last node of every row."""
    size, depth = signs.shape
    fresh = np.ones(size, bool)  # whether a row leaves the one before up to this depth
    if size:
        fresh[1:] = False
    above = np.zeros(size, np.int32)
    parents, kept, made = [], [], 0
    for d in range(depth):
        fresh[1:] |= signs[1:, d] != signs[:-1, d]
        node = np.cumsum(fresh, dtype=np.int32) + np.int32(made)
        parents.append(above[fresh])
        kept.append(signs[fresh, d])
        above, made = node, made + int(fresh.sum())
    return np.concatenate(parents), np.concatenate(kept), above


def _place(parent: np.ndarray, sign: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of every edge's node, and the base of every node."""
    base = np.zeros(nodes, np.int32)
    if not len(parent):
        return np.zeros(0, np.int32), base
    opens = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
    owners, counts = parent[opens], np.diff(opens, append=len(parent))
    limit = 2 * len(parent) + 2 * SIGNS
    free = np.ones(limit + SIGNS, bool)
    free[0] = False
    claim = np.zeros(limit + SIGNS, np.int32)  # the last edge that tried a place
    lots = np.random.default_rng(len(parent))
    late = [np.flatnonzero(counts >= WIDE)]
    for low, high in ((16, WIDE), (8, 16), (4, 8), (2, 4), (1, 2)):
        left = np.flatnonzero((counts >= low) & (counts < high))
        for _ in range(ROUNDS):
            if not len(left):
                break
            tried = lots.integers(1, limit, len(left), dtype=np.int32)
            edges, of = _stretches(opens[left], counts[left])
            at = tried[of] + sign[edges]
            claim[at] = np.arange(len(at), dtype=np.int32)
            alone = claim[at] == np.arange(len(at), dtype=np.int32)
            fits = np.ones(len(left), bool)
            fits[of[~(alone & free[at])]] = False
            base[owners[left[fits]]] = tried[fits]
            free[at[fits[of]]] = False
            left = left[~fits]
        late.append(left)
    beyond = np.concatenate(late)
    base[owners[beyond]] = limit + SIGNS * (1 + np.arange(len(beyond)))
    return base[parent] + sign, base


def _stretches(opens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the edges that start at ``opens``, and which stretch each is of."""
    of = np.repeat(np.arange(len(opens)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + opens[of], of
