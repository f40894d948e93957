"""Byte-pair encoding in numpy: merge rounds over many words at once.

The symbols of all words lie in one flat array. A round looks up every
neighbouring pair by binary search in the sorted keys of the known pairs,
takes for each word the pair of the lowest rank, and merges it wherever it
stands in that word. Words without a known pair drop out.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from forgeboard.llm import encoder
from forgeboard.llm.encoder import WordEncoder
from forgeboard.llm.frames import pick
from forgeboard.llm.text import gather

#: A word of more symbols is merged by itself, since it takes a round for each kind of pair in it.
LONG_WORD = 2048
NONE = np.iinfo(np.int64).max

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Bytes that print as Latin-1 stand for themselves, the others take the
    characters from 256 on in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merges of a byte-level BPE file as arrays."""

    def __init__(self, description: dict):
        model = description["model"]
        vocab = model["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in description.get("added_tokens", []))])
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.arange(len(pairs))[order], made[order]

        byte_of = {letter: b for b, letter in letters.items()}
        spelled = [b""] * self.size
        for token, number in vocab.items():
            spelled[number] = bytes(byte_of[c] for c in token)
        self.added = {t["content"]: t["id"] for t in description.get("added_tokens", [])}
        for content, number in self.added.items():
            spelled[number] = content.encode()
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    # -- encoding --------------------------------------------------------

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if it is not known) and its place among the keys."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE), at

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        spelled = [word.encode() for word in words]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        done: list[tuple[np.ndarray, np.ndarray]] = []  # word numbers and symbols
        for i in np.flatnonzero(sizes > LONG_WORD):
            ids = self._one_long(self.of_byte[np.frombuffer(spelled[i], np.uint8)])
            done.append((np.full(len(ids), i, np.int64), ids))
        short = np.flatnonzero(sizes <= LONG_WORD)
        symbols = self.of_byte[np.frombuffer(b"".join(spelled[i] for i in short), np.uint8)]
        word = np.repeat(short, sizes[short])
        while len(symbols):
            rank, at = self.look_up(symbols[:-1], symbols[1:])
            rank[word[:-1] != word[1:]] = NONE
            rank, at = np.append(rank, NONE), np.append(at, 0)
            opens = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lengths = np.diff(np.append(opens, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, opens), lengths)
            over = best == NONE
            if over.any():
                done.append((word[over], symbols[over]))
            chosen = (rank == best) & ~over
            # Of pairs that overlap, as in a run of one symbol, every second is merged.
            spots = np.flatnonzero(chosen)
            fresh = np.append(True, spots[1:] != spots[:-1] + 1) if len(spots) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(spots)), 0)) if len(spots) else spots
            spots = spots[(np.arange(len(spots)) - run) % 2 == 0]
            symbols[spots] = self.made[at[spots]]
            keep = ~over
            keep[spots + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        number = np.concatenate([w for w, _ in done])
        ids = np.concatenate([s for _, s in done])
        return ids[np.argsort(number, kind="stable")], np.bincount(number, minlength=len(words))

    def _one_long(self, symbols: np.ndarray) -> np.ndarray:
        """One long word, the next pair taken from a heap."""
        n = len(symbols)
        rank, at = self.look_up(symbols[:-1], symbols[1:])
        ids, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        known = [(int(r), i, ids[i], ids[i + 1], int(self.made[a])) for i, (r, a) in enumerate(zip(rank, at)) if r != NONE]
        heapq.heapify(known)

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                r, a = self.look_up(np.array([ids[i]]), np.array([ids[j]]))
                if r[0] != NONE:
                    heapq.heappush(known, (int(r[0]), i, ids[i], ids[j], int(self.made[a[0]])))

        while known:
            _, i, left, right, made = heapq.heappop(known)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([s for s in ids if s >= 0], np.int64)

    # -- decoding --------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ids spell; broken sequences become U+FFFD."""
        raw = gather(self.offsets[ids], self.lengths[ids], self.spelled).tobytes()
        return raw.decode("utf-8", "replace").encode()


@functools.cache
def merges(tokenizer: str) -> Merges:
    return Merges(encoder.description(tokenizer))


@functools.cache
def numpy_encoder(tokenizer: str) -> WordEncoder:
    """Encodes texts with the merge rounds of this module alone."""
    rules = merges(tokenizer)
    words: WordEncoder

    def whole(text: str) -> list[int]:
        """A text with special strings: what lies between them is encoded by itself."""
        import regex

        pattern = "|".join(regex.escape(s) for s in sorted(rules.added, key=len, reverse=True))
        found: list[int] = []
        for part in regex.split(f"({pattern})", text):
            if part in rules.added:
                found.append(rules.added[part])
            elif part:
                found += words.encode(pa.array([part], pa.large_string()))[0].tolist()
        return found

    words = WordEncoder(rules.encode_words, list(rules.added), whole, encoder.smallest_type(tokenizer))
    return words


def encode_decode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", keep: bool = False) -> DataFrame:
    """Encode every text and decode its ids again.

    Gives ``doc_id, n_tokens, ids_sha256`` (ids as little-endian unsigned
    32-bit integers) and ``decoded_sha256`` (the decoded text in UTF-8); with
    ``keep`` also ``ids`` and ``decoded`` themselves. Ids are those of the
    tokenizers library without added special tokens. Only files that
    ``encoder.is_byte_bpe`` knows are taken.

    A null text is encoded as an empty one, which has no ids. A null id stays
    null, repeated rows are encoded each, an empty table gives no rows.
    Nothing is shuffled, and a text is worked on in pieces of about 2 MB.
    """
    if not encoder.is_byte_bpe(tokenizer):
        raise ValueError(f"{tokenizer} is not a byte-level BPE file")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rules = numpy_encoder(tokenizer), merges(tokenizer)
        for batch in batches:
            flat, counts = words.encode(batch.column(1))
            ends = np.cumsum(counts)
            out: dict[str, list] = {name: [] for name in ("ids_sha256", "decoded_sha256", "ids", "decoded")}
            for start, end in zip((ends - counts).tolist(), ends.tolist()):
                ids = flat[start:end].astype("<u4")
                text = rules.decode(ids)
                out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
                if keep:
                    out["ids"].append(ids.astype(np.int64))
                    out["decoded"].append(text.decode())
            columns = [batch.column(0), pa.array(counts, pa.int64())]
            columns += [pa.array(out[n], pa.string()) for n in ("ids_sha256", "decoded_sha256")]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array(out["ids"], pa.list_(pa.int64())), pa.array(out["decoded"], pa.string())]
                names += ["ids", "decoded"]
            yield pa.record_batch(columns, names=names)

    narrow = pick(docs, "doc_id", "text")
    schema = SCHEMA + (", ids array<long>, decoded string" if keep else "")
    return narrow.select(narrow.doc_id.cast("long"), narrow.text.cast("string")).mapInArrow(both, schema)
