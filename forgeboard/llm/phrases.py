"""Collocations: phrases whose words stand together far more often than apart.

Levels of Apriori: a phrase of k words can only be frequent where its first
and its last k - 1 words are. Texts become arrays of word numbers once, the
numbers of frequent words only. Each level then looks at the places where two
frequent shorter phrases overlap:

1. The pairs (shorter phrase, next word) are numbered, spread evenly over the
   numbers of so many bits, and counted. What a task hands on are its numbers
   in order, as gaps, packed by block of numbers; a block's are added up.
2. The pairs with the support are the candidates. They go into double-array
   tries of a bounded size, each of a range of first words, and are broadcast.
3. All places of an array walk the trie of their first word together, level by
   level; the places where a phrase is accepted are counted by number, and the
   counts of all tasks added.

The bounds are on what a task holds at once (words and candidates in a
broadcast); more of them mean further tries, which a task reads one after the
other for the texts it holds, not fewer rows and no further Python workers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeboard.llm.frames import pick
from forgeboard.llm.text import BLOCK_BYTES, all_alike, by_bytes, distinct, flat, mix, runs, word_hashes
from forgeboard.llm.trie import DoubleArray, digits_for
from forgeboard.session import Stage, shared_dir, stage_in

#: Words whose numbers a task holds at once, and candidates in one trie.
WORDS_TOGETHER, TRIE_PHRASES = 2_000_000, 250_000
#: Ranges of first words that the candidates are counted by.
FIRST_RANGES = 4096
#: Words or places of a task that are added up, or looked up, together.
HELD_TOGETHER = 1 << 21
#: Leading bits of a pair's number that tell its block, counts in a block of phrases, and counts a task holds at once.
BLOCK_BITS, COUNT_BLOCK, COUNTS_TOGETHER = 12, 4096, 1 << 22
#: An odd number that spreads what it multiplies, and what undoes it.
SPREAD = 0x9E3779B97F4A7C15
UNSPREAD = pow(SPREAD, -1, 1 << 64)
#: Score of a phrase whose parts never stand apart, halved.
SCALE = 2_000_000
UNKNOWN_LANGUAGE = "und"

SEPARATORS = np.zeros(0x110000, bool)
SEPARATORS[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = True
BREAKS = SEPARATORS.copy()
BREAKS[[0x20, 0x09]] = True
ANY_BREAK = re.compile("[ \t.,;:!?\x0a-\x0d]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

Batches = Iterator[pa.RecordBatch]


# -- words -----------------------------------------------------------------


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str], bool]]:
    """Texts, their languages, and whether they go on with the text before.

    A long text comes in pieces, each cut before a sign that parts words.
    """
    texts = batch["text"].cast(pa.large_string()).fill_null("")
    for start, stop in by_bytes(texts, BLOCK_BYTES):
        langs = batch["lang"].slice(start, stop - start).to_pylist()
        if stop - start > 1 or texts[start].as_buffer().size <= BLOCK_BYTES:
            yield texts.slice(start, stop - start), langs, False
            continue
        text, at = texts[start].as_py(), 0
        while at < len(text):
            found = ANY_BREAK.search(text, at + BLOCK_BYTES)
            end = found.start() if found else len(text)
            yield pa.array([text[at:end]], pa.large_string()), langs, at > 0
            at = end


def _language_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of some texts: where they lie and their keys, 64 bits of language and word, never 0."""

    def __init__(self, texts: pa.Array, langs: list[str], seed: int):
        points, self.at, self.joined = flat(texts)
        self.points = np.where((points >= 65) & (points <= 90), points + 32, points)
        self.starts, self.ends = runs(~BREAKS[points], self.at)
        self.text = np.searchsorted(self.at, self.starts, "right") - 1
        tongues = {lang: _language_key(lang) for lang in set(langs)}
        own = np.array([tongues[lang] for lang in langs], np.uint64)
        keys = mix(word_hashes(self.points, self.starts, self.ends, seed) ^ own[self.text])
        self.keys = np.where(keys == 0, np.uint64(1), keys)

    def word(self, i: int) -> str:
        return self.joined[self.starts[i] : self.ends[i]].translate(LOWER)

    def stream(self, goes_on: bool) -> np.ndarray:
        """The keys in order, 0 wherever phrases end."""
        stops = np.flatnonzero(SEPARATORS[self.points])
        texts = self.at[1:-1] if goes_on else self.at[:-1]
        place = np.concatenate([texts, stops, self.starts])
        key = np.concatenate([np.zeros(len(texts) + len(stops), np.uint64), self.keys])
        key = key[np.argsort(place, kind="stable")]  # the mark of a text comes before its first word
        again = (key[1:] == 0) & (key[:-1] == 0)
        return key[np.append(True, ~again)[: len(key)]]


class Names:
    """The spellings of wanted keys, each handed out once, or again for another word of its key."""

    def __init__(self, wanted: np.ndarray, seed: int):
        self.wanted, self.seed = wanted, seed
        self.checks = np.zeros(len(wanted), np.uint64)  # a second hash of the word named
        self.known = np.zeros(len(wanted), bool)

    def fresh(self, words: Words, langs: list[str]) -> Iterator[tuple[int, str, str]]:
        """Key, language and spelling of words not named so far."""
        place = _place_in(self.wanted, words.keys.view(np.int64))
        at = np.flatnonzero(place >= 0)
        codes, first = distinct(words.keys[at])
        if all_alike(words.points, words.starts[at], words.ends[at], first[codes]):
            at = at[first]
        place = place[at]
        checks = word_hashes(words.points, words.starts[at], words.ends[at], self.seed + 1)
        new = ~self.known[place] | (self.checks[place] != checks)
        self.known[place[new]], self.checks[place[new]] = True, checks[new]
        for i in at[new].tolist():
            yield int(words.keys[i].view(np.int64)), langs[words.text[i]], words.word(i)


def _place_in(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key lies in the sorted ``known``, -1 where it does not."""
    if not len(known):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def _once(shared: Broadcast):
    """What was broadcast, read anew: unlike its ``value`` it goes when the caller lets go of it."""
    value = shared.value
    if getattr(shared, "_path", None):  # else it came by a socket and cannot be read again
        del shared._value
    return value


def _summed(parts: list[np.ndarray], names: tuple[str, str]) -> pa.RecordBatch:
    values, held = np.unique(np.concatenate(parts), return_counts=True)
    return pa.record_batch([pa.array(values), pa.array(held)], names=list(names))


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """``key, lang, held``: occurrences of every key, and under a null key of all words of a language."""

    def count(batches: Batches) -> Batches:
        parts: list[np.ndarray] = []
        totals: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            summed = _summed(parts, ("key", "held"))
            parts.clear()
            nothing = pa.nulls(len(summed), pa.string())
            return pa.record_batch([summed["key"], nothing, summed["held"]], names=["key", "lang", "held"])

        for batch in batches:
            for column, langs, _ in _blocks(batch):
                words = Words(column, langs, seed)
                parts.append(words.keys.view(np.int64))
                for lang, n in zip(langs, np.bincount(words.text, minlength=len(langs)).tolist()):
                    totals[lang] = totals.get(lang, 0) + n
                if sum(map(len, parts)) > HELD_TOGETHER:
                    yield rows()
        if parts:
            yield rows()
        yield pa.record_batch(
            [pa.nulls(len(totals), pa.int64()), pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())],
            names=["key", "lang", "held"],
        )

    return texts.mapInArrow(count, "key long, lang string, held long").groupBy("key", "lang").agg(F.sum("held").alias("held"))


def streams(batch: pa.RecordBatch, seed: int, look=lambda words, langs: None) -> Iterator[np.ndarray]:
    """Keys of the words in order, 0 wherever phrases end; a text is never in two arrays."""
    own = None
    for column, langs, goes_on in _blocks(batch):
        if own is not None and not goes_on:
            yield own
            own = None
        words = Words(column, langs, seed)
        look(words, langs)
        keys = words.stream(goes_on)
        own = keys if own is None else np.concatenate([own, keys])
    if own is not None:
        yield own


def pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def unpack(column: pa.Array, i: int, n: int, dtype=np.int32) -> np.ndarray:
    return np.frombuffer(pa.decompress(column[i].as_buffer(), n * np.dtype(dtype).itemsize, "zstd"), dtype)


def _number(known: np.ndarray, first: int, keys: np.ndarray, numbers: np.ndarray) -> None:
    """Give a number to the keys known; what has one keeps it."""
    left = np.flatnonzero((numbers < 0) & (keys != 0))
    at = _place_in(known, keys[left])
    numbers[left[at >= 0]] = first + at[at >= 0]


def _numbers(frequent: DataFrame, shards: list[tuple[Broadcast, int]]) -> DataFrame:
    """``key, number, a`` of the frequent words, numbered as in the shards of their keys."""

    def look_up(batches: Batches) -> Batches:
        parts: list[pa.RecordBatch] = []

        def rows() -> pa.RecordBatch:
            own = pa.Table.from_batches(parts).combine_chunks()
            parts.clear()
            keys = own["key"].to_numpy()
            numbers = np.full(len(keys), -1, np.int32)
            for shard, first in shards:
                _number(_once(shard), first, keys, numbers)
            held = own["held"].combine_chunks()
            return pa.record_batch([pa.array(keys), pa.array(numbers), held], names=["key", "number", "a"])

        for batch in batches:
            parts.append(batch)
            if sum(map(len, parts)) > HELD_TOGETHER:
                yield rows()
        if sum(map(len, parts)):
            yield rows()

    return frequent.mapInArrow(look_up, "key long, number int, a long")


def _numbered(texts: DataFrame, shards: list[tuple[Broadcast, int]], seed: int) -> DataFrame:
    """Texts as packed arrays of word numbers, -1 for a rare word and where phrases end.

    Rows that have no such array name the words of the keys, once a task.
    ``shards`` are sorted keys and the number of the first. A task keeps the
    shard whose words it names; the others it reads one after the other, for
    as many texts as are held together.
    """

    def spell(own: tuple[Broadcast, int], others: list[tuple[Broadcast, int]] | None):
        def rows(batches: Batches) -> Batches:
            known, first = own[0].value, own[1]
            names = Names(known, seed)
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def numbered() -> Batches:
                for shard, start in others:
                    keys = _once(shard)
                    for stream, words in held:
                        _number(keys, start, stream, words)
                for _, words in held:
                    yield _text_row(words)
                held.clear()

            for batch in batches:
                fresh: list[tuple[int, str, str]] = []

                def look(words: Words, langs: list[str]) -> None:
                    fresh.extend(names.fresh(words, langs))

                for stream in streams(batch, seed, look):
                    if others is None:  # the texts are numbered elsewhere
                        continue
                    stream = stream.view(np.int64)
                    words = np.full(len(stream), -1, np.int32)
                    _number(known, first, stream, words)
                    held.append((stream if others else stream[:0], words))
                    if not others or sum(len(words) for _, words in held) > HELD_TOGETHER:
                        yield from numbered()
                yield pa.record_batch(
                    [
                        pa.nulls(len(fresh), pa.int64()), pa.nulls(len(fresh), pa.binary()),
                        pa.array([k for k, _, _ in fresh], pa.int64()), pa.array([g for _, g, _ in fresh], pa.string()),
                        pa.array([w for _, _, w in fresh], pa.string()),
                    ],
                    names=TEXT_NAMES,
                )
            if held:
                yield from numbered()

        return rows

    found = texts.mapInArrow(spell(shards[0], shards[1:]), TEXT_ROWS)
    for shard in shards[1:]:
        # The words of further shards are named in tasks of their own.
        found = found.union(texts.mapInArrow(spell(shard, None), TEXT_ROWS))
    return found


TEXT_ROWS = "n long, words binary, key long, lang string, word string"
TEXT_NAMES = [field.split()[0] for field in TEXT_ROWS.split(", ")]


def _text_row(words: np.ndarray) -> pa.RecordBatch:
    none = (pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()))
    return pa.record_batch([pa.array([len(words)], pa.int64()), pa.array([pack(words)], pa.binary()), *none], names=TEXT_NAMES)


def _words(texts: DataFrame, least: int, stage: Stage) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Numbered texts, ``number, lang, word, a`` of frequent words, ``lang, n`` of all, how many are frequent.

    Should two words share a key, all starts anew with another seed.
    """
    spark, seed = texts.sparkSession, 0
    while True:
        counts = stage(f"words-{seed}", word_counts(texts, seed))
        frequent = counts.filter((F.col("held") >= least) & F.col("key").isNotNull()).select("key", "held")
        size = frequent.count()
        shards = max(1, -(-size // WORDS_TOGETHER))
        keys, first = [], 0
        for shard in range(shards):
            part = frequent.filter(F.pmod(F.col("key"), F.lit(shards)) == shard).select("key").toArrow()["key"].to_numpy()
            keys.append((spark.sparkContext.broadcast(np.sort(part)), first))
            first += len(part)
        numbers = stage(f"numbers-{seed}", _numbers(frequent, keys))
        rows = stage(f"texts-{seed}", _numbered(texts, keys, seed))
        for shard, _ in keys:
            shard.destroy()
        named = stage(f"named-{seed}", rows.filter("n IS NULL").select("key", "lang", "word").distinct())
        if named.groupBy("key").count().filter("count > 1").isEmpty():
            break
        seed += 1
    vocabulary = stage("vocabulary", named.join(numbers, "key"))
    totals = counts.filter(F.col("key").isNull()).select("lang", F.col("held").alias("n"))
    return rows.filter("n IS NOT NULL").select("n", "words"), vocabulary, totals, size


# -- levels ----------------------------------------------------------------


def _safe_places(words: np.ndarray, state: np.ndarray, width: int) -> np.ndarray:
    """Places where frequent phrases of ``width`` - 1 words start, and one word on too."""
    if len(words) < width:
        return np.zeros(0, np.int64)
    return np.flatnonzero((state[:-1] >= 0) & (state[1:] >= 0))


def _spread(x: np.ndarray, bits: int, by: int = SPREAD) -> np.ndarray:
    """Numbers below ``2 ** bits`` dealt anew, one to one and evenly; ``UNSPREAD`` gives back what they were."""
    mask = np.uint64((1 << bits) - 1)
    x = x * np.uint64(by) & mask
    x = x ^ x >> np.uint64((bits + 1) // 2)
    return x * np.uint64(by) & mask


def _gaps(values: np.ndarray, low: int) -> bytes:
    """Rising numbers from ``low`` on as their gaps, all lowest bytes first."""
    gaps = np.diff(values, prepend=np.uint64(low))
    return pack(gaps.view(np.uint8).reshape(-1, 8).T)


def _ungapped(column: pa.Array, i: int, n: int, low: int) -> np.ndarray:
    gaps = np.ascontiguousarray(unpack(column, i, 8 * n, np.uint8).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _heavy_buckets(level: DataFrame, width: int, bits: int, least: int) -> DataFrame:
    """``bucket`` of what is found ``least`` times or more; a pair has one of its own.

    Of its ``bits`` the upper half is the shorter phrase, the lower half the next word.
    """
    half, drop = np.int64(bits // 2), bits - BLOCK_BITS

    def count(batches: Batches) -> Batches:
        parts: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            pairs, held = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            blocks, first = np.unique(pairs >> np.uint64(drop), return_index=True)
            ends = np.append(first[1:], len(pairs))
            cuts = list(zip(blocks.tolist(), first.tolist(), ends.tolist()))
            return pa.record_batch(
                [
                    pa.array(blocks.astype(np.int32)),
                    pa.array(ends - first),
                    pa.array([_gaps(pairs[i:j], block << drop) for block, i, j in cuts], pa.binary()),
                    pa.array([pack(held[i:j].astype(np.int32)) for _, i, j in cuts], pa.binary()),
                ],
                names=["block", "n", "gaps", "held"],
            )

        for batch in batches:
            for i, n in enumerate(batch["n"].to_pylist()):
                words, state = (unpack(batch[c], i, n).astype(np.int64) for c in ("words", "state"))
                at = _safe_places(words, state, width)
                pair = state[at] << half | words[at + width - 1]
                parts.append(_spread(pair.view(np.uint64), bits))
                if sum(map(len, parts)) > HELD_TOGETHER:
                    yield rows()
        if parts:
            yield rows()

    def add(batches: Batches) -> Batches:
        block, pairs, held = -1, [], []

        def rows() -> pa.RecordBatch:
            values, of = np.unique(np.concatenate(pairs), return_inverse=True)
            sums = np.zeros(len(values), np.int64)
            np.add.at(sums, of, np.concatenate(held))
            heavy = _spread(values[sums >= least], bits, UNSPREAD)
            return pa.record_batch([pa.array(heavy.view(np.int64))], names=["bucket"])

        for batch in batches:
            for i, (own, n) in enumerate(zip(batch["block"].to_pylist(), batch["n"].to_pylist())):
                if own != block and pairs:
                    yield rows()
                    pairs, held = [], []
                block = own
                pairs.append(_ungapped(batch["gaps"], i, n, own << drop))
                held.append(unpack(batch["held"], i, n))
        if pairs:
            yield rows()

    packed = level.mapInArrow(count, "block int, n long, gaps binary, held binary")
    return packed.repartition("block").sortWithinPartitions("block").mapInArrow(add, "bucket long")


def _candidates(heavy: DataFrame, bits: int) -> DataFrame:
    """``state, after`` of the pairs."""
    half = bits // 2
    return heavy.select(
        F.shiftright("bucket", half).alias("state"), F.col("bucket").bitwiseAND(F.lit((1 << half) - 1)).alias("after")
    )


LEVEL = "n long, words binary, state binary"
#: A broadcast double array, the least and the greatest first word in it, and the number of its first phrase.
Trie = tuple[Broadcast, int, int, int]


#: Word numbers, places in them by their first word, the first words, and the number of the phrase at each place or -1.
Walked = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _to_walk(words: np.ndarray, places: np.ndarray) -> Walked:
    places = places[np.argsort(words[places], kind="stable")]
    return words, places, words[places], np.full(len(words), -1, np.int32)


def _walk(tries: list[Trie], texts: list[Walked]) -> None:
    """Fill in what the tries, read one after the other, accept."""
    for trie, low, high, first in tries:
        automaton = _once(trie)
        for words, places, starts, found in texts:
            at = places[np.searchsorted(starts, low) : np.searchsorted(starts, high, "right")]
            number = automaton.walk(words, at)
            found[at[number >= 0]] = first + number[number >= 0]
        del automaton


def _accepted(level: DataFrame, tries: list[Trie], width: int) -> DataFrame:
    """The level with the number of the candidate that starts at each place, or -1, as state.

    A task holds some texts and reads the tries one after the other for them.
    """

    def walk(batches: Batches) -> Batches:
        packed: list[pa.Array] = []
        texts: list[Walked] = []

        def rows() -> Batches:
            _walk(tries, texts)
            for own, (words, _, _, found) in zip(packed, texts):
                yield pa.record_batch(
                    [pa.array([len(words)], pa.int64()), own, pa.array([pack(found)], pa.binary())],
                    names=["n", "words", "state"],
                )
            packed.clear()
            texts.clear()

        for batch in batches:
            for i, n in enumerate(batch["n"].to_pylist()):
                words, state = (unpack(batch[c], i, n) for c in ("words", "state"))
                packed.append(batch["words"].slice(i, 1))
                texts.append(_to_walk(words, _safe_places(words, state, width)))
                if sum(len(words) for words, *_ in texts) > HELD_TOGETHER:
                    yield from rows()
        if texts:
            yield from rows()

    return level.mapInArrow(walk, LEVEL)


def _counts(level: DataFrame, size: int) -> DataFrame:
    """``number, a``: how often each number below ``size`` occurs in ``state``.

    A task counts so many numbers in one array; what it hands on are blocks of
    that array, which are added up block by block.
    """

    def count(first: int, size: int):
        def bins(batches: Batches) -> Batches:
            held = np.zeros(-(-size // COUNT_BLOCK) * COUNT_BLOCK, np.int64)
            parts: list[np.ndarray] = []

            def add_up() -> None:
                np.add(held, np.bincount(np.concatenate(parts), minlength=len(held)), out=held)
                parts.clear()

            for batch in batches:
                for i, n in enumerate(batch["n"].to_pylist()):
                    state = unpack(batch["state"], i, n) - first
                    parts.append(state[(state >= 0) & (state < size)])
                    if sum(map(len, parts)) > HELD_TOGETHER:
                        add_up()
            if parts:
                add_up()
            blocks = held.reshape(-1, COUNT_BLOCK)
            some = np.flatnonzero(blocks.any(axis=1))
            start = first + some * COUNT_BLOCK
            yield pa.record_batch(
                [pa.array(start), pa.array([pack(blocks[k]) for k in some], pa.binary())], names=["start", "held"]
            )

        return bins

    def add(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, start in enumerate(batch["start"].to_pylist()):
                sums[start] = sums.get(start, 0) + unpack(batch["held"], i, COUNT_BLOCK, np.int64)
        for start, held in sums.items():
            some = np.flatnonzero(held)
            yield pa.record_batch([pa.array(start + some), pa.array(held[some])], names=["number", "a"])

    narrow = level.select("n", "state")
    parts = [
        narrow.mapInArrow(count(first, min(COUNTS_TOGETHER, size - first)), "start long, held binary")
        for first in range(0, max(1, size), COUNTS_TOGETHER)
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    return every.repartition("start").mapInArrow(add, "number long, a long")


def _ranges(phrases: DataFrame, words: int) -> list[tuple[int, int, int, int]]:
    """First words from and to, part and parts: of which candidates each trie is.

    Ranges of first words with few candidates share a trie; one with too many
    for a trie is dealt out by hash.
    """
    step = max(1, -(-words // FIRST_RANGES))
    counts = phrases.groupBy(F.expr(f"words[0] div {step}").alias("range")).count().collect()
    ranges: list[tuple[int, int, int, int]] = []
    room = 0
    for own, count in sorted((r["range"], r["count"]) for r in counts):
        low, high = own * step, (own + 1) * step - 1
        parts = -(-count // TRIE_PHRASES)
        if count <= room:
            ranges[-1] = (ranges[-1][0], high, 0, 1)
            room -= count
        else:
            ranges += [(low, high, part, parts) for part in range(parts)]
            room = TRIE_PHRASES - count if parts == 1 else 0
    return ranges or [(0, 0, 0, 1)]


def _tries(phrases: DataFrame, words: int, width: int) -> tuple[list[Trie], int]:
    """Broadcast tries of all candidates, a bounded number in each, and how many they are.

    ``words`` is how many word numbers there are.
    """
    spark, digits, head = phrases.sparkSession, digits_for(words), F.col("words")[0]
    tries: list[Trie] = []
    first = 0
    for low, high, part, parts in _ranges(phrases, words):
        own = phrases.filter(head.between(low, high) & (F.pmod(F.xxhash64("words"), F.lit(parts)) == part))
        rows = own.toArrow()["words"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        rows = rows[np.lexsort(rows.T[::-1])]
        tries.append((spark.sparkContext.broadcast(DoubleArray(rows, digits)), low, high, first))
        first += len(rows)
    return tries, first


def _numbered_phrases(phrases: DataFrame, tries: list[Trie], width: int) -> DataFrame:
    """``number, words`` of the candidates, as the tries number them."""

    def look_up(batches: Batches) -> Batches:
        parts: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            words = np.concatenate(parts)
            parts.clear()
            starts = np.arange(0, len(words), width)
            own = _to_walk(words, starts)
            _walk(tries, [own])
            phrases = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, width, dtype=np.int32)), pa.array(words))
            return pa.record_batch([pa.array(own[-1][starts].astype(np.int64)), phrases], names=["number", "words"])

        for batch in batches:
            parts.append(batch["words"].flatten().to_numpy())
            if sum(map(len, parts)) > HELD_TOGETHER:
                yield rows()
        if sum(map(len, parts)):
            yield rows()

    return phrases.mapInArrow(look_up, "number long, words array<int>")


def frequent_phrases(texts: DataFrame, least: int, longest: int, stage: Stage) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary, ``lang, n`` of all words, and ``words, a`` of all phrases with ``a >= least``.

    ``texts`` has the columns ``lang`` and ``text``.
    """
    rows, vocabulary, totals, size = _words(texts, least, stage)
    every = vocabulary.select(F.array("number").alias("words"), "a")
    shorter = vocabulary.select(F.col("number").cast("long").alias("state"), F.array("number").alias("head"))
    level = rows.withColumn("state", F.col("words"))
    states = size
    for width in range(2, longest + 1):
        bits = max(BLOCK_BITS, 2 * max(states, size).bit_length())
        heavy = stage(f"buckets-{width}", _heavy_buckets(level, width, bits, least))
        phrases = stage(
            f"phrases-{width}",
            _candidates(heavy, bits).join(shorter, "state").select(F.concat("head", F.array(F.col("after").cast("int"))).alias("words")),
        )
        tries, states = _tries(phrases, size, width)
        numbered = stage(f"candidates-{width}", _numbered_phrases(phrases, tries, width))
        level = stage(f"level-{width}", _accepted(level, tries, width))
        for trie, *_ in tries:
            trie.destroy()
        counted = stage(f"counts-{width}", _counts(level, states))
        kept = stage(f"frequent-{width}", numbered.join(counted.filter(F.col("a") >= least), "number"))
        every = every.union(kept.select("words", "a"))
        shorter = kept.select(F.col("number").alias("state"), F.col("words").alias("head"))
        if kept.isEmpty():
            break
    return vocabulary, totals, stage("phrases", every)


# -- scores ----------------------------------------------------------------


def _wide(name: str):
    """A count with room for products."""
    return F.col(name).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces,
    those at spaces and tabs into words. ``a`` counts the phrase within pieces,
    overlaps included, ``n`` all words of the language. Cut into a first part
    (``l`` times in the texts) and a rest (``r`` times), a phrase scores
    ``floor(2000000 a / (l + r))``; the cut with the lowest score counts, of
    equal ones the earliest. A phrase that lies in a longer one found at least
    ``share`` percent as often is left out. Ties of score go by ``a``, then by
    the phrase in binary order.

    A null language is ``und``, a null text has no words; rows count each,
    also repeated ones and those without id. An empty table gives no rows. No
    text is cut but at signs between words, and no phrase is lost there.
    """
    stage = stage_in(shared_dir(docs.sparkSession, "phrases"))
    texts = pick(docs, "lang", "text").select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), F.col("text").cast("string")
    )
    vocabulary, totals, every = frequent_phrases(texts, least, longest, stage)
    long_ones = every.filter(F.size("words") > 1)

    parts = long_ones.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut")).select(
        "words", "a", "cut", F.slice("words", F.lit(1), F.col("cut")).alias("head"),
        F.expr("slice(words, cut + 1, size(words) - cut)").alias("rest"),
    )
    scored = (
        parts.join(every.select(F.col("words").alias("head"), F.col("a").alias("l")), "head")
        .join(every.select(F.col("words").alias("rest"), F.col("a").alias("r")), "rest")
        .withColumn("score", F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)"))
        .groupBy("words")
        .agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("best"))
    )
    inner = (
        long_ones.filter(F.size("words") > 2)
        .select("words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
        .select("words", "a", "size", F.explode(F.expr("sequence(1, size(words) - size + 1)")).alias("at"))
        .groupBy(F.expr("slice(words, at, size)").alias("words"))
        .agg(F.max("a").alias("longer"))
    )
    covered = F.lit(100).cast("decimal(10,0)") * _wide("longer") >= F.lit(share).cast("decimal(10,0)") * _wide("best.a")
    alone = stage(
        "alone", scored.join(inner, "words", "left").filter(~F.coalesce(covered, F.lit(False))).select("words", "best.*")
    )
    spelled = (
        alone.select("words", "score", "l", "r", "a", F.posexplode("words").alias("pos", "number"))
        .join(vocabulary.select("number", "lang", "word"), "number")
        .groupBy("words", "score", "l", "r", "a")
        .agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("spelling"))
        .select("lang", F.array_join("spelling.word", " ").alias("phrase"), "a", "l", "r", "score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
