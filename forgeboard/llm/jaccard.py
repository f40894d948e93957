"""Exact Jaccard join on word shingles by partitioning the universe of shingles.

Sets are dealt into bands by size. For a band, a hash deals every shingle into
one of m segments, m - 1 being the most by which two linked sets of the band
can differ. By the pigeonhole principle linked sets then agree on a segment,
or a set may leave out costly segments and accept one difference in others:
with t = -1, 0 or 1 for each segment (left out, equal, up to one shingle
more or less) the sum of t + 1 must exceed the difference. Small segments
cost most, as many unrelated sets agree on them; they are left out as far as
the sum allows, and further ones are bought with t = 1 on fuller segments of
a pool whose one-deletion neighbourhoods are in the index. Every candidate is
verified on the whole sets.

Sets that agree on a segment are not paired all with all. Each is compared
with one other, of the first sets of its signatures that with which it shares
most; links are gathered into components, and rounds compare one member of
each two components that still meet in a signature. What is left in different
components is compared in blocks by parity bits, which rule out no linked
pair, so that only pairs that pass leave a task: first the nearest of every
component, then all that still lie apart. Where more than ``SMALL``
sets share a signature, only those that also share a shingle among their
rarest (linked sets must, by the overlap they need).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeboard.llm.frames import pick
from forgeboard.llm.text import (
    by_bytes,
    flat,
    mix,
    plain_words,
    word_hashes,
)
from forgeboard.session import Stage, shared_dir, stage_in

#: Bytes of text that become sets at a time, and shingles whose signatures are formed at a time.
SET_BYTES, SIGN_SHINGLES = 1 << 18, 1 << 17
#: One in so many segments is in the pool with one-deletion neighbourhoods.
POOL = 24
#: A segment of at most so many shingles is costly, one of at least so many can be bought.
COSTLY, FULL = 1, 3
#: Bits of the parities compared in blocks, sets of a key in a block, and rows and pairs looked at together.
SKETCH, BLOCK, TOGETHER, PAIRS = 512, 2048, 20_000, 1 << 19
#: Sets that share a signature are paired directly up to this many.
SMALL = 32
#: A shingle is common that more than one in so many of the sets concerned hold.
RARE = 1000
#: Leading bits of a node that the bitmap of wanted nodes tells apart (8 MB).
MARK_BITS = 26
#: Sets that are sent to every executor at most.
SENT_SETS = 200_000
#: Rounds in which a signature's components are compared by one member each only.
STARS = 2
#: Roles of a signature.
INDEX, PROBE, INDEX_LESS, PROBE_LESS = 1, 2, 4, 8

SETS = "doc_id long, row long, n_shingles long, node long"
SIGNATURES = "sig long, node long, n long, role int"


# -- sets ----------------------------------------------------------------


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of every distinct shingle, by text and hash."""
    points, at, _ = flat(column)
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    starts, ends, text = plain_words(points, at)
    words = word_hashes(points, starts, ends)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    opens, closes = _text_bounds(text)
    held = (closes - opens)[text]  # words of the text each word is in
    place = np.arange(len(words)) - opens[text]
    size = np.minimum(held, width)
    h = np.zeros(len(words), np.uint64)
    for k in range(width):
        h = np.where(k < size, mix(h * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(words)] + np.uint64(k + 1)), h)
    whole = place + size <= held
    text, h = text[whole], h[whole]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))
    return text[fresh], h[fresh]


def _text_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every text number up to the last, the range of its words."""
    numbers = np.arange(int(text[-1]) + 1)
    return np.searchsorted(text, numbers), np.searchsorted(text, numbers, "right")


def _key(hashes: np.ndarray) -> int:
    """A set as 64 bits."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Text number and sorted shingle hashes of each text."""
    column = column.cast(pa.large_string()).fill_null("")
    for start, stop in by_bytes(column, SET_BYTES):
        text, h = shingles(column.slice(start, stop - start), width)
        bounds = np.searchsorted(text, np.arange(stop - start + 1))
        for i in range(stop - start):
            yield start + i, h[bounds[i] : bounds[i + 1]]


# -- bands and segments ----------------------------------------------------


class Bands:
    """Size bands such that linked sets lie in one band or in neighbouring ones."""

    def __init__(self, percent: int):
        self.percent = percent
        self.rest, self.both = 100 - percent, 100 + percent
        self._starts = [1]

    def _grow(self, n: int) -> None:
        while self._starts[-1] <= n:
            self._starts.append(self._starts[-1] * 100 // self.percent + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self._grow(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self._starts), sizes, "right") - 1

    def last(self, band: np.ndarray) -> np.ndarray:
        """The largest size of a band."""
        while len(self._starts) < int(np.max(band, initial=0)) + 2:
            self._grow(self._starts[-1])
        return np.array(self._starts)[band + 1] - 1

    def difference(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most by which linked sets of these sizes can differ."""
        return self.rest * (a + b) // self.both

    def segments(self, band: np.ndarray) -> np.ndarray:
        last = self.last(band)
        return self.difference(last, last * 100 // self.percent) + 1

    def link(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return len(a) > 0 and len(b) > 0 and 100 * common >= self.percent * (len(a) + len(b) - common)


def _signatures(
    owner: np.ndarray, h: np.ndarray, sizes: np.ndarray, band: np.ndarray, bands: Bands, indexed: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, signature and role: sets partitioned as ``band`` has it.

    ``indexed`` says that it is the sets' own band; else they only probe it.
    A set probes those of its own size and smaller ones.
    """
    m = bands.segments(band)
    base = np.cumsum(m) - m
    spread = mix(h ^ np.uint64(0xA24BAED4963EE407))
    segment = (spread % m[owner].astype(np.uint64)).astype(np.int64)
    cell = base[owner] + segment
    total = int(m.sum())
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, cell, mix(h))
    held = np.bincount(cell, minlength=total)
    of = np.repeat(np.arange(len(m)), m)
    number = np.arange(total) - base[of]
    salt = mix(band[of].astype(np.uint64) * np.uint64(0x100000001B3) + number.astype(np.uint64) + np.uint64(1))
    sign = lambda s, at: mix(s * np.uint64(0xC2B2AE3D27D4EB4F) ^ salt[at])

    least = np.minimum(sizes, bands.last(band))
    spare = m - 1 - bands.difference(sizes, least)  # segments that may be left out for nothing
    by_cost = np.lexsort((number, held, of))
    rank = np.empty(total, np.int64)
    rank[by_cost] = np.arange(total) - base[of[by_cost]]
    costly = np.bincount(of[held <= COSTLY], minlength=len(m))
    wanted = np.maximum(0, costly - spare)
    pool = -(-m // POOL)
    can_buy = (number < pool[of]) & (held >= FULL) & (rank >= (spare + wanted)[of])
    nth = np.cumsum(can_buy) - can_buy
    nth = nth - nth[base[of]]
    bought = can_buy & (nth < wanted[of])
    out = spare + np.bincount(of[bought], minlength=len(m))
    probing = rank >= out[of]

    every = np.arange(total)
    owners, signs = [of], [sign(sums, every)]
    roles = [np.where(probing, PROBE, 0) | (INDEX if indexed else 0)]
    # One-deletion neighbourhoods: of pool segments in the index, of bought ones in the probe.
    for cells, role in ((number < pool[of], INDEX_LESS if indexed else 0), (bought, PROBE_LESS)):
        if role:
            tokens = np.flatnonzero(cells[cell])
            at = cell[tokens]
            owners.append(owner[tokens])
            signs.append(sign(sums[at] - mix(h[tokens]), at))
            roles.append(np.full(len(tokens), role))
    owners, signs, roles = np.concatenate(owners), np.concatenate(signs), np.concatenate(roles)
    use = roles > 0
    return owners[use], signs[use], roles[use]


def _signed(nodes: np.ndarray, own: list[np.ndarray], bands: Bands, percent: int) -> Iterator[pa.RecordBatch]:
    """All signatures of these sets."""
    sizes = np.array([len(s) for s in own], np.int64)
    owner, h = np.repeat(np.arange(len(nodes)), sizes), np.concatenate(own)
    band = bands.of(sizes)
    found = [_signatures(owner, h, sizes, band, bands, True)]
    # Sets of the band below that are large enough to be linked.
    below = (band > 0) & (100 * bands.last(np.maximum(band - 1, 0)) >= percent * sizes)
    if below.any():
        renumber = np.cumsum(below) - 1
        part = below[owner]
        o, s, r = _signatures(renumber[owner[part]], h[part], sizes[below], band[below] - 1, bands, False)
        found.append((np.flatnonzero(below)[o], s, r))
    for owners, signs, roles in found:
        for at in range(0, len(owners), 100_000):
            o = owners[at : at + 100_000]
            yield pa.record_batch(
                [
                    pa.array(signs[at : at + 100_000].view(np.int64)),
                    pa.array(nodes[o]),
                    pa.array(sizes[o]),
                    pa.array(roles[at : at + 100_000].astype(np.int32)),
                ],
                names=["sig", "node", "n", "role"],
            )


def signatures(texts: DataFrame, marks: np.ndarray, width: int, percent: int) -> DataFrame:
    """``sig, node, n, role`` of the sets of all rows ``lot, text`` whose lot is marked; of equal sets in a batch one stands for all."""
    sent = texts.sparkSession.sparkContext.broadcast(marks)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            kept: dict[int, np.ndarray] = {}
            for _, own in sets_of(batch["text"].filter(_held(sent.value, batch["lot"])), width):
                if len(own):
                    kept.setdefault(_key(own), own)
            if not kept:
                continue
            sizes = np.array([len(s) for s in kept.values()], np.int64)
            piece = (np.cumsum(sizes) - 1) // SIGN_SHINGLES
            every, own_sets = np.array(list(kept), np.int64), list(kept.values())
            for at in np.unique(piece):
                low, high = np.searchsorted(piece, [at, at + 1])
                yield from _signed(every[low:high], own_sets[low:high], bands, percent)

    return texts.select("lot", "text").mapInArrow(sign, SIGNATURES)


# -- candidates ------------------------------------------------------------


def _shared(rows: DataFrame, parts: int) -> DataFrame:
    """Rows whose signature several sets have, with the first of them.

    Rows of a signature come one after the other out of a sort, which spills;
    a task looks at them in turn and keeps none but the one before.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple | None = None  # the first row of the signature that the batch before ended with
        for batch in batches:
            sig, node = batch["sig"].to_numpy(), batch["node"].to_numpy()
            if not len(sig):
                continue
            n, role = batch["n"].to_numpy(), batch["role"].to_numpy()
            if carry is not None:
                sig, node, n, role = (np.append([c], a) for c, a in zip(carry, (sig, node, n, role)))
            opens = np.append(True, sig[1:] != sig[:-1])
            first = np.maximum.accumulate(np.where(opens, np.arange(len(sig)), 0))
            hit = np.flatnonzero(node != node[first])
            yield pa.record_batch(
                [pa.array(x) for x in (sig[hit], node[hit], n[hit], role[hit], node[first[hit]], n[first[hit]], role[first[hit]])],
                names=["sig", "node", "n", "role", "first", "first_n", "first_role"],
            )
            at = first[-1]
            carry = (sig[at], node[at], n[at], role[at])

    dealt = rows.repartition(parts, "sig").sortWithinPartitions("sig", "node", "role")
    return dealt.mapInArrow(
        follow, "sig long, node long, n long, role int, first long, first_n long, first_role int"
    )


def parities(h: np.ndarray, size: int | None = None) -> bytes:
    """Bit k says whether an odd number of shingles falls on k; twice as many bits as shingles, or more, unless said."""
    size = size or max(64, 1 << int(2 * len(h) - 1).bit_length())
    spread = mix(h ^ np.uint64(0x94D049BB133111EB)) & np.uint64(size - 1)
    odd = np.bincount(spread.astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference of two sets, from their parities.

    Every shingle that only one of them has flips one bit. The longer array
    folds to the length of the shorter, as lengths are powers of two.
    """
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ folded).sum())


def _possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that may be linked by their parities; no linked pair is left out."""
    both = pairs.join(bits.toDF("b", "n_b", "bits_b"), "b").join(bits.toDF("a", "n_a", "bits_a"), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            most = bands.difference(batch["n_a"].to_numpy(), batch["n_b"].to_numpy())
            left, right = batch["bits_a"].to_pylist(), batch["bits_b"].to_pylist()
            least = np.array([apart_at_least(x, y) for x, y in zip(left, right)], np.int64)
            keep = pa.array(least <= most)
            yield pa.record_batch([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(check, "a long, b long")


def _marks(nodes: DataFrame) -> np.ndarray:
    """A bit for every ``MARK_BITS`` leading bits of a node, set where one of ``nodes`` lies; its size is fixed."""
    lead = F.shiftrightunsigned("node", 64 - MARK_BITS)
    bit = F.expr("shiftleft(1L, cast(lead & 63 as int))")
    cells = nodes.select(lead.alias("lead")).groupBy(F.shiftright("lead", 6).alias("cell")).agg(F.bit_or(bit).alias("held"))
    found = cells.toArrow()  # at most 2 ** (MARK_BITS - 6) rows
    marks = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    marks[found["cell"].to_numpy()] = found["held"].to_numpy().view(np.uint64)
    return marks


def _held(marks: np.ndarray, nodes: pa.Array) -> pa.Array:
    """Which of ``nodes`` are marked."""
    bits = len(marks).bit_length() + 5  # 64 to a cell
    lead = nodes.to_numpy().view(np.uint64) >> np.uint64(64 - bits)
    return pa.array(marks[lead >> np.uint64(6)] >> (lead & np.uint64(63)) & np.uint64(1) == 1)


def _marked(texts: DataFrame, marks: np.ndarray) -> DataFrame:
    """The rows of ``texts`` whose node is marked."""
    sent = texts.sparkSession.sparkContext.broadcast(marks)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_held(sent.value, batch["node"]))

    return texts.mapInArrow(look, "node long, text string")


def _verified(
    pairs: DataFrame, texts: DataFrame, bits: DataFrame, width: int, percent: int, stage: Stage, name: str
) -> DataFrame:
    """The pairs ``a, b`` that are linked, written as ``name``.

    ``texts`` holds one text for each set, ``bits`` its size and parities.
    Texts only move for pairs that their parities do not rule out: a bitmap
    keeps the others, but for a few of the same leading bits, where they are.
    """
    possible = stage(f"possible-{name}", _possible(pairs, bits, percent))
    marks = _marks(possible.select(F.explode(F.array("a", "b")).alias("node")))
    if not marks.any():
        return possible
    met = stage(f"met-{name}", _marked(texts, marks))
    both = possible.join(met.toDF("b", "text_b"), "b").join(met.toDF("a", "text_a"), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, before = Bands(percent), None
        for batch in batches:
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            keep = np.zeros(len(a), bool)
            for start, stop in by_bytes(batch["text_b"], SET_BYTES):
                own = dict(sets_of(batch["text_b"].slice(start, stop - start), width))
                for i in range(start, stop):
                    if before is None or before[0] != a[i]:
                        before = (a[i], next(sets_of(batch["text_a"].slice(i, 1), width))[1])
                    keep[i] = bands.link(before[1], own[i - start])
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return stage(name, both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"))


def _whole_groups(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[pa.Table]:
    """Rows that come sorted by ``key``, some groups at a time and never a part of one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < TOGETHER:
            continue
        rows = pa.Table.from_batches(held)
        last = np.zeros(rows.num_rows, bool)
        for name in key:
            values = rows[name].to_numpy()
            last |= values != values[-1]
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut).to_batches()
    if held and any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _nearest(pairs: np.ndarray) -> np.ndarray:
    """Of rows ``a, b, apart, comp_a, comp_b`` those that are the nearest of a component."""
    row = np.tile(np.arange(len(pairs)), 2)
    comp = np.concatenate([pairs[:, 3], pairs[:, 4]])
    a, b, apart = pairs[row, 0], pairs[row, 1], pairs[row, 2]
    order = np.lexsort((b, a, apart, comp))
    comp = comp[order]
    return pairs[np.unique(row[order][np.append(True, comp[1:] != comp[:-1])[: len(comp)]])]


def compared(rows: DataFrame, sketches: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Pairs ``a, b`` of sets that share a key and may be linked; no linked pair with fitting roles is left out.

    With ``nearest`` only the nearest pair of every component is kept of the
    groups looked at together, so what leaves a task is at most what entered.

    ``rows`` holds ``key, node, n, role, comp``, ``sketches`` the parities of
    every node. A pair counts where the components differ, the sizes fit, the
    larger set probes what the smaller has in the index, and the parities do
    not rule it out. Sets of a key meet in blocks: a key held by more than
    ``BLOCK`` of them is dealt into several, and every two blocks meet in a
    place of their own, so no key has to fit into one task.
    """
    keys = (
        rows.groupBy("key")
        .agg(F.count("*").alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        .filter("low < high")
        .select("key", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    )
    dealt = (
        rows.join(keys, "key")
        .join(sketches, "node")
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
                "side", "node", "n", "role", "comp", "sketch")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for group in _whole_groups(batches, "key", "i", "j"):
            key, i, j, side, node, n, role, comp = (
                group[c].to_numpy() for c in ("key", "i", "j", "side", "node", "n", "role", "comp")
            )
            bits = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(len(node), -1)
            opens = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            ends = np.append(opens[1:], len(node))
            after = np.repeat(ends, ends - opens) - 1 - np.arange(len(node))  # rows of the group behind each
            places = np.append(0, np.cumsum(after))
            low, kept = 0, np.zeros((0, 5), np.int64)
            while low < len(node):
                high = max(low + 1, int(np.searchsorted(places, places[low] + PAIRS, "right")) - 1)
                x = np.repeat(np.arange(low, high), after[low:high])
                y = x + 1 + np.arange(len(x)) - (places[x] - places[low])
                low = high
                keep = (comp[x] != comp[y]) & ((i[x] == j[x]) | (side[x] != side[y]))
                x, y = x[keep], y[keep]
                down = n[x] < n[y]
                x, y = np.where(down, y, x), np.where(down, x, y)  # the larger first
                probes, indexed = role & (PROBE | PROBE_LESS) > 0, role & (INDEX | INDEX_LESS) > 0
                fits = (probes[x] & indexed[y]) | ((n[x] == n[y]) & probes[y] & indexed[x])
                keep = fits & (100 * n[y] >= percent * n[x])
                x, y = x[keep], y[keep]
                least = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                keep = least <= bands.difference(n[x], n[y])
                x, y = x[keep], y[keep]
                a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
                if nearest:
                    kept = _nearest(np.concatenate([kept, np.column_stack([a, b, least[keep], comp[x], comp[y]])]))
                else:
                    yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
            if nearest:
                yield pa.record_batch([pa.array(kept[:, 0].copy()), pa.array(kept[:, 1].copy())], names=["a", "b"])

    places = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(places, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(compare, "a long, b long")


def _rarest(crowd: DataFrame, texts: DataFrame, width: int, percent: int, stage: Stage) -> DataFrame:
    """``key, node, n, comp`` for those of the rarest shingles of every set of ``crowd`` that another set may hold.

    A linked set has ``percent`` of a set's shingles at least, so it has one
    of the first n - ceil(n x percent / 100) + 1 in any order that both use.
    Here those come first that no other set holds: they meet nothing and go
    no further, so a set of enough of them leaves no row. A bitmap of fixed
    size knows the others, but for a few more of the same leading bits. The
    common ones, less than ``RARE`` times the mean size of a set, come last
    and go to the tasks as an array. Texts are picked out where they are; only
    the rarest shingles meet ``crowd``.
    """
    met = stage("crowd-texts", _marked(texts, _marks(crowd)))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in sets_of(batch["text"], width):
                yield pa.record_batch([pa.array(own.view(np.int64))], names=["key"])

    n = crowd.count()
    counts = met.select("text").mapInArrow(tokens, "key long").groupBy("key").agg(F.count("*").alias("held"))
    several = stage("crowd-shared", counts.filter("held > 1"))
    often = several.filter(F.col("held") > max(4, n // RARE)).select("key").collect() if n else []
    common = np.sort(np.array([r["key"] for r in often], np.int64).view(np.uint64))
    sent = crowd.sparkSession.sparkContext.broadcast(_marks(several.select(F.col("key").alias("node"))))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for _, own in sets_of(batch["text"], width):
                need = len(own) - -(-len(own) * percent // 100) + 1
                at = np.minimum(np.searchsorted(common, own), max(0, len(common) - 1))
                known = common[at] == own if len(common) else np.zeros(len(own), bool)
                shared = _held(sent.value, pa.array(own.view(np.int64))).to_numpy(zero_copy_only=False)
                rarest = np.lexsort((own, known, shared))[:need]
                keys.append(own[rarest[shared[rarest]]].view(np.int64))
            yield pa.record_batch([batch["node"], pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

    rarest = met.mapInArrow(first, "node long, keys array<long>")
    return rarest.join(crowd, "node").select(F.explode("keys").alias("key"), "node", "n", "comp")


def components(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """``node, comp``: the smallest node reachable, for every node with a link.

    Every round a node takes the smallest label among its neighbours' and its
    label's own; labels are written, so a round's plan stays short.
    """
    both = stage(f"{name}-edges", links.union(links.select("b", "a")).toDF("node", "other").distinct())
    labels = stage(f"{name}-0", both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")))
    step = 0
    while True:
        step += 1
        near = both.join(labels.toDF("other", "comp"), "other").select("node", "comp")
        jump = labels.toDF("node", "via").join(labels.toDF("via", "comp"), "via").select("node", "comp")
        fresh = stage(
            f"{name}-{step}",
            labels.union(near).union(jump).groupBy("node").agg(F.min("comp").alias("comp")),
        )
        changed = fresh.join(labels.toDF("node", "old"), "node").filter(F.col("comp") != F.col("old"))
        if changed.isEmpty():
            return fresh
        labels = fresh


def links(narrow: DataFrame, stage: Stage, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sets of all rows ``doc_id, row, text``, and links between different sets that suffice for their components.

    Rows are known by ``row``, which need not be unique; those where it is null take no part.
    """
    spark = narrow.sparkSession

    def size_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(len(s), _key(s) if len(s) else None) for _, s in sets_of(batch["text"], width)]
            yield pa.record_batch(
                [
                    batch["doc_id"],
                    batch["row"],
                    pa.array([n for n, _ in own], pa.int64()),
                    pa.array([k for _, k in own], pa.int64()),
                ],
                names=["doc_id", "row", "n_shingles", "node"],
            )

    sets = stage("sets", narrow.mapInArrow(size_up, SETS))
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One row speaks for each set. Rows are told apart by a bitmap of hashes of
    # ``row``, so a few copies may be looked at besides, but no text moves.
    speaker = stage("speaker", sets.filter("node IS NOT NULL AND row IS NOT NULL").groupBy("node").agg(F.min("row").alias("row")))
    lots = narrow.filter("row IS NOT NULL").select(F.xxhash64("row").alias("lot"), "text")
    marks_of = lambda rows: _marks(rows.select(F.xxhash64("row").alias("node")))
    signed = signatures(lots, marks_of(speaker), width, percent)
    shared = stage("shared", _shared(signed, max(least, -(-total // 2_000_000))))

    # One text for each set that has a candidate, its size and parities.
    active = shared.select("node").union(shared.select("first")).distinct()
    sent = spark.sparkContext.broadcast(marks_of(speaker.join(active, "node")))

    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows that share ``row`` may have different sets; each speaks for its own alone.
        for batch in batches:
            texts = batch["text"].filter(_held(sent.value, batch["lot"]))
            own = [(i, _key(s), len(s), parities(s), parities(s, SKETCH)) for i, s in sets_of(texts, width) if len(s)]
            if own:
                at, node, n, bits, sketch = zip(*own)
                yield pa.record_batch(
                    [pa.array(node, pa.int64()), texts.take(pa.array(at)), pa.array(n, pa.int64()),
                     pa.array(bits, pa.binary()), pa.array(sketch, pa.binary())],
                    names=["node", "text", "n", "bits", "sketch"],
                )

    spoken = stage("spoken", lots.mapInArrow(speak, "node long, text string, n long, bits binary, sketch binary"))
    # Only sets that several rows speak for have to meet for one of them to stay.
    again = stage("again", spoken.groupBy("node").agg(F.count("*").alias("held")).filter("held > 1").select("node"))
    n_again, texts = again.count(), spoken
    if n_again > min(SENT_SETS, spoken.count() // 10):
        texts = stage("texts", spoken.join(again, "node", "left_anti").union(spoken.join(again, "node").dropDuplicates(["node"])))
    elif n_again:
        few = F.broadcast(again)
        one = stage("one-of-few", spoken.join(few, "node").dropDuplicates(["node"]))
        texts = spoken.join(few, "node", "left_anti").union(one)
    bits, sketches, texts = texts.select("node", "n", "bits"), texts.select("node", "sketch"), texts.select("node", "text")

    # A pair is a candidate only where one of the two probes; most crowded
    # signatures, such as empty segments, are only in the index.
    probing = lambda role: F.col(role).bitwiseAND(PROBE | PROBE_LESS) > 0
    fits = lambda a, b: F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)
    votes = (
        shared.filter(fits("n", "first_n") & (probing("role") | probing("first_role")))
        .groupBy("first", "node")
        .agg(F.count("*").alias("votes"))
    )
    nearest = votes.groupBy("node").agg(F.max_by("first", F.struct("votes", F.bitwise_not("first"))).alias("first"))
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    tried = stage("tried", nearest.select(*ordered("first", "node")))
    found = _verified(tried, texts, bits, width, percent, stage, "links-1")

    members = stage(
        "members",
        shared.select("sig", "node", "n", "role")
        .union(
            shared.select("sig", F.col("first").alias("node"), F.col("first_n").alias("n"), F.col("first_role").alias("role"))
        )
        .distinct(),
    )

    def labelled_now(step: int) -> DataFrame:
        labels = components(found, stage, f"comp-1-{step}")
        return members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    for step in range(2, STARS + 1):
        # One member speaks for each component of a signature, and one of them meets the others.
        one = F.struct((~probing("role")).alias("silent"), F.xxhash64("node", F.lit(step)).alias("lot"), "node", "n")
        speakers = stage(f"speakers-{step}", labelled_now(step).groupBy("sig", "comp").agg(F.min(one).alias("own")))
        hubs = (
            speakers.groupBy("sig")
            .agg(F.min(F.struct("own", "comp")).alias("hub"), F.count("*").alias("held"))
            .filter("held > 1 AND NOT hub.own.silent")
            .select("sig", "hub")
        )
        met = (
            speakers.join(hubs, "sig")
            .filter((F.col("comp") != F.col("hub.comp")) & fits("own.n", "hub.own.n"))
            .groupBy(
                F.least("comp", "hub.comp").alias("low"), F.greatest("comp", "hub.comp").alias("high"),
                *ordered("own.node", "hub.own.node"),
            )
            .agg(F.count("*").alias("votes"))
        )
        pairs = met.groupBy("low", "high").agg(F.max_by(F.struct("a", "b"), F.struct("votes", "a", "b")).alias("p"))
        fresh = stage(f"tried-{step}", pairs.select("p.a", "p.b").join(tried, ["a", "b"], "left_anti"))
        found = found.union(_verified(fresh, texts, bits, width, percent, stage, f"links-star-{step}"))
        tried = tried.union(fresh)

    # What still lies in different components and was not compared.
    labelled = labelled_now(0)
    apart = (
        labelled.groupBy("sig")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(probing("role")).alias("probed"))
        .filter("low < high AND probed")
    )
    open_rows = stage("open", labelled.join(apart.select("sig"), "sig", "left_semi"))
    large = open_rows.groupBy("sig").agg(F.count("*").alias("size")).filter(F.col("size") > SMALL).select("sig")
    few = open_rows.join(large, "sig", "left_anti").withColumnRenamed("sig", "key")
    crowd = stage("crowd", open_rows.join(large, "sig", "left_semi").select("node", "n", "comp").distinct())
    rare = _rarest(crowd, texts, width, percent, stage).withColumn("role", F.lit(INDEX | PROBE))
    columns = ["key", "node", "n", "role", "comp"]
    shares = stage("rare", few.select(columns).union(rare.select(columns)))
    # Every component's nearest first; what they join need not be compared in full.
    near = compared(shares, sketches, percent, nearest=True).distinct()
    fresh = stage("tried-near", near.join(tried, ["a", "b"], "left_anti"))
    found = found.union(_verified(fresh, texts, bits, width, percent, stage, "links-near"))
    tried = tried.union(fresh)
    joined = components(found, stage, "comp-1-near").toDF("node", "joined")
    shares = shares.join(joined, "node", "left").withColumn("comp", F.coalesce("joined", "comp")).drop("joined")
    rest = stage("rest", compared(shares, sketches, percent).distinct().join(tried, ["a", "b"], "left_anti"))
    more = _verified(rest, texts, bits, width, percent, stage, "links-2")
    return sets, found.union(more)


def join_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    A text is lower-cased (A-Z) and cut into words at blanks; its set holds
    the distinct shingles of ``width`` words, or the whole sequence if it has
    fewer. Two documents are linked where 100 x intersection >= ``percent`` x
    union; ``component_id`` is the smallest ``doc_id`` reachable by links.

    A text without words has an empty set and is linked with nothing. Null
    ids take no part and get a null component. Rows with the same set are one
    node of the graph, so copies cost no pairs; rows that share an id with
    different sets are told apart by their sets. An empty table gives no rows.
    Sets are known by 64-bit hashes of their shingles.
    """
    stage = stage_in(shared_dir(docs.sparkSession, "jaccard"))
    narrow = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets, found = links(narrow.withColumn("row", F.col("doc_id")), stage, width, percent)
    labels = components(found, stage, "comp-2")
    usable = sets.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = stage(
        "nodes",
        usable.groupBy("node").agg(F.min("doc_id").alias("low"))
        .join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")),
    )
    ids = nodes.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = stage("named", nodes.select("node", "comp").join(ids, "comp").select("node", "component_id"))
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sets.join(named, "node", "left").select("doc_id", "n_shingles", alone.alias("component_id"))


def _row_key(plain: DataFrame) -> Column:
    """A row's content as 64 bits; nulls count by their place. Maps, which cannot be hashed, are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    usable = [c for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*usable, *[F.col(c).isNull() for c in kinds])


def _rows_of(keyed: DataFrame, every: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose ``row`` is in ``kept``, one of each where that was ``held`` more than once.

    ``every`` lists what ``row`` can be. A bitmap of what is kept tells in the
    scan, and a second one of what it is wrong about or what repeats; only
    rows in the second meet ``kept``, so hardly a text moves.
    """
    spark = keyed.sparkSession
    once, repeated = kept.filter("held = 1").select("row"), kept.filter("held > 1").select("row")
    again = F.xxhash64("row")  # other leading bits than those of ``row``

    def marked(nodes: DataFrame) -> tuple[bool, Callable[..., Column]]:
        marks = _marks(nodes.toDF("node"))
        sent = spark.sparkContext.broadcast(marks)

        @F.arrow_udf("boolean")
        def held(rows: pa.Array) -> pa.Array:
            return _held(sent.value, rows)

        return bool(marks.any()), held

    _, wanted = marked(once)
    wrong = every.join(once, "row", "left_anti").filter(wanted("row"))
    any_doubt, doubtful = marked(wrong.union(repeated).select(again))
    if not any_doubt:
        return keyed.filter(wanted("row"))
    sure = keyed.filter(wanted("row") & ~doubtful(again))
    chosen = sure.union(keyed.filter(doubtful(again)).join(once, "row", "left_semi").select(sure.columns))
    if not repeated.isEmpty():
        chosen = chosen.union(
            keyed.filter(doubtful(again)).join(repeated, "row", "left_semi").dropDuplicates(["row"]).select(sure.columns)
        )
    return chosen


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs``, all columns, for each component: that of the smallest id.

    Rows are chosen, not ids: of rows that repeat one stays, rows of one id
    with different sets are members of their own components, and rows without
    id take part, after all ids. Of several rows of that id the one of the
    lowest hash of its content stays. Rows without words are copies of each
    other only under the same id, so without id all of them stay.
    """
    stage = stage_in(shared_dir(docs.sparkSession, "jaccard"))
    at = {name: docs.columns.index(name) for name in ("doc_id", "text")}
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    keyed = plain.withColumn("row", _row_key(plain))
    narrow = keyed.select(
        F.col(f"c{at['doc_id']}").cast("long").alias("doc_id"), F.col(f"c{at['text']}").cast("string").alias("text"), "row"
    )
    sets, found = links(narrow, stage, width, percent)
    labels = components(found, stage, "comp-2")
    # Repeated rows add up first, so that none of them meet in one task.
    alike = stage("alike", sets.groupBy("doc_id", "row", "node").agg(F.count("*").alias("held")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "held")).alias("first")
    with_words = alike.filter("node IS NOT NULL").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    kept = stage(
        "kept",
        with_words.groupBy("comp").agg(first)
        .union(alike.filter("node IS NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(first))
        .select("first.row", "first.held")
        .union(alike.filter("node IS NULL AND doc_id IS NULL").select("row", F.lit(1).cast("long"))),
    )
    chosen = _rows_of(keyed, alike.select("row"), kept)
    return chosen.drop("row").toDF(*docs.columns)
