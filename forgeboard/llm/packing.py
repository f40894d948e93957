"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bins are filled by minimum slack: the largest piece left opens a bin, and a
subset-sum table kept as the bits of one integer finds the fullest
combination of the other lengths at hand. Pieces of one length are
interchangeable, so the search runs over the histogram of lengths (at most
``capacity`` entries, whatever the number of documents), and a combination
is used as often as its lengths last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeboard.llm import encoder
from forgeboard.llm.frames import pick
from forgeboard.session import shared_dir, stage_in

CAPACITY = 2048
END_ID = 0

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, cut int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

Bin = tuple[list[tuple[int, int]], int]


def fullest(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """Of ``(length, count)``, longest first, the copies of each that together fill the most of ``room``.

    Bit n of the table says that n tokens can be filled exactly. Counts are
    taken in powers of two; the table before each step leads back to the
    combination.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in lengths:
        left, copies = min(count, room // length), 1
        while left > 0:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    filled = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, copies, before in reversed(steps):
        if not before >> filled & 1:
            chosen[length] = chosen.get(length, 0) + copies
            filled -= length * copies
    return sorted(chosen.items(), reverse=True)


def bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bin]:
    """``([(length, copies), ...], times)`` until every piece has a place."""
    left = {length: n for length, n in sorted(counts.items(), reverse=True) if n > 0}
    found: list[Bin] = []
    while left:
        largest = next(iter(left))
        others = [(s, n - (s == largest)) for s, n in left.items() if s <= capacity - largest]
        chosen = dict(fullest([x for x in others if x[1] > 0], capacity - largest))
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(left[s] // n for s, n in chosen.items())
        found.append((sorted(chosen.items(), reverse=True), times))
        for s, n in chosen.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return found


class Places:
    """Sequence and offset of the n-th piece of a length."""

    def __init__(self, found: list[Bin]):
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for combination, times in found:
            offset = 0
            for length, copies in combination:
                first = taken.get(length, 0)
                rows.append((length, first, copies, sequence, offset))
                taken[length] = first + copies * times
                offset += length * copies
            sequence += times
        self.sequences = sequence
        rows.sort()
        self.length, self.first, self.copies, self.sequence, self.offset = (
            np.array([r[i] for r in rows], np.int64) for i in range(5)
        )

    def __call__(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows are sorted by length and first piece; the last not after the piece holds it."""
        shift = int(self.first.max(initial=0)) + int(nth.max(initial=0)) + 1
        at = np.searchsorted(self.length * shift + self.first, length * shift + nth, "right") - 1
        within, slot = np.divmod(nth - self.first[at], self.copies[at])
        return self.sequence[at] + within, self.offset[at] + slot * length


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document: whole if it fits, else only the first is shorter."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pieces(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """The token pieces of every document, each numbered among those of its length in its task.

    ``cut`` is the task and ``nth`` the number there; they hold together only
    in a written copy, since a task may come to lie elsewhere in another run.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder.encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            flat, counts = words.encode(batch.column(1))
            ends = np.cumsum(counts)
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                own = np.append(flat[a:b], [end_id]).astype("<u4")
                at = 0
                for k, n in enumerate(cut(len(own), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(own[at : at + n].tobytes()))
                    if keep_ids:
                        ids.append(own[at : at + n].astype(np.int64))
                    at += n
            sizes = np.asarray(length, np.int64)
            nth = seen[sizes] + pd.Series(sizes).groupby(sizes).cumcount().to_numpy(np.int64)
            seen += np.bincount(sizes, minlength=capacity + 1)
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(sizes),
                pa.array(crc, pa.int64()),
                pa.array(np.full(len(row), task, np.int32)),
                pa.array(nth),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "cut", "nth"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.record_batch(columns, names=names)

    narrow = pick(docs, "doc_id", "text")
    return narrow.select(narrow.doc_id.cast("long"), narrow.text.cast("string")).mapInArrow(
        tokens, PIECE + (", ids array<long>" if keep_ids else "")
    )


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Place all documents in as few sequences of ``capacity`` tokens as the method finds.

    A document is its token ids and ``end_id``. Only one longer than a
    sequence is cut. Gives per piece ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset`` (with ``keep_ids`` also ``ids``);
    ``sequences`` puts the tokens together.

    The pieces are written once to the shared folder, without their ids
    unless asked for. A piece's number among all of its length is its number
    in its task plus what the tasks before hold, so no length, however
    common, is ranked in one place. The driver sees the histogram of lengths
    alone. Null and empty texts are the end id alone; null ids stay null and
    repeated rows are packed each; an empty table gives no rows.
    """
    stage = stage_in(shared_dir(docs.sparkSession, "packing"))
    cut_up = stage("pieces", pieces(docs, tokenizer, capacity, end_id, keep_ids))
    by_task = stage("counts", cut_up.groupBy("cut", "length").count())
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = Places(bins(counts, capacity))

    earlier = F.sum("count").over(
        Window.partitionBy("length").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = by_task.select("cut", "length", F.coalesce(earlier, F.lit(0)).alias("before"))
    ranked = cut_up.join(before, ["cut", "length"]).withColumn("nth", F.col("nth") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places(batch["length"].to_numpy(), batch["nth"].to_numpy())
            columns = [batch[n] for n in names]
            yield pa.record_batch(
                [*columns[:5], pa.array(sequence), pa.array(offset), *columns[5:]],
                names=[*names[:5], "sequence_id", "offset", *names[5:]],
            )

    return ranked.select(*names, "nth").mapInArrow(
        place, PLACED + (", ids array<long>" if keep_ids else "")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from ``pack(..., keep_ids=True)``; a group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts.getField("ids")).alias("ids"))
