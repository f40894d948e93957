"""Finding a page of an order without sorting all of it."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that may be passed over by sorting; beyond it the start is found by counting.
FEW = 1_000

#: A key holds its total in this many leading characters.
TOTAL_CHARS = 17


def board_key(total: Column, owner: Column) -> Column:
    """Text whose order is: unknown totals, then falling totals, then owners.

    Text is compared byte by byte, so the sixteen digits of the total,
    turned round, sort as the number does, and what follows them by owner.
    """
    turned = F.bitwise_not(total).bitwiseXOR(F.lit(-(2**63)))
    return F.concat(
        F.when(total.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(turned), 16, "0"))),
        owner,
    )


def total_step(total: Column) -> Column:
    """A number from 0 to 4,096 that never falls along the order of ``board_key``.

    Totals share a step where they agree in length and in the six bits after
    the first, so a histogram of steps is small however many totals there are.
    """
    length = F.length(F.bin(total)) - 1
    bits = F.when(
        length >= 6, F.call_function("shiftright", total, length - 6)
    ).otherwise(F.call_function("shiftleft", total, 6 - length))
    code = F.when(total <= 0, F.lit(0)).otherwise(length * 64 + bits.bitwiseAND(F.lit(63)) + 1)
    return F.when(total.isNull(), F.lit(0)).otherwise(F.lit(4096) - code).cast("int")


def seek(rows: DataFrame, key: str, position: int, few: int = FEW) -> tuple[str, int] | None:
    """Where a position lies: ``(low, skip)``, or None past the end.

    The row at ``position`` is number ``skip`` of those with a key of ``low``
    or more, and ``skip`` is at most ``few``. Rows are counted by the next
    characters of their keys, in the range that still holds the position; the
    counts are small (4,096 of a total's digits, one per letter of an owner),
    and each round goes on where the range's first and last key part. Keys
    must be distinct.
    """
    low, skip = "", position
    while skip > few:
        width = len(low) + (3 if len(low) < TOTAL_CHARS else 1)
        groups = (
            rows.filter(F.col(key).startswith(low))
            .groupBy(F.substring(key, 1, width).alias("head"))
            .agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
            .orderBy("head")
            .collect()
        )
        for group in groups:
            if skip < group["n"]:
                break
            skip -= group["n"]
        else:
            return None
        low = os.path.commonprefix([group["first"], group["last"]])
    return low, skip


def slice_of(rows: DataFrame, key: str, limit: int, offset: int, few: int = FEW) -> DataFrame:
    """``limit`` rows from ``offset`` on in the order of ``key``.

    No task holds more than ``few + limit`` of them, at any depth.
    """
    start = seek(rows, key, offset, few)
    if start is None:
        return rows.limit(0)
    low, skip = start
    return rows.filter(F.col(key) >= low).orderBy(key).offset(skip).limit(limit)
