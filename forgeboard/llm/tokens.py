"""Token counts of texts, without keeping the ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from forgeboard.llm import encoder
from forgeboard.llm.frames import pick
from forgeboard.llm.text import BLOCK_BYTES, by_bytes, byte_lengths

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _counter(tokenizer: str):
    """A function from a text column to the number of tokens of each text."""
    if encoder.is_byte_bpe(tokenizer):
        words = encoder.encoder(tokenizer)
        return lambda column: words.encode(column, count_only=True)[1]
    if tokenizer.endswith(".model"):
        encoder.quiet()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=encoder.place(tokenizer))

        def pieces(column: pa.Array) -> list[int]:
            return [len(ids) for ids in model.encode(column.to_pylist(), num_threads=1)]

        return _blockwise(pieces)
    library = encoder.library(tokenizer)

    def batch(column: pa.Array) -> list[int]:
        return [len(e) for e in library.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]

    return _blockwise(batch)


def _blockwise(count):
    def whole(column: pa.Array) -> np.ndarray:
        column = column.fill_null("")
        found = [count(column.slice(a, b - a)) for a, b in by_bytes(column, BLOCK_BYTES)]
        return np.asarray([n for part in found for n in part], np.int64)

    return whole


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 512,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    The count is that of the tokenizer's own library without begin, end or
    added special tokens; special strings inside a text count as the library
    takes them by default. Texts are encoded in Arrow batches regrouped to
    about 4 MB, and only lengths leave a task. For byte-level BPE a longer
    text is cut at spaces where no word is cut, and each distinct word of a
    task is encoded once; other kinds encode whole texts.

    A null text counts as an empty one: 0 bytes, 0 tokens. A null id stays
    null, repeated rows are counted each, an empty table gives no rows.
    Nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            n = counter(texts)
            yield pa.record_batch(
                [batch.column(0), pa.array(byte_lengths(texts)), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = pick(docs, id_column, text_column)
    return narrow.select(narrow[id_column].cast("long"), narrow[text_column].cast("string")).mapInArrow(
        count, SCHEMA
    )
