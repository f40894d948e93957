"""Token ids in Arrow files of equal-length sequences.

A data file is the Arrow stream of record batches with its footer. A row is
one sequence: ``input_ids`` and ``mask`` are fixed-size lists, so the place of
any token follows from its number, and a memory-mapped file gives it without
a copy. Documents follow each other without gaps; only the last sequence of a
file is filled up, with its mask false there. An index file beside it says
where each document starts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forgeboard.llm import encoder
from forgeboard.llm.frames import partitions_for, pick
from forgeboard.session import shared_dir, stage_in

SEQUENCE = 2048
END_ID = 2
#: Sequences in a record batch, and bytes of text that go to one file.
BATCH_ROWS = 64
FILE_BYTES = 32 << 20

MANIFEST = "part int, file string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Where a path or URI lies. The folder must be shared by driver and executors."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Cuts a stream of ids into the sequences of one data file."""

    def __init__(self, path: str, dtype, sequence: int = SEQUENCE):
        self.sequence, self.dtype = sequence, np.dtype(dtype)
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema(
            [("input_ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))]
        )
        files, plain = filesystem(path)
        self._out = files.open_output_stream(plain)
        self._file = pa.ipc.new_file(self._out, self.schema)
        self._rest = np.zeros(0, self.dtype)
        self.tokens = 0

    def add(self, ids: np.ndarray) -> None:
        self._rest = np.concatenate([self._rest, ids.astype(self.dtype, copy=False)])
        self.tokens += len(ids)
        size = self.sequence * BATCH_ROWS
        whole = len(self._rest) // size * size
        for at in range(0, whole, size):
            self._put(self._rest[at : at + size], size)
        self._rest = self._rest[whole:].copy()

    def _put(self, ids: np.ndarray, held: int) -> None:
        mask = pa.array(np.arange(len(ids)) < held)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.sequence),
            pa.FixedSizeListArray.from_arrays(mask, self.sequence),
        ]
        self._file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        held = len(self._rest)
        if held:
            full = -(-held // self.sequence) * self.sequence
            self._put(np.concatenate([self._rest, np.zeros(full - held, self.dtype)]), held)
        self._file.close()
        self._out.close()


class Reader:
    """Random access to the tokens of a data file."""

    def __init__(self, path: str):
        files, plain = filesystem(path)
        local = isinstance(files, fs.LocalFileSystem)
        self._source = pa.memory_map(plain) if local else files.open_input_file(plain)
        self._file = pa.ipc.open_file(self._source)
        self.sequence = self._file.schema.field("input_ids").type.list_size
        self._at = -1

    def _batch(self, number: int) -> np.ndarray:
        if number != self._at:
            batch = self._file.get_batch(number)
            self._ids = batch.column(0).values.to_numpy()
            self._mask, self._at = batch.column(1).values, number
        return self._ids

    def tokens(self, start: int, count: int) -> Iterator[np.ndarray]:
        """Views of the ids from token ``start`` on, one for each record batch they lie in."""
        size = self.sequence * BATCH_ROWS
        while count > 0:
            number, at = divmod(start, size)
            found = self._batch(number)[at : at + count]
            if not len(found) or not self._mask[at + len(found) - 1].as_py():
                raise ValueError("tokens beyond the end of the file")
            yield found
            start, count = start + len(found), count - len(found)

    def row(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        batch, at = divmod(number, BATCH_ROWS)
        ids = self._batch(batch)
        cut = slice(at * self.sequence, (at + 1) * self.sequence)
        return ids[cut], self._mask[cut].to_numpy(zero_copy_only=False)

    def close(self) -> None:
        self._source.close()


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = END_ID,
    sequence: int = SEQUENCE,
) -> DataFrame:
    """Write all documents in ascending ``doc_id`` order; returns the manifest of files.

    ``part`` orders the files, ``n_tokens`` counts each file's ids. Files are
    named by the attempt that wrote them and count only through the manifest,
    which holds those of finished tasks; what a lost task left is ignored.
    Texts are dealt out by range and sorted in each task, about 32 MB each;
    ids are kept in the smallest type the vocabulary allows.

    Null and empty texts have the end id alone. Null ids come first, rows of
    one id in the order of their texts' hashes; repeated rows are written
    each. An empty table gives no files.
    """
    spark = docs.sparkSession
    narrow = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tie = F.xxhash64("text")
    dealt = narrow.repartitionByRange(partitions_for(total, FILE_BYTES), "doc_id", tie).sortWithinPartitions(
        "doc_id", tie
    )
    dtype = encoder.smallest_type(tokenizer)
    files, plain = filesystem(folder)
    files.create_dir(plain, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder.encoder(tokenizer)
        part = TaskContext.get().partitionId()
        base = f"{folder}/{part:06d}-{uuid.uuid4().hex[:12]}"
        out = index = None
        n_docs = 0
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                out = Writer(f"{base}.arrow", dtype, sequence)
                where, path = filesystem(f"{base}.index.arrow")
                under = where.open_output_stream(path)
                index = pa.ipc.new_file(under, INDEX)
            flat, counts = words.encode(batch.column(1))
            sizes = counts + 1
            starts = out.tokens + np.cumsum(sizes) - sizes
            out.add(np.insert(flat, np.cumsum(counts), end_id))
            index.write_batch(
                pa.record_batch([batch.column(0), pa.array(starts), pa.array(sizes)], schema=INDEX)
            )
            n_docs += len(batch)
        if out is not None:
            out.close()
            index.close()
            under.close()
            yield pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([base]), pa.array([n_docs]), pa.array([out.tokens])],
                names=["part", "file", "n_docs", "n_tokens"],
            )

    return stage_in(shared_dir(spark, "arrow-manifest"))("files", dealt.mapInArrow(put, MANIFEST))


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it, over all files.
    """
    earlier = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = manifest.select("part", "file", F.coalesce(earlier, F.lit(0)).alias("base"))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist()):
                data = Reader(f"{file}.arrow")
                files, path = filesystem(f"{file}.index.arrow")
                with files.open_input_file(path) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        held = index.get_batch(k)
                        crcs = []
                        for start, n in zip(held["start"].to_pylist(), held["n_tokens"].to_pylist()):
                            crc = 0
                            for ids in data.tokens(start, n):
                                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            crcs.append(crc)
                        yield pa.record_batch(
                            [
                                held["doc_id"],
                                pa.array(held["start"].to_numpy() + base),
                                held["n_tokens"],
                                pa.array(crcs, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                data.close()

    return based.repartition(max(1, manifest.count()), "part").mapInArrow(get, READ)
