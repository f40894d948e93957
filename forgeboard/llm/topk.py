"""Exact top-k inner products by elimination with a pivot table.

Distances from every vector to many pivots are computed once. For a query q
and a candidate x each pivot p gives |d(q, p) - d(x, p)| <= d(q, x); the
largest such bound caps the inner product at (|q|^2 + |x|^2 - bound^2) / 2.
Candidates are scored from the highest cap down until the next cap lies below
the k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeboard.llm.frames import partitions_for, pick
from forgeboard.session import shared_dir, stage_in

#: Pivots, and vectors of the bounded sample they are chosen from.
PIVOTS = 32
SAMPLE = 2048
#: Rows of a block of queries and of a block of candidates.
QUERY_ROWS = 2048
BLOCK_ROWS = 8192
#: Candidates scored at a time.
STEP = 256
SCALE = 256.0
#: Sums of products up to this are exact in doubles.
EXACT = float(1 << 53)

TABLE = "vec_id long, dim int, vector binary, distances binary"
FOUND = "query_id long, vec_id long, score long"


def scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 64 bits 2^63 - 1 with their sign."""
    most = np.abs(query).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * max(1, len(query))
    if most < EXACT:
        return (vectors @ query).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(query, row)) for row in vectors]
    return np.array([min(max(s, 1 - (1 << 63)), (1 << 63) - 1) for s in exact], np.int64)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Vectors far apart: each is the one farthest from those before it."""
    chosen = [0]
    nearest = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def caps(query: np.ndarray, q_dist: np.ndarray, norms: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """The most each candidate's score can be, with room for rounding."""
    own = float(query @ query)
    bound = np.abs(dist - q_dist).max(axis=1) if dist.shape[1] else np.zeros(len(norms))
    # Distances come from differences of squares; what that loses is of the
    # order of the squares' rounding.
    slack = 1e-9 * (own + norms) + 1.0
    return (own + norms - bound**2) / 2 + slack + 1e-6 * bound * np.sqrt(own + norms)


def best(query_id: int, query, q_dist, ids, vectors, norms, dist, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of a block, ties to the smaller id."""
    cap = caps(query, q_dist, norms, dist)
    cap[ids == query_id] = -np.inf
    top_ids, top = np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The highest caps first; the score they give ends the search for most others.
    seeds = np.argpartition(-cap, STEP - 1)[:STEP] if len(cap) > STEP else np.arange(len(cap))
    rest = np.ones(len(cap), bool)
    rest[seeds] = False

    def take(rows: np.ndarray) -> None:
        nonlocal top_ids, top
        rows = rows[cap[rows] > -np.inf]
        all_ids = np.concatenate([top_ids, ids[rows]])
        all_scores = np.concatenate([top, scores(query, vectors[rows])])
        order = np.lexsort((all_ids, -all_scores))[:k]
        top_ids, top = all_ids[order], all_scores[order]

    take(seeds)
    left = np.flatnonzero(rest & (cap >= (top[-1] if len(top) == k else -np.inf)))
    left = left[np.argsort(-cap[left], kind="stable")]
    for at in range(0, len(left), STEP):
        if len(top) == k and cap[left[at]] < top[-1]:
            break
        take(left[at : at + STEP])
    return top_ids, top


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _quantized(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, vector``: rows that take part, components floor(256 x) as doubles."""
    narrow = pick(vectors, "vec_id", "embedding").select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")
    )
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = narrow.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            dims = np.diff(rows.offsets.to_numpy())
            values = np.floor(rows.flatten().to_numpy() * SCALE)
            ends = np.cumsum(dims)
            packed = [values[a:b].tobytes() for a, b in zip(ends - dims, ends)]
            yield pa.record_batch(
                [batch.column(0), pa.array(dims.astype(np.int32)), pa.array(packed, pa.binary())],
                names=["vec_id", "dim", "vector"],
            )

    return usable.mapInArrow(scale, "vec_id long, dim int, vector binary")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all rows for each query.

    Queries are the rows whose ``vec_id`` is divisible by ``every``;
    candidates are all rows but those of the query's own id. Scores are
    integer inner products of the components floor(256 x), ties go to the
    smaller id. Only vectors of one length are compared. Vectors that are
    null, empty, or hold null or non-finite components take no part, nor do
    rows without id; a row repeated in full counts once. An empty table gives
    no rows.

    The vectors are written once with their distances to the pivots, which
    come from a sample of ``SAMPLE`` vectors (any choice of pivots gives the
    same result). Blocks of queries meet blocks of candidates, both of bounded
    size and filled by a hash, and each pair of blocks gives k rows a query.
    """
    spark = vectors.sparkSession
    stage = stage_in(shared_dir(spark, "topk"))
    plain = stage("vectors", _quantized(vectors).dropDuplicates(["vec_id", "dim", "vector"]))
    n = plain.count()
    share = min(1.0, 4.0 * SAMPLE / max(n, 1))
    drawn = (
        plain.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        .orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", "vector")
        .limit(SAMPLE)
        .collect()
    )
    by_dim: dict[int, list[np.ndarray]] = {}
    for row in drawn:
        by_dim.setdefault(row["dim"], []).append(np.frombuffer(row["vector"], np.float64))
    marks = {dim: choose_pivots(np.array(rows), pivots) for dim, rows in by_dim.items()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            found = np.full(len(batch), b"", object)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                own = _matrix(batch["vector"].take(pa.array(rows)), dim)
                if dim in marks:
                    found[rows] = [d.tobytes() for d in distances(own, marks[dim])]
            yield pa.record_batch(
                [batch["vec_id"], batch["dim"], batch["vector"], pa.array(found.tolist(), pa.binary())],
                names=["vec_id", "dim", "vector", "distances"],
            )

    known = stage("measured", plain.mapInArrow(measure, TABLE))
    queries = known.filter(F.col("vec_id") % every == 0)
    blocks = partitions_for(n, BLOCK_ROWS)
    query_blocks = partitions_for(queries.count(), QUERY_ROWS)
    left = queries.select(
        "*",
        F.pmod(F.xxhash64("vec_id", "vector"), F.lit(query_blocks)).cast("int").alias("q"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"),
    )
    right = known.select(
        "*",
        F.pmod(F.xxhash64("vec_id", "vector", F.lit(9)), F.lit(blocks)).cast("int").alias("b"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"),
    )

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        asking, held = asking.combine_chunks(), held.combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(asking) and len(held):
            dim = asking["dim"][0].as_py()
            known_pivots = len(marks[dim]) if dim in marks else 0

            def block(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                dist = _matrix(t["distances"], known_pivots) if known_pivots else np.zeros((len(t), 0))
                return t["vec_id"].to_numpy(), _matrix(t["vector"], dim), dist

            q_ids, q_vectors, q_dist = block(asking)
            ids, own, dist = block(held)
            norms = (own**2).sum(1)
            for i, query_id in enumerate(q_ids):
                top_ids, top = best(int(query_id), q_vectors[i], q_dist[i], ids, own, norms, dist, k)
                out.append((np.full(len(top), query_id, np.int64), top_ids, top))
        found = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

    local = left.groupBy("dim", "q", "b").cogroup(right.groupBy("dim", "q", "b")).applyInArrow(meet, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        local.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
