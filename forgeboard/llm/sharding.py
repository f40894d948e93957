"""Shards of equal bytes from a k-d tree over the documents' metadata.

A node that is to hold several shards is cut along its widest dimension at the
weighted median (the quantile that its two sides' shard counts ask for).
Medians come from histograms summed over the cluster: every dimension is laid
on a grid of ``GRID`` steps, and within the step where the median falls a hash
of the unit decides. Units that weigh a noticeable part of a shard are placed
whole, by their own step; the cut through all the others makes up for them.
The driver sees sums of at most nodes x dimensions x ``GRID`` cells and at
most ``HEAVY`` units a shard.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from forgeboard.llm.frames import partitions_for, pick
from forgeboard.session import shared_dir, stage_in

SHARDS = 40
OVERHEAD = 16
GRID = 1024
#: Steps of the hash within a grid step.
FINE = 4096
#: Copies of one text stay together up to this part of a shard: a half.
TOGETHER = 2
#: A unit over this part of a shard, a 64th, is placed by itself.
HEAVY = 64
#: Rows that are numbered in one window.
CHUNK_ROWS = 20_000

KEY = ["h", "text_crc32", "cut"]
BOUNDS = "node int, dim int, step int, bound int, half int"


@dataclass
class Node:
    """A leaf of the tree so far, with the shards from ``first`` on and the heavy units in it."""

    first: int
    shards: int
    heavy: list[Row] = field(default_factory=list)


def _scaled(value: Column, low: float | None, high: float | None) -> Column:
    if low is None or high is None or high <= low:
        return F.lit(0)
    step = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(GRID - 1))
    return F.coalesce(step, F.lit(0)).cast("int")


def _named(value: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(value, F.lit(""))), F.lit(GRID)).cast("int")


def _units(rows: DataFrame, target: float) -> tuple[DataFrame, DataFrame]:
    """Rows with the unit they belong to, and units: the copies of one text, cut where they are many.

    A text whose rows outweigh ``target / TOGETHER`` is cut by a hash of its
    rows into units far lighter than ``target / HEAVY``. Few texts weigh as
    much: at most ``TOGETHER`` a shard, whatever the number of documents.
    """
    text = ["h", "text_crc32"]
    weights = rows.groupBy(*text).agg(F.sum("size").alias("weight"))
    large = weights.filter(F.col("weight") > F.lit(target / TOGETHER)).select(
        *text, F.ceil(F.col("weight") / F.lit(max(1.0, target / HEAVY / 4))).cast("long").alias("cuts")
    )
    cut = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), F.col("cuts")))
    marked = rows.join(F.broadcast(large), text, "left").withColumn("cut", cut.cast("long")).drop("cuts")
    units = marked.groupBy(*KEY).agg(
        F.sum("size").alias("bytes"),
        F.max("size").alias("largest"),
        F.min("lang").alias("lang"),
        F.min("source").alias("source"),
        F.min("doc_id").alias("doc_id"),
    )
    return marked, units


def _cut_point(cells: list[tuple[int, int]], share: float) -> tuple[int, float]:
    """The step where the cumulated weight passes ``share``, and the weight before it."""
    before = 0
    for step, weight in cells:
        if before + weight >= share:
            return step, before
        before += weight
    return cells[-1][0], before - cells[-1][1]


def _sides(heavy: list[Row], dim: str, step: int, room: float) -> tuple[list[Row], list[Row]]:
    """Heavy units below and above a step; of those on it, the largest that still fit go below."""
    left = [r for r in heavy if r[dim] < step]
    right = [r for r in heavy if r[dim] > step]
    room -= sum(r["bytes"] for r in left)
    for r in sorted((r for r in heavy if r[dim] == step), key=lambda r: (-r["bytes"], *(r[k] for k in KEY))):
        fits = r["bytes"] <= room
        (left if fits else right).append(r)
        room -= r["bytes"] * fits
    return left, right


def _tree(units: DataFrame, shards: int, least: float) -> DataFrame:
    """``h, text_crc32, cut, shard`` of all units, from their ``bytes`` and grid steps ``d0..`` and ``u``.

    All units start in ``node`` 0, a stored column. Light ones carry the number
    of their node from level to level through a table of at most ``shards``
    bounds, so a level adds one small step to the plan. Heavy ones, over
    ``least`` bytes, are placed here.
    """
    spark = units.sparkSession
    dims = [c for c in units.columns if c.startswith("d") and c[1:].isdigit()]
    heavy = units.filter(F.col("bytes") > F.lit(least)).select(*KEY, "bytes", *dims).collect()
    at = units.filter(F.col("bytes") <= F.lit(least))
    kept = [c for c in units.columns if c != "node"]
    nodes = [Node(0, shards, heavy)]
    while open_nodes := [n for n in nodes if n.shards > 1]:
        known = spark.createDataFrame([(n.first,) for n in open_nodes], "node int")
        inside = at.join(F.broadcast(known), "node", "left_semi")
        light: dict[tuple[int, int], Counter[int]] = {}
        for r in (
            inside.select("node", "bytes", F.posexplode(F.array(*dims)).alias("dim", "step"))
            .groupBy("node", "dim", "step")
            .agg(F.sum("bytes").alias("weight"))
            .collect()
        ):
            light.setdefault((r["node"], r["dim"]), Counter())[r["step"]] = r["weight"]
        grown: list[Node] = [n for n in nodes if n.shards == 1]
        cuts: list[tuple[Node, int, int, float]] = []
        for node in open_nodes:
            half = node.shards // 2
            left: list[Row] = []
            right: list[Row] = []
            cells = []
            for d, name in enumerate(dims):
                both = Counter(light.get((node.first, d), Counter()))
                for r in node.heavy:
                    both[r[name]] += r["bytes"]
                cells.append(sorted(both.items()))
            if cells[0]:
                widest = max(range(len(dims)), key=lambda d: (cells[d][-1][0] - cells[d][0][0], -d))
                share = sum(w for _, w in cells[widest]) * half / node.shards
                step, _ = _cut_point(cells[widest], share)
                left, right = _sides(node.heavy, dims[widest], step, share)
                if (node.first, widest) in light:
                    # What the heavy units leave of the share is cut off the light ones.
                    share -= sum(r["bytes"] for r in left)
                    step, before = _cut_point(sorted(light[node.first, widest].items()), share)
                    cuts.append((node, widest, step, share - before))
            grown.append(Node(node.first, half, left))
            grown.append(Node(node.first + half, node.shards - half, right))
        nodes = grown
        if not cuts:
            continue
        value = F.get(F.array(*dims), F.col("dim"))
        steps = spark.createDataFrame([(n.first, dim, step) for n, dim, step, _ in cuts], "node int, dim int, step int")
        on_step = inside.join(F.broadcast(steps), "node").filter(value == F.col("step"))
        fine: dict[int, list[tuple[int, int]]] = {}
        for r in on_step.groupBy("node", "u").agg(F.sum("bytes").alias("weight")).collect():
            fine.setdefault(r["node"], []).append((r["u"], r["weight"]))
        bounds = []
        for node, dim, step, share in cuts:
            own = sorted(fine[node.first])
            u, before = _cut_point(own, share)
            # The nearer side of the step of the hash.
            bound = u + 1 if share - before > dict(own)[u] / 2 else u
            bounds.append((node.first, dim, step, bound, node.shards // 2))
        right_side = (value > F.col("step")) | ((value == F.col("step")) & (F.col("u") >= F.col("bound")))
        at = at.join(F.broadcast(spark.createDataFrame(bounds, BOUNDS)), "node", "left").select(
            *kept, F.when(right_side, F.col("node") + F.col("half")).otherwise(F.col("node")).alias("node")
        )
    placed = [(*(r[k] for k in KEY), n.first) for n in nodes for r in n.heavy]
    alone = spark.createDataFrame(placed, "h long, text_crc32 long, cut long, shard int")
    return at.select(*KEY, F.col("node").cast("int").alias("shard")).unionByName(alone)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    The law is ``bytes``: shards hold nearly equal sums of ``size``, the UTF-8
    bytes of the text and 16 (a null text has none). Dimensions are the size
    on a log scale, the language, the source, and the id. Rows of one text
    stay in one shard unless they make more than half a shard; then they are
    cut by a hash. ``slot`` counts from 0 in each shard without gaps and is
    drawn from small chunks of rows. ``grown_shard`` is null.

    Null languages and sources count as empty names and null ids as the
    lowest; rows that repeat are rows of their own; an empty table gives no
    rows. Texts are read once, and only ids, sizes and hashes are kept.
    """
    stage = stage_in(shared_dir(docs.sparkSession, "sharding"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stage(
        "rows",
        pick(docs, "doc_id", "text", "lang", "source").select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.col("lang").cast("string"),
            F.col("source").cast("string"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )
    span = rows.agg(
        F.count("*").alias("n"),
        F.sum("size").alias("bytes"),
        F.log2(F.min("size")).alias("size_low"),
        F.log2(F.max("size")).alias("size_high"),
        F.min("doc_id").cast("double").alias("id_low"),
        F.max("doc_id").cast("double").alias("id_high"),
    ).first()
    target = (span["bytes"] or 0) / shards
    marked, found = _units(rows, target)
    units = stage(
        "units",
        found.select(
            *KEY,
            "bytes",
            _scaled(F.log2("largest"), span["size_low"], span["size_high"]).alias("d0"),
            _named(F.col("lang")).alias("d1"),
            _named(F.col("source")).alias("d2"),
            _scaled(F.col("doc_id").cast("double"), span["id_low"], span["id_high"]).alias("d3"),
            F.pmod(F.xxhash64(*KEY, F.lit(7)), F.lit(FINE)).cast("int").alias("u"),
            F.lit(0).alias("node"),
        ),
    )
    placed = marked.join(_tree(units, shards, target / HEAVY), KEY)
    chunks = partitions_for(span["n"], CHUNK_ROWS)
    dealt = stage(
        "dealt",
        placed.select(
            "doc_id", "size", "text_crc32", "shard", "row", F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk")
        ),
    )
    earlier = F.sum("held").over(
        Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        dealt.groupBy("shard", "chunk")
        .agg(F.count("*").alias("held"))
        .select("shard", "chunk", F.coalesce(earlier, F.lit(0)).alias("before"))
    )
    nth = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "row")) - 1
    return (
        dealt.withColumn("nth", nth)
        .join(before, ["shard", "chunk"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
