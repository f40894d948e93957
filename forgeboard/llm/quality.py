"""Document quality from its text and from what its site is known for.

A logistic classifier turns a text's shape into evidence. Evidence is summed
by path (a part of a host) and by host, and empirical Bayes shrinks a path's
rate of good documents toward its host's and a host's toward the global one,
the more the fewer documents it has. A document's own evidence is left out of
what its site says about it, and the two are added on the scale of log-odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeboard.llm.frames import pick
from forgeboard.llm.text import (
    BLOCK_BYTES,
    LETTER,
    NUMBER,
    by_bytes,
    classes,
    distinct,
    flat,
    mix,
    plain_words,
    safe_pieces,
    word_hashes,
)
from forgeboard.session import shared_dir, stage_in

#: Labelled documents to learn from.
SAMPLE = 20_000
THRESHOLD = 0.5
#: Bounds of the strength of a prior, in documents.
STRENGTH = (1.0, 1e6)
#: What a text says about its site is held between these log-odds.
EVIDENCE = 12.0

COUNTS = 9  # sums from which the shape follows
KINDS, REPEATS = 6, 7  # the two that do not simply add up over pieces of a text


def _counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: characters, letters, capitals, digits, symbols, words, distinct words, repeats, word characters.

    The second array holds the hashes of all words in order.
    """
    points, at, _ = flat(column)
    n = len(column)
    kind = classes()[points]
    text_of = np.repeat(np.arange(n), np.diff(at))
    letters = kind == LETTER
    capitals = letters & _capital()[points]
    symbols = _symbol()[points]
    starts, ends, text = plain_words(points, at)
    hashes = word_hashes(points, starts, ends)
    _, first = distinct(mix(hashes) ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    repeat = np.append(False, (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])) if len(text) else text
    total = lambda of, weight=None: np.bincount(of, weights=weight, minlength=n)
    return np.stack(
        [
            np.diff(at).astype(float),
            total(text_of, letters),
            total(text_of, capitals),
            total(text_of, kind == NUMBER),
            total(text_of, symbols),
            total(text),
            total(text[first]),
            total(text, repeat.astype(float)),
            total(text, ends - starts),
        ],
        axis=1,
    ), hashes


def _long_counts(text: str) -> np.ndarray:
    """The counts of one long text, taken in pieces; they are those of the whole."""
    sums, kinds, before = np.zeros(COUNTS), np.zeros(0, np.uint64), None
    for piece in safe_pieces(text, BLOCK_BYTES // 2):
        counts, hashes = _counts(pa.array([piece], pa.large_string()))
        sums += counts[0]
        if len(hashes):
            sums[REPEATS] += before is not None and before == hashes[0]
            kinds, before = np.union1d(kinds, hashes), hashes[-1]
    sums[KINDS] = len(kinds)
    return sums


_TABLES: dict[str, np.ndarray] = {}


def _capital() -> np.ndarray:
    if "capital" not in _TABLES:
        found = np.zeros(0x110000, bool)
        found[[c for c in range(0x110000) if chr(c).isupper()]] = True
        _TABLES["capital"] = found
    return _TABLES["capital"]


def _symbol() -> np.ndarray:
    if "symbol" not in _TABLES:
        found = np.zeros(0x110000, bool)
        found[[ord(c) for c in "#*$%&|<>{}[]\\^~_=+@!"]] = True
        _TABLES["symbol"] = found
    return _TABLES["symbol"]


def shape(column: pa.Array) -> np.ndarray:
    """Features of each text; an empty one has zeros."""
    column = column.cast(pa.large_string()).fill_null("")
    sums = np.zeros((len(column), COUNTS))
    for start, stop in by_bytes(column):
        if stop - start == 1 and len(text := column[start].as_py()) > BLOCK_BYTES // 2:
            sums[start] = _long_counts(text)
        else:
            sums[start:stop] = _counts(column.slice(start, stop - start))[0]
    chars, letters, capitals, digits, symbols, words, kinds, repeats, inside = sums.T
    per = lambda a, b: a / np.maximum(b, 1)
    return np.stack(
        [
            np.log1p(words),
            per(capitals, letters),
            per(digits, chars),
            np.sqrt(per(symbols, chars)),
            per(repeats, words),
            # Distinct words grow slower than a text; this keeps long texts comparable.
            np.log1p(kinds) - 0.75 * np.log1p(words),
            per(inside, words),
            per(chars - letters, chars),
        ],
        axis=1,
    )


FEATURES = 8


@dataclass(frozen=True)
class Model:
    """Logistic regression over standardized features and their squares."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last is the constant
    prior: float  # log-odds of a good document among those learnt from

    def _inputs(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.spread, -8, 8)
        return np.concatenate([z, z**2, np.ones((len(z), 1))], axis=1)

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self._inputs(features) @ self.weights, -EVIDENCE, EVIDENCE)


def fit(features: np.ndarray, good: np.ndarray, penalty: float = 1.0, steps: int = 25) -> Model:
    """Penalized logistic regression by Newton steps; without labels of both kinds it says nothing."""
    width = 2 * FEATURES + 1
    if not len(good) or good.all() or not good.any():
        share = (good.sum() + 1) / (len(good) + 2)
        prior = float(np.log(share / (1 - share)))
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.append(np.zeros(width - 1), prior), prior)
    model = Model(features.mean(0), features.std(0) + 1e-6, np.zeros(width), 0.0)
    x, y, w = model._inputs(features), good.astype(float), np.zeros(width)
    ridge = np.append(np.full(width - 1, penalty), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        w = w - move / max(1.0, np.abs(move).max())
    share = y.mean()
    return Model(model.mean, model.spread, w, float(np.log(share / (1 - share))))


def _row_shapes(docs: DataFrame, host: str, path: str) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shape(batch["text"])
            yield pa.record_batch(
                [batch["doc_id"], batch["host"], batch["path"], pa.array(list(found), pa.list_(pa.float64()))],
                names=["doc_id", "host", "path", "features"],
            )

    narrow = pick(docs, "doc_id", host, path, "text").toDF("doc_id", "host", "path", "text")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return narrow.select(
        F.col("doc_id").cast("long"), name("host").alias("host"), name("path").alias("path"), F.col("text").cast("string")
    ).mapInArrow(measure, "doc_id long, host string, path string, features array<double>")


def learn(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows of the lowest hashes, ``sample`` at most."""
    known = (
        pick(labels, "doc_id", "quality")
        .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    thin = known.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(sample)
    taken = (
        rows.select("doc_id", "features")
        .join(thin, "doc_id")
        .orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id", "features")
        .limit(sample)
        .collect()
    )
    features = np.array([r["features"] for r in taken]).reshape(-1, FEATURES)
    return fit(features, np.array([r["quality"] == 1 for r in taken], bool))


def _log_odds_column(model: Model) -> Column:
    """The model over the ``features`` column."""
    z = [
        F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col("features")[i] - F.lit(float(m))) / F.lit(float(s))))
        for i, (m, s) in enumerate(zip(model.mean, model.spread))
    ]
    total = F.lit(float(model.weights[-1]))
    for i, value in enumerate(z):
        total = total + value * float(model.weights[i]) + value * value * float(model.weights[FEATURES + i])
    return F.greatest(F.lit(-EVIDENCE), F.least(F.lit(EVIDENCE), total))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(n: float, squares: float, groups: int, scatter: float, mean: float) -> float:
    """Documents that a prior is worth, by moments: the less groups differ beyond chance, the more."""
    within = mean * (1 - mean)
    if groups < 2 or within <= 0 or n <= 0:
        return STRENGTH[1]
    room = within * (n - squares / n - (groups - 1))
    between = (scatter - (groups - 1) * within) / room if room > 0 else 0.0
    return float(min(max(1 / between - 1, STRENGTH[0]), STRENGTH[1])) if between > 0 else STRENGTH[1]


@dataclass(frozen=True)
class Sites:
    """Posteriors by path, and the global rate."""

    table: DataFrame  # host, path, n, good, host_rate, path_strength
    rate: float
    path_strength: float


def posteriors(evidence: DataFrame, stage) -> Sites:
    """Sum evidence by path and host, estimate prior strengths, shrink hosts toward the global rate.

    ``evidence`` has ``host, path, p``. Sums are formed before each shuffle,
    so a host with a third of all documents weighs no more than another.
    """
    paths = stage(
        "paths", evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("good"))
    )
    hosts = stage("hosts", paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")))

    def moments(groups: DataFrame, n: str, good: str, mean: Column) -> tuple[float, float, int, float]:
        off = F.col(good) / F.col(n) - mean
        row = groups.agg(
            F.sum(n).alias("n"),
            F.sum(F.col(n) * F.col(n)).alias("squares"),
            F.count("*").alias("groups"),
            F.sum(F.col(n) * off * off).alias("scatter"),
        ).first()
        return row["n"] or 0.0, row["squares"] or 0.0, row["groups"], row["scatter"] or 0.0

    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    rate = ((whole["good"] or 0.0) + 0.5) / ((whole["n"] or 0.0) + 1.0)
    of_hosts = _strength(*moments(hosts, "host_n", "host_good", F.lit(rate)), rate)
    shrunk = hosts.select(
        "host", ((F.col("host_good") + of_hosts * rate) / (F.col("host_n") + of_hosts)).alias("host_rate")
    )
    joined = stage("sites", paths.join(shrunk, "host"))
    of_paths = _strength(*moments(joined, "n", "good", F.col("host_rate")), rate)
    return Sites(joined, rate, of_paths)


def _combined(sites: Sites, log_odds: Column) -> Column:
    """Quality of a document: its evidence and its path's posterior without it."""
    p = _sigmoid(log_odds)
    alone = F.greatest(F.lit(0.0), F.col("n") - 1)
    others = F.greatest(F.lit(0.0), F.col("good") - p)
    site = (others + sites.path_strength * F.col("host_rate")) / (alone + sites.path_strength)
    safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), site))
    base = float(np.log(sites.rate / (1 - sites.rate))) if 0 < sites.rate < 1 else 0.0
    return _sigmoid(log_odds + F.log(safe / (1 - safe)) - base)


def _fitted(docs: DataFrame, labels: DataFrame, host: str, path: str) -> tuple[DataFrame, Model, Sites]:
    stage = stage_in(shared_dir(docs.sparkSession, "quality"))
    rows = stage("rows", _row_shapes(docs, host, path))
    model = learn(rows, labels)
    evidence = rows.select("host", "path", _sigmoid(_log_odds_column(model)).alias("p"))
    return rows, model, posteriors(evidence, stage)


def score(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, evidence, site_rate, quality, kept`` for every row.

    ``evidence`` are the log-odds from the text alone, ``site_rate`` the
    host's shrunken rate, ``quality`` the probability from both. Null hosts
    and paths are the site without a name; null and empty texts have the shape
    of zeros. Rows that repeat are scored each; labels given twice count as
    the lower. An empty table gives no rows. Texts are read once; what joins
    are sites and numbers.
    """
    rows, model, sites = _fitted(docs, labels, host, path)
    scored = rows.select("doc_id", "host", "path", _log_odds_column(model).alias("evidence")).join(
        sites.table, ["host", "path"]
    )
    return scored.withColumn("quality", _combined(sites, F.col("evidence"))).select(
        "doc_id",
        "evidence",
        F.col("host_rate").alias("site_rate"),
        "quality",
        (F.col("quality") >= threshold).alias("kept"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs``, all columns, whose quality reaches ``threshold``."""
    _, model, sites = _fitted(docs, labels, host, path)

    @F.arrow_udf("double")
    def log_odds(texts: pa.Array) -> pa.Array:
        return pa.array(model.log_odds(shape(texts)))

    # Else the condition below is also pushed under the join, where every text
    # is measured a second time by a second worker for each task.
    log_odds = log_odds.asNondeterministic()
    # Columns of the input go under numbers meanwhile, so that none clashes.
    columns = docs.columns
    at = {c: f"c{columns.index(c)}" for c in (host, path, "text")}
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    name = lambda c: F.coalesce(F.col(at[c]).cast("string"), F.lit(""))
    marked = plain.withColumns(
        {"host": name(host), "path": name(path), "evidence": log_odds(F.coalesce(F.col(at["text"]), F.lit("")))}
    )
    kept = marked.join(sites.table, ["host", "path"]).filter(_combined(sites, F.col("evidence")) >= threshold)
    return kept.select(*plain.columns).toDF(*columns)
