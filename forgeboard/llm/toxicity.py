"""Toxic spans and document scores from a linear-chain conditional random field.

The field tags the words of a text as toxic or not, in sequences of up to
``SEQUENCE`` words. Emissions come from hashed features of the word (itself,
its first letters, its last), transitions from the tags side by side. Forward
and backward passes give each word's marginal; a document's score is the
highest marginal of its words.

Labels are known for whole documents only, so the words to learn from are
labelled by evidence from every labelled document that is not held out: a
feature's support in toxic documents, counted by the different words it stands
after, as copies have few, against the clean documents that hold it. Later
rounds weigh what the toxic documents not yet explained hold, where the same
certainty asks for fewer documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeboard.llm.frames import pick
from forgeboard.llm.text import (
    BLOCK_BYTES,
    LETTER,
    by_bytes,
    classes,
    distinct,
    flat,
    mix,
    runs,
    safe_pieces,
    word_hashes,
)
from forgeboard.session import shared_dir, stage_in

SEQUENCE = 64
#: Hashed features; 0 is the one that every word has.
SPACE = 1 << 18
PREFIXES = (4, 5, 6)
#: The most toxic documents to learn from (of clean ones twice as many), and the bytes of one.
SAMPLE = 1000
SAMPLE_BYTES = 1 << 15
#: Labels (an id and a flag each) that are sent to every executor at most.
SENT_LABELS = 4_000_000
#: Sequences to learn from.
MOST_SEQUENCES = 8000
THRESHOLD = 0.7
#: Odds against chance, and shrunken odds for toxic documents, that a feature must reach; rounds of search.
CHANCE, ODDS, ROUNDS = 1e7, 20, 4

SCORED = (
    "doc_id long, held_out boolean, score double, predicted int, "
    "spans array<struct<start:long,end:long,probability:double>>"
)


@functools.cache
def lower_case() -> np.ndarray:
    """The small letter of every code point that has one of one character."""
    every = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (small := chr(c).lower()) != chr(c) and len(small) == 1:
            every[c] = ord(small)
    return every


@dataclass
class Words:
    """The words of some texts, their kinds, and the features of each kind."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    kinds: np.ndarray
    features: np.ndarray  # kinds x features, 64 bits each
    at: np.ndarray


def words_of(column: pa.Array) -> Words:
    points, at, _ = flat(column)
    points = lower_case()[points]
    starts, ends = runs(classes()[points] == LETTER, at)
    kinds, first = distinct(word_hashes(points, starts, ends))
    s, e = starts[first], ends[first]
    salt = lambda h, k: mix(h + np.uint64(k * 0x51ED27 + 1))
    columns = [salt(word_hashes(points, s, e), 0)]
    columns += [salt(word_hashes(points, s, np.minimum(s + k, e)), k) for k in PREFIXES]
    columns.append(salt(word_hashes(points, np.maximum(e - 3, s), e), 99))
    features = np.stack(columns, axis=1) if len(s) else np.zeros((0, len(PREFIXES) + 2), np.uint64)
    return Words(np.searchsorted(at, starts, "right") - 1, starts, ends, kinds, features, at)


def words_of_sample(texts: list[str]) -> Words:
    """The same for a sample, taken 1 MB at a time to keep memory low."""
    column = pa.array(texts, pa.large_string())
    parts = [(a, words_of(column.slice(a, b - a))) for a, b in by_bytes(column, 1 << 20)]
    features = np.concatenate([w.features for _, w in parts])
    offsets = np.cumsum([0, *(len(w.features) for _, w in parts)])
    kinds, first = distinct(features[:, 0]) if len(features) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    join = lambda arrays: np.concatenate([*arrays, np.zeros(0, np.int64)])
    return Words(
        join([w.text + a for a, w in parts]),
        join([w.starts for _, w in parts]),
        join([w.ends for _, w in parts]),
        kinds[join([w.kinds + o for (_, w), o in zip(parts, offsets)])],
        features[first],
        np.zeros(0, np.int64),
    )


def windows(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each word where rows are sequences of one text's consecutive words."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.arange(len(text))
    opens = np.append(True, text[1:] != text[:-1])
    within = number - np.maximum.accumulate(np.where(opens, number, 0))
    return np.cumsum(opens | (within % SEQUENCE == 0)) - 1, within % SEQUENCE


@dataclass
class Field:
    """Weights of the features, and of tag pairs ``[before, after]``."""

    weights: np.ndarray
    pairs: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Log-odds of the toxic tag for each kind of word."""
        return self.weights[(features % np.uint64(SPACE)).astype(np.int64)].sum(axis=1) + self.weights[0]


def forward_backward(
    emission: np.ndarray, held: np.ndarray, pairs: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic tag, expected tag pairs, and log-normalizers.

    Rows are sequences, ``held`` says which columns have a word; a sequence's
    words come first in its row.
    """
    n, t = emission.shape
    ahead = np.zeros((t, n, 2))
    scale = np.zeros((t, n))
    step = np.exp(pairs - pairs.max())
    shift = np.maximum(emission, 0)
    own = np.stack([np.exp(-shift), np.exp(emission - shift)], axis=-1)
    for k in range(t):
        now = own[:, k] if k == 0 else (ahead[k - 1] @ step) * own[:, k]
        now = np.where(held[:, k, None], now, ahead[k - 1] if k else 0.5)
        total = now.sum(axis=1)
        scale[k] = np.where(held[:, k], np.log(total), 0)
        ahead[k] = now / total[:, None]
    behind = np.ones((n, 2))
    marginal = np.zeros((n, t))
    both = np.zeros((2, 2))
    for k in range(t - 1, -1, -1):
        joint = ahead[k] * behind
        marginal[:, k] = joint[:, 1] / joint.sum(axis=1)
        if k:
            message = own[:, k] * behind
            pair = ahead[k - 1][:, :, None] * step[None] * message[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            both += pair[held[:, k]].sum(axis=0)
            fresh = message @ step.T
            fresh /= fresh.sum(axis=1, keepdims=True)
            behind = np.where(held[:, k, None], fresh, behind)
    log_total = scale.sum(axis=0) + (shift * held).sum(axis=1) + pairs.max() * np.maximum(held.sum(axis=1) - 1, 0)
    return np.where(held, marginal, 0), both, log_total


def _blocks(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Pieces of texts, and the number of the text each is from."""
    texts = texts.cast(pa.large_string()).fill_null("")
    for start, stop in by_bytes(texts):
        if stop - start == 1 and len(text := texts[start].as_py()) > BLOCK_BYTES // 2:
            for piece in safe_pieces(text, BLOCK_BYTES // 2):
                yield pa.array([piece], pa.large_string()), np.array([start])
        else:
            yield texts.slice(start, stop - start), np.arange(start, stop)


#: Features of a task that are added up together.
HELD_TOGETHER = 1 << 20


def _clean_features(texts: DataFrame) -> DataFrame:
    """``feature, clean``: in how many of these texts (pieces of long ones) a feature is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            keys, held = np.unique(np.concatenate(parts), return_counts=True)
            return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(held)], names=["feature", "clean"])

        for batch in batches:
            for part, _ in _blocks(batch["text"]):
                words = words_of(part)
                _, first = distinct(words.text * len(words.features) + words.kinds)
                wide = words.features.shape[1] - 1  # endings tell too little by themselves
                found = words.features[words.kinds[first], :-1].ravel()
                of = np.repeat(words.text[first], wide).astype(np.uint64)
                _, first = distinct(mix(found) ^ (of * np.uint64(0x9E3779B97F4A7C15)))
                parts.append(found[first])
                if sum(map(len, parts)) > HELD_TOGETHER:
                    yield rows()
                    parts.clear()
        if parts:
            yield rows()

    return texts.select("text").mapInArrow(count, "feature long, clean long").groupBy("feature").agg(
        F.sum("clean").alias("clean")
    )


def _settings(texts: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """``feature, before, docs`` from texts without a word of ``lexicon``, all of them different.

    A row is a setting, a feature after a certain word, once for every block
    of texts. ``docs`` sums up to the number of texts that hold the feature:
    the first setting of a feature in a block carries it. Feature 0 is in all texts.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in _blocks(batch["text"]):
                words = words_of(part)
                wide = words.features.shape[1] - 1
                known = np.isin(words.features[:, :-1], lexicon).any(axis=1)
                told = np.zeros(len(part), bool)
                told[words.text[known[words.kinds]]] = True
                before = np.append(np.uint64(0), words.features[words.kinds[:-1], 0])
                before[: len(words.text)][np.append(True, words.text[1:] != words.text[:-1])[: len(words.text)]] = 0
                use = np.flatnonzero(~told[words.text])
                found = words.features[words.kinds[use], :-1].ravel()
                prior, of = np.repeat(before[use], wide), np.repeat(words.text[use], wide)
                # In how many texts of the block each feature is.
                _, once = distinct(mix(found) ^ mix(of.astype(np.uint64)))
                keys, held = np.unique(found[once], return_counts=True)
                _, first = distinct(mix(mix(found) ^ prior))
                found, prior = found[first], prior[first]
                order = np.argsort(found, kind="stable")
                found, prior = found[order], prior[order]
                docs = np.zeros(len(found), np.int64)
                docs[np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])] = held
                whole = int((~told).sum())
                yield pa.record_batch(
                    [
                        pa.array(np.append(found.view(np.int64), 0)),
                        pa.array(np.append(prior.view(np.int64), 0)),
                        pa.array(np.append(docs, whole)),
                    ],
                    names=["feature", "before", "docs"],
                )

    return texts.select("text").mapInArrow(find, "feature long, before long, docs long")


def telling(labelled: DataFrame) -> np.ndarray:
    """Features that tell toxic documents, from all rows ``text, toxic``.

    By a Chernoff bound chance would hardly (1 in ``CHANCE``) have dealt a
    feature's settings to toxic documents so often. Only features that pass
    reach the driver.
    """
    stage = stage_in(shared_dir(labelled.sparkSession, "toxicity"))
    clean = labelled.filter("toxic = 0")
    n_clean = float(clean.count())
    clean = stage("clean", _clean_features(clean))
    toxic = stage("toxic", labelled.filter("toxic = 1").select("text").distinct())
    lexicon = np.zeros(0, np.uint64)
    for step in range(ROUNDS):
        support = stage(
            f"toxic-{step}",
            _settings(toxic, lexicon).groupBy("feature", "before").agg(F.sum("docs").alias("docs"))
            .groupBy("feature").agg(F.count("*").alias("settings"), F.sum("docs").alias("docs"))
            .select("feature", F.least("settings", "docs").cast("double").alias("held"), "docs"),
        )
        whole = support.filter("feature = 0").first()
        if whole is None or not n_clean:
            break
        left = float(whole["docs"])
        chance = left / (left + n_clean)
        c = F.coalesce("clean", F.lit(0)).cast("double")
        share = F.col("held") / (F.col("held") + c)
        apart = F.col("held") * F.log(share / chance) + F.when(c > 0, c * F.log((1 - share) / (1 - chance))).otherwise(F.lit(0.0))
        odds = (F.col("held") + 0.5) * n_clean / ((c + 0.5) * left)
        fit = (F.col("feature") != 0) & (F.col("held") >= 2) & (share > chance) & (apart >= float(np.log(CHANCE))) & (odds >= ODDS)
        found = support.join(clean, "feature", "left").filter(fit).select("feature").collect()
        if not found:
            break
        lexicon = np.union1d(lexicon, np.array([r["feature"] for r in found], np.int64).view(np.uint64))
    return lexicon


def blank() -> Field:
    """A field that finds nothing."""
    field = Field(np.zeros(SPACE), np.zeros((2, 2)))
    field.weights[0] = -8.0
    return field


def fit(texts: list[str], toxic: list[bool], lexicon: np.ndarray, steps: int = 40, rate: float = 0.35, decay: float = 1e-3) -> Field:
    """The field from labelled documents; all of them clean or toxic gives one that finds nothing."""
    truth = np.asarray(toxic, bool)
    if not truth.any() or truth.all():
        return blank()
    words = words_of_sample(texts)
    if not len(words.kinds):
        return blank()
    if not len(lexicon):
        return blank()
    kind_label = np.isin(words.features[:, :-1], lexicon).any(axis=1)
    label = kind_label[words.kinds] & truth[words.text]
    row, column = windows(words.text)
    # Sequences with a toxic word, and as many of clean documents, spread evenly.
    with_label = np.bincount(row, weights=label) > 0
    others = ~with_label & ~truth[words.text[np.flatnonzero(column == 0)]]
    keep = np.zeros(len(with_label), bool)
    for some in (np.flatnonzero(with_label), np.flatnonzero(others)):
        keep[some[:: -(-len(some) // (MOST_SEQUENCES // 2)) or 1]] = True
    number = np.cumsum(keep) - 1
    use = keep[row]
    used, kinds = np.unique(words.kinds[use], return_inverse=True)
    row, column, label = number[row[use]], column[use], label[use]
    held = np.zeros((int(keep.sum()), SEQUENCE), bool)
    held[row, column] = True
    features = np.concatenate(
        [
            np.zeros((len(used), 1), np.int64),
            (words.features[used] % np.uint64(SPACE)).astype(np.int64),
        ],
        axis=1,
    )
    tags = np.zeros(held.shape, np.int64)
    tags[row, column] = label
    seen_pairs = np.zeros((2, 2))
    beside = held[:, 1:]
    np.add.at(seen_pairs, (tags[:, :-1][beside], tags[:, 1:][beside]), 1)

    field = Field(np.zeros(SPACE), np.zeros((2, 2)))
    field.weights[0] = -3.0
    momentum, square = np.zeros(SPACE + 4), np.zeros(SPACE + 4)
    for step in range(1, steps + 1):
        emission = np.zeros(held.shape)
        by_kind = field.weights[features].sum(axis=1)
        emission[row, column] = by_kind[kinds]
        marginal, both, _ = forward_backward(emission, held, field.pairs)
        slope_kind = np.bincount(kinds, weights=marginal[row, column] - label, minlength=len(features))
        slope = np.bincount(
            features.ravel(), weights=np.repeat(slope_kind, features.shape[1]), minlength=SPACE
        )
        slope = np.concatenate([slope + decay * field.weights, (both - seen_pairs).ravel() + decay * field.pairs.ravel()])
        momentum = 0.9 * momentum + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        move = rate * (momentum / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        field.weights -= move[:SPACE]
        field.pairs -= move[SPACE:].reshape(2, 2)
    # Telling features outside the sample weigh as much as the words labelled in it.
    unseen = lexicon[~np.isin(lexicon, words.features[:, :-1])]
    if label.any() and len(unseen):
        typical = float(np.median(field.emissions(words.features[kind_label])))
        at = (unseen % np.uint64(SPACE)).astype(np.int64)
        field.weights[at] = np.maximum(field.weights[at], typical - field.weights[0])
    return field


def tag(field: Field, column: pa.Array, with_spans: bool = True) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and toxic spans (code point offsets) of each text."""
    scores = np.zeros(len(column))
    spans: list[list[dict]] = [[] for _ in range(len(column))]

    def block(part: pa.Array, number: np.ndarray, shift: int) -> None:
        words = words_of(part)
        if not len(words.kinds):
            return
        row, place = windows(words.text)
        held = np.zeros((int(row[-1]) + 1, SEQUENCE), bool)
        held[row, place] = True
        emission = np.zeros(held.shape)
        emission[row, place] = field.emissions(words.features)[words.kinds]
        marginal = forward_backward(emission, held, field.pairs)[0][row, place]
        np.maximum.at(scores, number[words.text], marginal)
        if not with_spans:
            return
        hit = np.flatnonzero(marginal >= 0.5)
        for i in hit.tolist():
            text = int(words.text[i])
            base = int(words.at[text]) - shift
            start, end, p = int(words.starts[i]) - base, int(words.ends[i]) - base, float(marginal[i])
            own = spans[number[text]]
            if own and i and own[-1]["word"] == i - 1 and words.text[i - 1] == text:
                own[-1] |= {"end": end, "word": i, "probability": max(p, own[-1]["probability"])}
            else:
                own.append({"start": start, "end": end, "word": i, "probability": p})

    column = column.cast(pa.large_string()).fill_null("")
    for start, stop in by_bytes(column):
        if stop - start == 1 and len(text := column[start].as_py()) > BLOCK_BYTES // 2:
            shift = 0
            for piece in safe_pieces(text, BLOCK_BYTES // 2):
                block(pa.array([piece], pa.large_string()), np.array([start]), shift)
                shift += len(piece)
        else:
            block(column.slice(start, stop - start), np.arange(start, stop), 0)
    clean = [[{k: s[k] for k in ("start", "end", "probability")} for s in own] for own in spans]
    return scores, clean


def held_out(doc_id):
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on a bounded sample of the labelled documents that are not held out, by the evidence of all of them.

    Of either kind those of the lowest hashes are taken, ``sample`` toxic and
    twice as many clean ones at most and each of ``SAMPLE_BYTES`` at most; equal texts count once.
    """
    known = pick(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    texts = (
        pick(docs, "doc_id", "text")
        .filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", F.col("text").cast("string"))
    )
    rows = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The labels are written and counted, and meet the texts once: few enough
    # of them go to the texts, more of them are joined by shuffling both.
    stage = stage_in(shared_dir(docs.sparkSession, "toxicity"))
    rows = stage("rows", rows)
    labelled = stage("labelled", texts.join(F.broadcast(rows) if rows.count() <= SENT_LABELS else rows, "doc_id"))
    lexicon = telling(labelled.select("text", "toxic"))
    texts = labelled.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    # The labelled ids are thinned out before they meet a text.
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    most = {1: sample, 0: 2 * sample}
    chance = {k: min(1_000_000, 1_200_000 * most[k] // max(n, 1) + 1) for k, n in sizes.items()}
    thin = rows.filter(F.when(F.col("toxic") == 1, lot < chance.get(1, 0)).otherwise(lot < chance.get(0, 0)))
    # So few ids go to every task, and no text is shuffled for its label.
    thin = thin.orderBy(lot, "doc_id").limit(6 * sample)
    met = texts.join(F.broadcast(thin), "doc_id").select("text", "toxic", F.xxhash64("text").alias("lot"))
    toxic, clean = (
        met.filter(F.col("toxic") == kind).orderBy("lot", "text").limit(most[kind]) for kind in (1, 0)
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [row for batch in batches for row in batch.to_pylist()]
        taken.sort(key=lambda row: (row["lot"], row["text"]), reverse=True)
        taken.sort(key=lambda row: row["toxic"])
        by_text = {row["text"]: bool(row["toxic"]) for row in taken}  # toxic if either copy is
        field = fit(list(by_text), list(by_text.values()), lexicon)
        yield pa.record_batch(
            [pa.array([x.tobytes()], pa.binary()) for x in (field.weights, field.pairs)], names=["weights", "pairs"]
        )

    # The sample goes to one task; the driver only sees the weights.
    learnt = toxic.union(clean).coalesce(1).mapInArrow(train, "weights binary, pairs binary").collect()
    if not learnt:
        return blank()
    return Field(np.frombuffer(learnt[0]["weights"]), np.frombuffer(learnt[0]["pairs"]).reshape(2, 2))


def score(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row.

    ``spans`` are the toxic stretches with code point offsets. Texts are read
    whole; one of more than 1 MB in pieces of half of that, cut between words. Null and
    empty texts, and texts without a letter, score 0. A null id is not held
    out; repeated rows are scored each; an empty table gives no rows. Only id
    and text are read, and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = tag(field, batch["text"])
            yield pa.record_batch(
                [
                    batch["doc_id"],
                    batch["held_out"],
                    pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                    pa.array(
                        spans,
                        pa.list_(
                            pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])
                        ),
                    ),
                ],
                names=["doc_id", "held_out", "score", "predicted", "spans"],
            )

    narrow = pick(docs, "doc_id", "text")
    rows = narrow.select(
        narrow.doc_id.cast("long"), held_out(narrow.doc_id).alias("held_out"), narrow.text.cast("string")
    )
    return rows.mapInArrow(run, SCORED)


def without_toxic(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(tag(field, texts, with_spans=False)[0] < threshold)

    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.filter(clean(F.coalesce(F.col(f"c{at}"), F.lit("")))).toDF(*docs.columns)
