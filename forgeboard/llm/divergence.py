"""Quality rules from how a text's histograms diverge from its language's, in DataFrame operations.

A language's reference is the histogram of all its documents: shares of
classes of characters, and shares of its commonest words. A document whose
Jensen-Shannon distance to its reference is too large is not kept; one too
short to judge is. Every language has a reference of its own; the whole takes
part in it with the weight of one short document, so it counts where a language is thin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeboard.llm.frames import pick
from forgeboard.session import shared_dir, stage_in

#: What parts words, as a class of a pattern and as the characters. Fixed values.
BREAKS = "[\\x20\\x09-\\x0D]+"
BREAK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Common words of a language that are counted one by one.
COMMON = 24
#: Distances up to which a document is kept, and sizes from which it is judged.
MOST_CLASS_DISTANCE = 0.25
MOST_WORD_DISTANCE = 0.32
LEAST_CHARS = 400
LEAST_WORDS = 80
#: What the whole weighs in a language's reference: as much as the shortest judged document.
PRIOR_CHARS, PRIOR_WORDS = LEAST_CHARS, LEAST_WORDS

CLASSES = ("n_symbols", "n_breaks", "n_capitals", "n_digits", "n_marks", "n_rest")


def _count(pattern: str) -> Column:
    """Characters of ``few`` that match; the pattern takes runs of them."""
    return (F.length("few") - F.length(F.regexp_replace("few", pattern, ""))).cast("long")


def _rows(docs: DataFrame) -> DataFrame:
    """Id, language, text and words of every row."""
    rows = pick(docs, "doc_id", "text", "lang").select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    trimmed = F.btrim("text", F.lit(BREAK_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAKS))
    return rows.withColumn("words", words)


def _measured(rows: DataFrame) -> DataFrame:
    """The base counts that need no other document, but for the repeated words."""
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BREAK_CHARS)) != "")
    rows = rows.select("*", lines.alias("lines"), F.length("text").cast("long").alias("n_chars"))
    # No counted class has a-z, most of a text; without them five patterns have little left to look at.
    rows = rows.withColumn("few", F.regexp_replace("text", "[a-z]+", ""))
    rows = rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_symbols": _count(f"[{SYMBOLS}]+"),
            "n_breaks": _count(BREAKS),
            "n_capitals": _count("\\p{Lu}+"),
            "n_digits": _count("[0-9]+"),
            "n_marks": _count("[.,;:!?'\"()\\[\\]{}\\-_/\\\\]+"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    )
    counted = [F.col(c) for c in CLASSES[:-1]]
    rest = F.col("n_chars") - sum(counted[1:], counted[0])
    return rows.withColumns({"word_chars": F.col("n_chars") - F.col("n_breaks"), "n_rest": rest}).drop("lines", "few")


def with_repeats(rows: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words that lie in a 3-word window found twice or more.

    Windows are compared by 64-bit hashes. Only texts in which some window
    repeats are sorted: equal windows then stand side by side, and the words
    they cover follow from the places of those that have an equal neighbour.
    """
    words = F.col("words")
    window = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    rows = rows.withColumn("windows", F.slice(window, F.lit(1), F.greatest(F.lit(0), F.size("words") - 2)))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    numbered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(repeats, numbered))
    side = F.col("sorted")
    same = lambda x, at: F.coalesce(F.get(side, at)["h"] == x["h"], F.lit(False))
    # The windows found again, in the order of the text.
    again = F.filter(side, lambda x, at: same(x, at - 1) | same(x, at + 1))
    rows = rows.withColumn("again", F.sort_array(F.transform(again, lambda x: x["i"])))
    places = F.col("again")
    covered = F.transform(places, lambda x, at: F.least(F.lit(3), F.coalesce(F.get(places, at + 1) - x, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("windows", "sorted", "again")


def _common_words(rows: DataFrame) -> DataFrame:
    """``lang, common``: each language's commonest words, with their counts in it and in all languages.

    Every word of every document counts. Counts add up before they are shuffled.
    """
    plain = rows.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    merged = (
        plain.filter(F.col("word").rlike("^\\p{L}+$"))
        .groupBy("lang", F.lower("word").alias("word"))
        .agg(F.sum("n").alias("n"))
        .withColumn("n_all", F.sum("n").over(Window.partitionBy("word")))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    ranked = merged.withColumn("rank", rank).filter(F.col("rank") <= COMMON)
    return ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n", "n_all"))).alias("common"))


def _references(counts: DataFrame, common: DataFrame) -> DataFrame:
    """``lang, class_shares, word_shares`` for every language, shrunk toward the whole.

    The driver sees the sums over all rows only.
    """
    sums = [F.sum(c).alias(c) for c in (*CLASSES, "n_chars", "n_words")]
    whole = counts.agg(*sums).first()
    chars, words = (max(1, whole[c] or 0) for c in ("n_chars", "n_words"))

    def shrunk(n: Column, n_all: Column, of: Column, of_all: int, weight: int) -> Column:
        return (F.coalesce(n, F.lit(0)) + F.lit(float(weight)) * F.coalesce(n_all, F.lit(0)) / of_all) / (of + weight)

    by_class = [shrunk(F.col(c), F.lit(whole[c] or 0), F.col("n_chars"), chars, PRIOR_CHARS) for c in CLASSES]
    known = [F.get("common", F.lit(i)) for i in range(COMMON)]
    by_word = F.array(*[shrunk(w["n"], w["n_all"], F.col("n_words"), words, PRIOR_WORDS) for w in known])
    rest = F.greatest(F.lit(0.0), 1 - F.aggregate("by_word", F.lit(0.0), lambda a, x: a + x))
    return (
        counts.groupBy("lang").agg(*sums).join(common, "lang", "left")
        .select("lang", F.array(*by_class).alias("class_shares"), by_word.alias("by_word"))
        .select("lang", "class_shares", F.concat("by_word", F.array(rest)).alias("word_shares"))
    )


def _distance(counts: str, shares: str, total: str) -> Column:
    """Jensen-Shannon distance (base 2) of an array of counts from one of shares."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    def both(n: Column, q: Column) -> Column:
        p = n / F.col(total)
        return (part(p, q) + part(q, p)) / 2

    divergence = F.aggregate(F.zip_with(counts, shares, both), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.col(total) > 0, F.sqrt(F.greatest(F.lit(0.0), divergence))).otherwise(F.lit(0.0))


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict for every row.

    Gives ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, class_distance, word_distance``.
    ``base_failed`` holds under 50 words or with more than half of the words
    in repeated windows. Kept is a row that passes these and lies within both
    distances of its language's reference, or is too short to be judged.

    Null and empty texts have no words and are not kept. A null language is a
    language without a name. Repeated rows are judged each; an empty table
    gives no rows. Texts are read twice, and move only where the table of common
    words (24 a language) is too large to go to every task; the counts are written once.
    """
    stage = stage_in(shared_dir(docs.sparkSession, "divergence"))
    rows = _rows(docs)
    common = stage("common", _common_words(rows))
    rows = rows.join(common.select("lang", F.col("common.word").alias("common")), "lang", "left")

    # Each word's place among its language's common ones, those without one left out.
    place = F.transform("words", lambda word: F.array_position(F.col("common"), F.lower(word)))
    rows = with_repeats(_measured(rows)).withColumn("places", F.array_remove(place, F.lit(0).cast("long")))

    def occurrences(i: int) -> Column:
        others = F.array_remove("places", F.lit(i + 1).cast("long"))
        return (F.size("places") - F.size(others)).cast("long")

    kept_counts = ["doc_id", "lang", "n_chars", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", *CLASSES]
    rows = stage(
        "counts",
        rows.select(*[c for c in dict.fromkeys(kept_counts)], F.array(*map(occurrences, range(COMMON))).alias("hits")),
    )
    references = stage("references", _references(rows, common))
    in_hits = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.join(references, "lang").withColumns(
        {
            "class_counts": F.array(*CLASSES),
            "word_counts": F.concat("hits", F.array(F.col("n_words") - in_hits)),
        }
    )
    class_distance = _distance("class_counts", "class_shares", "n_chars")
    word_distance = _distance("word_counts", "word_shares", "n_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    short = (F.col("n_chars") < LEAST_CHARS) | (F.col("n_words") < LEAST_WORDS)
    close = (F.col("class_distance") <= MOST_CLASS_DISTANCE) & (F.col("word_distance") <= MOST_WORD_DISTANCE)
    return (
        rows.withColumns({"class_distance": class_distance, "word_distance": word_distance, "base_failed": failed})
        .withColumn("kept", ~F.col("base_failed") & (short | close))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "class_distance", "word_distance",
        )
    )
