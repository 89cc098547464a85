"""Rules on texts, and the log-likelihood ratio of their hashed n-grams between trusted and all documents. Spark SQL only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
CAPITAL = r"[A-Z]"
WINDOW = 5
#: Buckets of words, and as many again of pairs of words.
BUCKETS = 1 << 13
#: Mean log-ratio per n-gram, in millionths, from which a document is kept.
THRESHOLD = -90_000
SCALE = 1_000_000
SMOOTHING = 0.5


def words(text: Column) -> Column:
    """The words of a text: what stands between spaces, tabs and line breaks."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, text (null as empty), its words, and their hashes h: each word is hashed once, and all else is made of those."""
    worded = docs.select(F.col("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("w", words(F.col("text")))
    return worded.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _repeat_words(h: Column) -> Column:
    """Words inside windows that occur twice or more, given the hash of the window that starts at each place.

    The places of repeated windows come from sorting (hash, place): equal hashes stand side by side. In order of place,
    each window adds the words up to the next such window's start, WINDOW at most.
    """
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def places(p):
        twice = F.filter(p, lambda y, i: (F.get(p, i - 1)["x"] == y["x"]) | (F.get(p, i + 1)["x"] == y["x"]))
        return F.array_sort(F.transform(twice, lambda y: y["i"]))

    def covered(at):
        return F.aggregate(F.transform(at, lambda y, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - y, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, y: a + y)

    # let-bindings: a one-element array is transformed, so that what it holds is worked out once
    found = F.transform(F.array(pairs), lambda p: F.transform(F.array(places(p)), covered)[0])[0]
    return F.when(F.size(F.array_distinct(h)) < F.size(h), found).otherwise(F.lit(0).cast("long"))


def _lines(text: Column) -> Column:
    """The lines that aren't blank."""
    return F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))


def base_rules(worded: DataFrame) -> DataFrame:
    """The base columns next to doc_id and h."""
    text, n = F.col("text"), F.size("w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    out = worded.select(
        "doc_id",
        "h",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(text, SYMBOL).cast("long").alias("n_symbols"),
        _lines(text).alias("lines"),
        windows.alias("windows"),
    )
    out = out.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeat_words(F.col("windows")).cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)).drop("lines", "windows")


def trusted(worded: DataFrame) -> Column:
    """Documents whose n-grams make up the trusted target: long enough, varied, no symbols, few capitals, no line twice."""
    text, h = F.col("text"), F.col("h")
    n = F.length(text)
    plain = (F.size(h) >= 30) & (F.size(F.array_distinct(h)) * 10 >= F.size(h) * 4) & ~F.regexp_like(text, F.lit(SYMBOL)) & (_count(text, CAPITAL) * 10 <= n * 2)
    once = F.transform(F.array(_lines(text)), lambda x: F.size(F.array_distinct(x)) == F.size(x))[0]
    return plain & once


def buckets(h: Column) -> Column:
    """The bucket of every word, then that of every pair of neighbouring words, of word hashes h."""
    rest = F.greatest(F.size(h) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(h, F.lit(1), rest), F.slice(h, F.lit(2), rest), lambda x, y: (F.pmod(F.xxhash64(x, y), F.lit(BUCKETS)) + BUCKETS).cast("int"))
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")), pairs)


def weights(worded: DataFrame, target: Column) -> list[int]:
    """The log-ratio, in millionths, of each bucket's share in the target rows to that in all rows.

    Words and pairs of words are two multinomials over BUCKETS hashed n-grams each, counted over every row. Counts are
    summed map-side, so that a task sends one row a bucket at most; what the driver gets has 2 * BUCKETS rows at any
    size. Without target rows every weight is 0.
    """
    held = worded.select(target.alias("t"), "h")  # worked out before the words are spread, once a document
    grams = held.select("t", F.explode(buckets(F.col("h"))).alias("b"))
    counts = {r[0]: (r[1], r[2]) for r in grams.groupBy("b").agg(F.count(F.lit(1)), F.sum(F.col("t").cast("long"))).collect()}
    out = []
    for start in (0, BUCKETS):
        n = [counts.get(b, (0, 0)) for b in range(start, start + BUCKETS)]
        all_n, target_n = sum(x[0] for x in n), sum(x[1] for x in n)
        if not target_n:
            out += [0] * BUCKETS
            continue
        extra = SMOOTHING * BUCKETS
        out += [round(SCALE * (math.log((m + SMOOTHING) / (target_n + extra)) - math.log((k + SMOOTHING) / (all_n + extra)))) for k, m in n]
    return out


def log_ratio(h: Column, held: Column) -> Column:
    """Sum of the weights of a text's words and pairs of words."""
    return F.aggregate(buckets(h), F.lit(0).cast("long"), lambda a, b: a + F.get(held, b))


def score(docs: DataFrame, target: Column | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, the base columns, base_failed, the log-ratio, n_grams, and kept.

    kept: base_failed is false and the log-ratio is at least threshold millionths an n-gram. The ratios are whole
    numbers, so sums and verdicts don't depend on the order of rows. target says which rows are trusted, by default
    trusted(). Nothing but the bucket counts is shuffled.

    A null or empty text has no words, all counts 0, base_failed and not kept. Repeated rows each get their row; an
    empty table gives none; other columns are ignored.
    """
    worded = with_words(docs)
    table = weights(worded, trusted(worded) if target is None else target)
    held = F.lit(np.array(table, np.int64))  # a literal of fixed length in the plan
    out = base_rules(worded).withColumn("log_ratio", log_ratio(F.col("h"), held))
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    out = out.withColumn("n_grams", n_grams).withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= F.col("n_grams") * threshold))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio", "n_grams")


def base_query(docs: DataFrame) -> DataFrame:
    """The columns of the operator that need no statistics of the corpus, which SQL can express too."""
    return base_rules(with_words(docs)).drop("h")


#: DuckDB SQL for base_query over documents.
BASE_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT k, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5), h AS (SELECT k, i, w[i:i+4] AS v FROM g),
r AS (SELECT k, i FROM h QUALIFY count(*) OVER (PARTITION BY k, v) > 1),
n AS (SELECT k, sum(least(5, coalesce(after - i, 5))) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS after FROM r) GROUP BY k),
b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN n USING (k))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
"""
