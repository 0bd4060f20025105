"""Operator 1, quality rules: hashed n-gram log-likelihood ratio, with DataFrame operations only.

Words and word pairs are hashed to a fixed number of buckets. Two multinomials are counted over them:
the raw corpus (every document) and the trusted target (documents labelled good and not toxic). A
document's score is the mean, over its n-grams, of the log ratio of the two; it is kept if the score
reaches the threshold and no base rule fails. Counting is a map-side sum to one row a bucket and task,
scoring a second pass over the texts; no text is shuffled as long as the trusted ids may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import BLANK

BUCKETS = 1 << 14
#: Lowest score that is kept. In nats an n-gram; documents like the corpus as a whole have about 0,
#: and at sf0.1 none that is labelled good, and fails no base rule, has less than -0.08.
THRESHOLD = -0.1
#: Trusted ids are broadcast up to this number (16 MB); beyond it texts are joined by a shuffle.
BROADCAST_IDS = 2_000_000
SMOOTHING = 1.0
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    """The words between blanks; none for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{BLANK}+"))


def hashed_words(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def ngrams(hashes: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbours; the last word pairs with the end."""
    pairs = F.zip_with(
        hashes, F.slice(hashes, F.lit(2), F.size(hashes)), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")
    )
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")), pairs)


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window of five words which occurs twice or more in the text."""
    n = F.size(hashes) - (WINDOW - 1)
    windows = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW)))))

    def covered(at: Column) -> Column:
        """Length of the union of windows that start at the sorted positions."""
        last = F.size(at) - 1
        gap = lambda k: F.when(k == last, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(at, k + 1) - F.get(at, k)))
        return F.when(last < 0, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), F.lit(0), lambda acc, k: acc + gap(k)))

    def count(win: Column) -> Column:
        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

        return let(let(pairs, starts), covered)

    return let(windows, lambda w: F.when(w.isNull() | (F.size(F.array_distinct(w)) == F.size(w)), 0).otherwise(count(w)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic, each once."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)
    return labels.where(good & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, ``weights``: the log ratio of each bucket, smoothed. 0 everywhere without trusted documents."""
    few = trusted.count() <= BROADCAST_IDS
    mark = trusted.withColumn("trusted", F.lit(1))
    flagged = docs.select("doc_id", "text").join(F.broadcast(mark) if few else mark, "doc_id", "left")
    grams = flagged.select("trusted", F.explode(let(hashed_words(F.col("text")), lambda h: ngrams(h, buckets))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    rows = every.agg(
        F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("raw", F.lit(0)).alias("raw")))).alias("c"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("raw"), F.lit(0)).alias("r"),
    )
    extra = SMOOTHING * buckets
    ratio = lambda x: F.log((x["good"] + SMOOTHING) / (F.col("g") + extra)) - F.log((x["raw"] + SMOOTHING) / (F.col("r") + extra))
    return rows.select(F.transform("c", lambda x: F.when(F.col("g") > 0, ratio(x)).otherwise(0.0)).alias("weights"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every row, repeated ones too.

    A null text counts as empty; a text without words has score 0 and fails the base rule. A null doc_id
    is never trusted. An empty table gives no rows; without labels all scores are 0. Other columns of
    either table are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    weights = bucket_weights(docs, trusted_ids(labels.select("doc_id", "quality", "toxic")), buckets)
    docs = docs.withColumn("weights", weights.scalar())  # one row of fixed size, run once

    def facts(words: Column) -> Column:
        def scored(h: Column) -> Column:
            n = F.size(h)
            total = let(F.col("weights"), lambda w: F.aggregate(ngrams(h, buckets), F.lit(0.0), lambda acc, g: acc + F.get(w, g)))
            return F.struct(
                n.cast("long").alias("n_words"),
                F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                repeated_words(h).cast("long").alias("n_repeat_words"),
                F.when(n > 0, total / (2 * n)).otherwise(0.0).alias("score"),
            )

        return let(F.transform(words, lambda w: F.xxhash64(w)), scored)

    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        "doc_id",
        let(words_of(text), facts).alias("f"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "f.*", "n_symbols", "n_dup_lines")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score",
    )
