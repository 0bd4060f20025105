import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loomwork.llm.quality import BUCKETS, THRESHOLD, quality_rules
from tests.llm.helpers import SF, documents, empty, frame, labels, odd, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


def facts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def word_hash(w):
    return signed(xxhash.xxh64_intdigest(w.encode(), 42))


def test_base_rules_against_brute_force(spark):
    extra = ["a b c d e a b c d e f", "x " * 40, "a b c d e\na b c d e\n\n \n", "a\x0bb\x0cc\rd e", "p q r s t p q r s t p q r s t u", "1 2 3 4 5 6 3 4 5 6 7 3 4 5 6 7 8 9"]
    rows = dict(enumerate(extra, 100_000)) | texts(spark)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for r in quality_rules(df, labels(spark)).collect():
        assert facts(r) == base(rows[r.doc_id]), rows[r.doc_id][:80]


def test_scores_against_brute_force(spark):
    docs = texts(spark)
    lab = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    raw, good, grams = np.zeros(BUCKETS), np.zeros(BUCKETS), {}
    for i, t in docs.items():
        h = [word_hash(w) for w in WORD.findall(t)]
        pair = [spark_pair(a, b) for a, b in zip(h, [*h[1:], None], strict=True)]
        g = [x % BUCKETS for x in h + pair]
        grams[i] = g
        np.add.at(raw, g, 1)
        if i in lab and lab[i].quality == 1 and lab[i].toxic != 1:
            np.add.at(good, g, 1)
    w = np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    out = quality_rules(documents(spark), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert len(out) == len(docs)
    for r in out:
        want = w[grams[r.doc_id]].mean() if grams[r.doc_id] else 0.0
        assert abs(r.score - want) < 1e-9
        assert r.kept == (not r.base_failed and r.score >= THRESHOLD)


def spark_pair(a, b):
    """xxhash64 of two longs: the first one's hash seeds the second; a null leaves it."""
    one = xxhash.xxh64_intdigest((a & (1 << 64) - 1).to_bytes(8, "little"), 42)
    return signed(one if b is None else xxhash.xxh64_intdigest((b & (1 << 64) - 1).to_bytes(8, "little"), one))


def test_odd_and_empty_tables(spark):
    out = quality_rules(odd(spark), labels(spark, [(1, 1, 0, 0.1), (1, 1, None, 0.1), (None, 1, 0, None), (7, None, None, None)])).collect()
    assert len(out) == 13
    nulls = [r for r in out if r.n_words == 0]
    assert len(nulls) == 5 and all(r.score == 0 and r.base_failed and not r.kept for r in nulls)
    assert quality_rules(empty(spark), labels(spark)).count() == 0


def test_scores_are_zero_without_labels(spark):
    out = quality_rules(frame(spark, [(1, "one two three four five six seven eight nine ten")]), labels(spark)).first()
    assert out.score == 0 and out.kept


def test_joined_labels_give_the_same_scores(spark, monkeypatch):
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    first = {(r.doc_id, r.score) for r in quality_rules(documents(spark), lab).collect()}
    monkeypatch.setattr("loomwork.llm.quality.BROADCAST_IDS", 0)
    assert {(r.doc_id, r.score) for r in quality_rules(documents(spark), lab).select("doc_id", F.col("score")).collect()} == first
