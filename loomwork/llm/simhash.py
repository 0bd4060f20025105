"""Operator 4, document fingerprints: SimHash.

A text's terms are its words and its pairs of neighbouring words. Each distinct term votes with its
weight, 1 + log2 of its count, on the signs of 256 bits, and pairs weigh four times as much as words.
``near_pairs`` finds all fingerprints within a Hamming radius by permuted block tables.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.vectors import U, mix, words

BITS = 256
_LANES = BITS // 8
#: 1 and -1 for each bit, highest first, of every byte.
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
_SALT = np.arange(1, BITS // 64 + 1, dtype=U) * U(0x8CB92BA72F3D8DD7)
_LANE_AT = np.arange(_LANES, dtype=np.int64) * 256
PAIR_WEIGHT = 4.0
#: UTF-8 bytes that a range of documents should hold, ranges of a task, and ranges at most (their cuts are sent to all tasks).
RANGE_BYTES, RANGES_A_TASK, MOST_RANGES = 1 << 20, 8, 200_000
#: Code points of the text that, after the id, tell ranges apart.
PREFIX = 16


def _terms(w) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, distinct term hashes, weights) of every row with words."""
    for i in range(w.hi - w.lo):
        h = w.hashes[w.first[i] : w.first[i + 1]]
        if len(h):
            pairs = mix(h[:-1] * U(3) + h[1:])
            for_words, n = np.unique(h, return_counts=True)
            for_pairs, m = np.unique(pairs, return_counts=True)
            yield w.lo + i, np.concatenate((for_words, for_pairs)), np.concatenate((1 + np.log2(n), PAIR_WEIGHT * (1 + np.log2(np.maximum(m, 1)))))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A row of 32 bytes for each text; all zero for a text without words (and null)."""
    out = np.zeros((len(texts), _LANES), dtype=np.uint8)
    for w in words(texts):
        for row, terms, weights in _terms(w):
            votes = np.zeros(_LANES * 256)
            for at in range(0, len(terms), 20_000):
                part = terms[at : at + 20_000]
                lanes = np.concatenate([mix(part ^ s).view(np.uint8).reshape(-1, 8) for s in _SALT], axis=1)
                votes += np.bincount((lanes + _LANE_AT).ravel(), np.repeat(weights[at : at + 20_000], _LANES), len(votes))
            votes = votes.reshape(_LANES, 256) @ _SIGNS
            out[row] = np.packbits(votes > 0, axis=1)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, row by row."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def hexed(prints: np.ndarray) -> list[str]:
    return [p.tobytes().hex() for p in prints]


def fingerprint_texts(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text column as 64 hex digits; null counts as empty. One narrow stage."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(hexed(fingerprints(pa.array(texts, pa.string(), from_pandas=True))))

    return df.withColumn(out, of(F.col(text)))


def near_pairs(prints: DataFrame, radius: int = 3, fingerprint: str = "fingerprint") -> DataFrame:
    """(a, b, distance): all pairs of distinct fingerprints within the Hamming radius, a < b.

    A fingerprint is cut into radius + 1 blocks of bits, of nearly equal length (a radius of 256 or more keeps all
    pairs); two within the radius agree in at least one (pigeonhole).
    Each block has its table, keyed by the block's value; a pair is kept only by the first block that it
    agrees in, so none is found twice. Equal fingerprints are one; nulls are left out. Joins are on
    (block, value): a value that many distinct fingerprints share is split by the adaptive skew join.
    """
    n = radius + 1
    cuts = [i * BITS // n for i in range(n + 1)] if n <= BITS else [0, 0]  # an empty block is common to all
    one = prints.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias("a")).distinct()
    binary = F.concat(*(F.lpad(F.conv(F.substring("a", i, 8), 16, 2), 32, "0") for i in range(1, 64, 8)))
    one = one.withColumn("bits", binary)
    blocks = F.array(*(F.substring("bits", lo + 1, hi - lo) for lo, hi in pairwise(cuts)))
    left = one.select("a", blocks.alias("ab"), F.posexplode(blocks).alias("block", "key"))
    right = left.select(F.col("a").alias("b"), F.col("ab").alias("bb"), "block", "key")
    met = left.join(right, ["block", "key"]).where("a < b")
    earlier = F.exists(F.sequence(F.lit(0), F.col("block")), lambda i: (i < F.col("block")) & (F.get("ab", i) == F.get("bb", i)))

    bits = sum(
        (F.bit_count(F.conv(F.substring("a", i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("b", i, 8), 16, 10).cast("long"))) for i in range(1, 64, 8)),
        F.lit(0),
    )
    return met.where(~earlier).select("a", "b", bits.alias("distance")).where(F.col("distance") <= radius)


def _cuts(docs: DataFrame, n_ranges: int, n_rows: int) -> list[tuple[bool, int, bytes]]:
    """First keys of all ranges but the first: an even choice of a hashed part of the keys, about four a range."""
    every = max(1, n_rows // (4 * n_ranges))
    some = docs.select("doc_id", "prefix").where(F.pmod(F.xxhash64("doc_id", "prefix"), F.lit(every)) == 0).distinct().collect()
    keys = sorted((r["doc_id"] is None, ~(r["doc_id"] or 0), bytes(r["prefix"])) for r in some)
    return sorted({keys[i * len(keys) // n_ranges] for i in range(1, n_ranges)}) if keys else []


def edited_fingerprints(docs: DataFrame, rows_per_range: int | None = None) -> DataFrame:
    """Fingerprint every text and the same text with its last third replaced by the start of the next one's.

    The next document has the next lower doc_id; the first follows the last. Documents are dealt in ranges of ids and,
    where many share an id or have none, of the starts of their texts, of ``RANGE_BYTES`` each (or so many rows).
    Ranges begin at documents that occur, so the first one of a range is also sent to the range before, to close it.
    Of rows with one doc_id the lesser text comes first. Null ids come last of all, null texts count as empty,
    and a single row is its own next one. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("prefix", F.substring("text", 1, PREFIX).cast("binary"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("low"), "prefix")
    of = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("size"), F.min(order).alias("top")).first()
    wanted = of["n"] // rows_per_range if rows_per_range else of["size"] // RANGE_BYTES
    n_ranges = min(MOST_RANGES, max(1, wanted))
    cuts = _cuts(docs, n_ranges, of["n"]) if n_ranges > 1 else []
    top = (of["top"]["none"], of["top"]["low"], bytes(of["top"]["prefix"])) if of["n"] else None

    @F.pandas_udf("array<int>")
    def ranges(none: pd.Series, low: pd.Series, prefix: pd.Series) -> pd.Series:
        out = []
        for key in zip(none.tolist(), low.tolist(), map(bytes, prefix), strict=True):
            r = bisect_right(cuts, key)  # range r has the keys from cuts[r - 1] on
            own = [r]
            if r and key == cuts[r - 1]:
                own.append(-r)  # closes range r - 1
            if key == top:
                own.append(-len(cuts) - 1)  # closes the last one
            out.append(own)
        return pd.Series(out)

    keyed = docs.select("doc_id", "text", F.explode(ranges(F.col("doc_id").isNull(), F.bitwise_not(F.coalesce("doc_id", F.lit(0))), F.col("prefix"))).alias("to"))
    closing = F.col("to") < 0
    keyed = keyed.select(
        F.when(closing, -F.col("to") - 1).otherwise(F.col("to")).alias("range"), closing.cast("int").alias("closing"), "doc_id", "text"
    )
    order = ["range", "closing", F.desc_nulls_last("doc_id"), "text"]
    n_parts = max((len(cuts) + 1) // RANGES_A_TASK, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.repartition(n_parts, "range").sortWithinPartitions(*order)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, fingerprint) that still has no next row
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                prints = fingerprints(part.column(3))
                rows = []
                for r, c, i, t, p in zip(*(part.column(k).to_pylist() for k in range(4)), prints, strict=True):
                    if held is not None and held[0] == r:
                        rows.append((*held[1:], t, p))
                    held = None if c else (r, i, t, p)
                yield _edited(rows)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(follow, schema)


def _edited(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, text, fingerprint, next text, next fingerprint)."""
    edited = []
    for _, t, _, nxt, _ in rows:
        k = len(t) // 3
        edited.append(t[: len(t) - k] + nxt[:k])
    own, after = (np.array([r[k] for r in rows], dtype=np.uint8).reshape(-1, _LANES) for k in (2, 4))
    new = fingerprints(pa.array(edited, pa.large_string()))
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(hexed(own), pa.string()),
        pa.array(hexed(new), pa.string()), pa.array(likeness(own, new), pa.float64()), pa.array(likeness(own, after), pa.float64()),
    ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
