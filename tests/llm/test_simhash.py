import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm.simhash import BITS, PAIR_WEIGHT, _cuts, edited_fingerprints, fingerprint_texts, near_pairs
from loomwork.llm.vectors import span_hashes
from tests.llm.helpers import documents, empty, frame, odd, texts, thue_morse


def plain(rows):
    """(id, n_chars, digest of the edited text) in the order of ids, nulls last, then texts."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        n, after = len(t) // 3, rows[(k + 1) % len(rows)][1]
        out.append((i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows_per_range", [7, 50, 20_000])
def test_edited_texts(spark, rows_per_range):
    assert digests(edited_fingerprints(documents(spark), rows_per_range)) == plain(texts(spark).items())


def by_hand(text):
    """The fingerprint bit by bit, from the words' hashes."""
    mask = (1 << 64) - 1

    def spread(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    words = text.split()
    own = {w: int(span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) for w in set(words)}
    votes = [0.0] * BITS
    terms = [(own[w], 1 + math.log2(n)) for w, n in Counter(words).items()]
    terms += [(spread(own[a] * 3 + own[b] & mask), PAIR_WEIGHT * (1 + math.log2(n))) for (a, b), n in Counter(zip(words, words[1:], strict=False)).items()]
    for term, weight in terms:
        lanes = b"".join(spread(term ^ k * 0x8CB92BA72F3D8DD7 & mask).to_bytes(8, "little") for k in range(1, BITS // 64 + 1))
        for i in range(BITS):
            votes[i] += weight if lanes[i // 8] >> (7 - i % 8) & 1 else -weight
    return "".join("1" if v > 0 else "0" for v in votes)


def test_fingerprints_by_hand(spark):
    rng = random.Random(3)
    made = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 40) for _ in range(n)) for n in (1, 2, 3, 8, 30)] + ["", " \n", "é ß é ß", *thue_morse(1024)]
    out = {r.text: r.fingerprint for r in fingerprint_texts(frame(spark, list(enumerate(made)))).collect()}
    for text in made:
        assert f"{int(out[text], 16):0256b}" == (by_hand(text) if text.split() else "0" * 256)
    rows = list(enumerate(made))
    got = {r.doc_id: r for r in edited_fingerprints(frame(spark, rows), 3).collect()}
    for i, text in rows:
        after = made[i - 1]  # the last one follows the first
        n = len(text) // 3
        prints = [by_hand(t) if t.split() else "0" * 256 for t in (text, text[: len(text) - n] + after[:n], after)]
        same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 256
        assert (got[i].near_edited, got[i].near_next) == (same(prints[0], prints[1]), same(prints[0], prints[2]))
        assert f"{int(got[i].edited_fingerprint, 16):0256b}" == prints[1]


def test_hot_and_null_ids_are_split(spark):
    rows = [(None, f"{i:05d} text") for i in range(300)] + [(7, f"{i:05d} other") for i in range(300)] + [(i, "x") for i in range(50)]
    want = plain(rows)
    out = edited_fingerprints(frame(spark, rows), 20)
    assert digests(out) == want
    docs = frame(spark, rows).select("doc_id", F.substring("text", 1, 16).cast("binary").alias("prefix"))
    cuts = _cuts(docs, 30, len(rows))
    assert sum(c[0] for c in cuts) > 5 and sum(c[1] == ~7 and not c[0] for c in cuts) > 5


def test_likeness(spark):
    out = edited_fingerprints(documents(spark)).collect()
    real = texts(spark)
    usual = [r for r in out if len(real[r.doc_id].split()) >= 30]
    assert np.mean([r.near_edited > r.near_next for r in usual]) > 0.98
    assert np.mean([r.near_edited for r in usual]) > 0.68 > 0.6 > np.mean([r.near_next for r in usual])
    by_text = {}
    assert all(by_text.setdefault(real[r.doc_id], r.fingerprint) == r.fingerprint for r in out)


@pytest.mark.parametrize("radius", [3, 12, 40])
def test_near_pairs_against_all_pairs(spark, radius):
    prints = fingerprint_texts(documents(spark), "text").select("fingerprint")
    odd_ones = spark.createDataFrame([("0" * 64,), ("0" * 63 + "1",), ("f" * 64,), (None,), ("0" * 64,)], "fingerprint string")
    prints = prints.unionByName(odd_ones)
    known = sorted({r[0] for r in prints.collect() if r[0]})
    bits = np.array([list(bytes.fromhex(x)) for x in known], dtype=np.uint8)
    want = {}
    for i, a in enumerate(known):
        d = np.unpackbits(bits[i] ^ bits[i + 1 :], axis=1).sum(axis=1)
        want |= {(a, known[i + 1 + j]): int(d[j]) for j in np.flatnonzero(d <= radius)}
    rows = near_pairs(prints, radius).collect()
    assert len(rows) == len({(r.a, r.b) for r in rows})
    assert {(r.a, r.b): r.distance for r in rows} == want


@pytest.mark.parametrize("radius", [8, 40, 63, 255, 256])
def test_near_pairs_with_a_bit_flipped_in_every_block(spark, radius):
    # One bit in each of radius even blocks, the worst case for as many blocks, and one bit more.
    flips = [i * 256 // radius for i in range(radius)]
    planted = [0, sum(1 << (255 - i) for i in flips), sum(1 << (255 - i) for i in {*flips, 1, 3})]
    prints = spark.createDataFrame([(f"{x:064x}",) for x in planted], "fingerprint string")
    d = {(f"{x:064x}", f"{y:064x}"): (x ^ y).bit_count() for x in planted for y in planted if x < y}
    want = {k: n for k, n in d.items() if n <= radius}
    assert radius in want.values()
    assert {(r.a, r.b): r.distance for r in near_pairs(prints, radius).collect()} == want


def test_odd_and_empty_tables(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    for n in (1, 3, 1000):
        assert digests(edited_fingerprints(odd(spark), n)) == plain(rows)
    assert edited_fingerprints(empty(spark)).count() == 0
    one = edited_fingerprints(frame(spark, [(5, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1
    nulls = edited_fingerprints(frame(spark, [(None, "abc"), (None, "abd")])).count()
    assert nulls == 2
