"""Operator 2, toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of its character 3- to 5-grams (with marks at its ends) and
of the word itself, hashed to buckets, so an unseen misspelling shares most of a known word's vectors. A
window's vector is the mean over its distinct words, and a softmax over two classes scores it. Embeddings and
softmax are trained together in numpy on a bounded sample of labelled documents, whole, once a fold. As few words of a
toxic document are toxic, its windows are trained in rounds: first all of them as toxic, then only
those that the model before finds. A document's score is calibrated on its highest window.

With two classes only the difference of the softmax rows matters, so a bucket acts by one number, its
embedding times that difference: training steps and scoring work on these numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.vectors import STEP, U, mix, release_memory, span_hashes

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
WINDOW = 32
#: Labelled documents of either class that the model is fitted on, at most, and UTF-8 bytes of all their texts: in
#: the order of the hashes of their ids, documents are taken whole until the next one would exceed a class's half.
SAMPLE_PER_CLASS, SAMPLE_BYTES = 2000, 32_000_000
#: Models that are trained, each without its part of either class, which it then calibrates on; they are averaged.
FOLDS = 3
#: Weight of the model that did not see a text in its calibration; one model alone is noisier than their mean (.632 rule).
UNSEEN = 0.632
#: A bucket takes part if so many training texts have it, at most half a class; rarer ones could only be learned by heart.
LEAST_TEXTS = 4
ROUNDS = 3
STEPS, RATE, MOMENTUM, SCALE = 80, 0.25, 0.9, 32.0
THRESHOLD = 0.7

_LETTER = np.array([chr(c).isalnum() for c in range(0x3000)])


@dataclass
class Bags:
    """Distinct word i has the buckets ``feats[ptr[i]:ptr[i + 1]]``; text j is ``words[first[j]:first[j + 1]]``."""

    feats: np.ndarray
    ptr: np.ndarray
    words: np.ndarray
    first: np.ndarray


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points with 1 for all but letters and digits; start and end of each word; bounds of each text's words."""
    low = [t.lower() for t in texts]
    joined = "\n" + "\n".join(low) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = np.where(raw < len(_LETTER), _LETTER[np.minimum(raw, len(_LETTER) - 1)], (raw >= 0x3040) & (raw < 0xFE00) | (raw >= 0x10000))
    code = np.where(letter, raw, 1).astype(U)
    change = np.diff(letter.astype(np.int8))
    starts, ends = np.flatnonzero(change == 1) + 1, np.flatnonzero(change == -1) + 1
    at = np.cumsum([1, *(len(t) + 1 for t in low)])
    return code, starts, ends, np.searchsorted(starts, at)


def _gram_buckets(code: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each place."""
    size = max(0, len(code) - n + 1)
    total = np.full(size, n, dtype=U)
    for j in range(n):
        total += code[j : j + size] * STEP[j]
    return _bucket(mix(total))


def _word_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(code.astype("<u4").view(np.uint8), starts * 4, ends * 4, lanes=8)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> U(40)) % U(BUCKETS)).astype(np.int32)


def _runs_of(texts: list[str], chars: int = 500_000) -> Iterator[list[str]]:
    """The texts in runs of about so many characters, so that code points of all never stand in memory at once."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def bags(texts: list[str]) -> Bags:
    """Distinct words with their buckets, and every text as a run of them, for training."""
    known, feats, sizes, hashes, first = np.zeros(0, dtype=U), [], [], [], [np.zeros(1, np.int64)]
    for run in _runs_of(texts):
        code, starts, ends, at = _codes(run)
        h = _word_hashes(code, starts, ends)
        hashes.append(h)
        first.append(first[-1][-1] + at[1:])
        found, one = np.unique(h, return_index=True)
        fresh = ~np.isin(found, known)
        known, one = np.concatenate((known, found[fresh])), one[fresh]
        starts, ends = starts[one], ends[one]
        length = ends - starts
        parts, owners = [_bucket(h[one])], [np.arange(len(starts))]
        for n in GRAMS:
            count = np.maximum(length + 3 - n, 0)
            word = np.repeat(np.arange(len(starts)), count)
            inside = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
            parts.append(_gram_buckets(code, n)[starts[word] - 1 + inside])
            owners.append(word)
        owner = np.concatenate(owners)
        feats.append(np.concatenate(parts)[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner, minlength=len(starts)))
    order = np.argsort(known)
    number = order[np.searchsorted(known[order], np.concatenate(hashes))]
    ptr = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    return Bags(np.concatenate(feats), ptr, number, np.concatenate(first))


def common_buckets(b: Bags, least: int) -> np.ndarray:
    """Which buckets at least ``least`` of the texts have."""
    text = np.repeat(np.arange(len(b.first) - 1), np.diff(b.first))
    pairs = np.unique(text.astype(np.int64) * len(b.ptr) + b.words)
    text, word = pairs // len(b.ptr), pairs % len(b.ptr)
    seen = np.zeros(BUCKETS, np.int64)
    for ws in _grouped(text, word)[1]:
        f = np.unique(np.concatenate([b.feats[b.ptr[w] : b.ptr[w + 1]] for w in ws]))
        seen[f] += 1
    return seen >= least


def only_buckets(b: Bags, usable: np.ndarray) -> Bags:
    """The bags without the buckets that take no part; a word's own bucket, its first, always stays."""
    keep = usable[b.feats]
    keep[b.ptr[:-1]] = True
    sizes = np.add.reduceat(keep.astype(np.int64), b.ptr[:-1]) if len(b.ptr) > 1 else np.zeros(0, np.int64)
    return Bags(b.feats[keep], np.concatenate(([0], np.cumsum(sizes))), b.words, b.first)


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Values of each of the sorted keys."""
    some, at = np.unique(keys, return_index=True)
    return some, np.split(values, at[1:])


@dataclass
class Model:
    """What a bucket adds to the logit, the softmax's offset, and the calibration (offset, highest window, log windows)."""

    effect: np.ndarray
    bias: float
    fit: tuple[float, float, float]

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logit part and the hash of every word, and the bounds of each text's words."""
        code, starts, ends, first = _codes(texts)
        length = ends - starts
        ids = _word_hashes(code, starts, ends)
        total, n = self.effect[_bucket(ids)].astype(np.float64), np.ones(len(starts))
        for k in GRAMS:
            if len(code) < k:
                continue
            run = np.concatenate(([0.0], np.cumsum(self.effect[_gram_buckets(code, k)], dtype=np.float64)))
            count, last = np.maximum(length + 3 - k, 0), len(run) - 1
            total += np.where(count > 0, run[np.minimum(starts - 1 + count, last)] - run[np.minimum(starts - 1, last)], 0)
            n += count
        return total / n, ids, first

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 1 for each text; 0 for one without words."""
        words, ids, first = self.words(texts)
        out = np.zeros(len(texts))
        for i in range(len(texts)):
            w = words[first[i] : first[i + 1]]
            if len(w):
                z = _windows(w, ids[first[i] : first[i + 1]]) + self.bias
                out[i] = 1 / (1 + np.exp(-np.clip(self.fit @ np.array([1.0, z.max(), np.log(len(z))]), -30, 30)))
        return np.round(out, 6)


def _spans(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of windows over n words; the last one reaches back to full length."""
    starts = np.arange(0, n, WINDOW)
    ends = np.minimum(starts + WINDOW, n)
    starts[-1] = max(0, n - WINDOW)
    return starts, ends


def _windows(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Mean of each window over its distinct words, scaled; short windows count as half full at least."""
    starts, ends = _spans(len(words))
    at = starts[:, None] + np.arange(min(WINDOW, len(words)))
    order = np.argsort(ids[at], axis=1)
    ids, words = np.take_along_axis(ids[at], order, 1), np.take_along_axis(words[at], order, 1)
    new = np.ones(ids.shape, dtype=bool)
    new[:, 1:] = ids[:, 1:] != ids[:, :-1]
    return (words * new).sum(axis=1) / np.maximum(new.sum(axis=1), WINDOW // 2) * SCALE


def start(seed: int, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, float]:
    """Embeddings, softmax difference and offset before training."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, 0.1, (buckets, DIM)), rng.normal(0, 0.5, DIM), 0.0


def _train(
    b: Bags, n_feats: np.ndarray, usable: np.ndarray, windows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int, steps: int = STEPS
) -> tuple[np.ndarray, float]:
    """Gradient descent on embeddings, softmax difference and offset together; returns (bucket effects, offset).

    ``n_feats`` is how many buckets each word has, those included that ``usable`` leaves out.
    """
    emb, soft, bias = start(seed, len(usable))
    words = np.concatenate(windows)
    size = np.array([len(w) for w in windows])
    at = np.cumsum(size) - size
    share = np.maximum(size, WINDOW // 2)
    held = np.diff(b.ptr)
    m_emb, m_soft, m_bias = np.zeros_like(emb), np.zeros_like(soft), 0.0
    for step in range(steps):
        effect = emb @ soft * usable
        each = np.add.reduceat(effect[b.feats], b.ptr[:-1]) / n_feats
        z = np.add.reduceat(each[words], at) / share * SCALE + bias
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        by_word = np.bincount(words, np.repeat(g / share * SCALE, size), len(n_feats)) / n_feats
        by_feat = np.bincount(b.feats, np.repeat(by_word, held), len(usable)) * usable
        g_emb, g_soft = np.outer(by_feat, soft), emb.T @ by_feat
        rate = RATE * (1 - step / STEPS)
        m_emb = MOMENTUM * m_emb + (1 - MOMENTUM) * g_emb / (np.abs(g_emb).max() + 1e-12)
        m_soft = MOMENTUM * m_soft + (1 - MOMENTUM) * g_soft / (np.abs(g_soft).max() + 1e-12)
        m_bias = MOMENTUM * m_bias + (1 - MOMENTUM) * np.sign(g.sum()) * min(1.0, abs(g.sum()) * 4)
        emb -= rate * m_emb
        soft -= 0.2 * rate * m_soft
        bias -= 0.5 * rate * m_bias
    return (emb @ soft * usable).astype(np.float32), float(bias)


def fit(texts: list[str], toxic: list[int], seed: int = 5) -> Model:
    """Train on labelled texts. Without both classes nothing tells them apart, and the model scores 0 for every text.

    ``FOLDS`` models are trained, each on the other folds' texts, and averaged; the calibration weighs each text's
    windows under the model that did not see it and under the others. Fewer texts of a class than folds are in
    every model.
    """
    y = np.array(toxic, dtype=np.int64)
    keep = np.array([i for i, t in enumerate(texts) if (_codes([t])[1]).size], dtype=np.int64)
    texts, y = [texts[i] for i in keep], y[keep]
    if len(set(y)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, (-30.0, 0.0, 0.0))
    fold = np.zeros(len(y), dtype=np.int64)
    for c in (0, 1):
        n = int((y == c).sum())
        fold[y == c] = np.arange(n) % FOLDS if n >= FOLDS else -1
    b = bags(texts)
    least = max(1, min(LEAST_TEXTS, np.bincount(y).min() // 2))  # a class of a few texts has few in common
    usable, n_feats = common_buckets(b, least), np.diff(b.ptr)
    b = only_buckets(b, usable)
    some, feats = np.unique(b.feats, return_inverse=True)  # only these are trained
    b, usable = Bags(feats, b.ptr, b.words, b.first), usable[some]
    runs, owner = [], []
    for k in range(len(texts)):
        for lo, hi in zip(*_spans(b.first[k + 1] - b.first[k]), strict=True):
            runs.append(np.unique(b.words[b.first[k] + lo : b.first[k] + hi]))
            owner.append(k)
    owner = np.array(owner)
    effects, bias, unseen, known = [], [], np.zeros(len(texts)), np.zeros(len(texts))
    for f in range(FOLDS):
        seen = fold[owner] != f
        use = seen.copy()
        for turn in range(ROUNDS):
            pick = np.flatnonzero(use)
            label = y[owner[pick]]
            weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
            effect, offset = _train(b, n_feats, usable, [runs[i] for i in pick], label.astype(float), weight, seed + ROUNDS * f + turn)
            each = np.add.reduceat(effect[b.feats].astype(np.float64), b.ptr[:-1]) / n_feats
            z = np.array([each[r].sum() / max(len(r), WINDOW // 2) for r in runs]) * SCALE + offset
            high = np.full(len(texts), -np.inf)
            np.maximum.at(high, owner, z)
            use = seen & ((y[owner] == 0) | (z >= np.minimum(0.6 * high[owner], high[owner])))
        effects.append(effect)
        bias.append(offset)
        mine = (fold == f) | (fold < 0)
        unseen[mine] = high[mine]
        known += np.where(mine, 0, high) / np.where(fold < 0, FOLDS, FOLDS - 1)
    effect = np.zeros(BUCKETS, np.float32)
    effect[some] = np.mean(effects, axis=0)
    n_windows = np.bincount(owner, minlength=len(texts))
    top = UNSEEN * unseen + (1 - UNSEEN) * np.where(fold < 0, unseen, known)
    return Model(effect, float(np.mean(bias)), _calibrate(top, n_windows, y))


def _calibrate(top: np.ndarray, n_windows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the highest window and the log number of windows, lightly penalised."""
    x, y = np.column_stack((np.ones(len(top)), top, np.log(n_windows))), y.astype(float)
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    spread = np.array([1.0, max(1e-6, x[:, 1].std()), 1.0])
    x, beta = x / spread, np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.array([1e-3, 5e-2, 5e-1])
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        beta = beta - np.linalg.solve(h, x.T @ (w * (p - y)) + ridge * beta)
    return beta / spread


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_labelled(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``per_class`` labelled documents of either class, those with the least hashes of their ids.

    Labels of held-out ids, null labels and null ids are left out; of several labels of an id the highest counts, of
    several texts the shortest, then the least. Their texts have ``max_bytes`` at most, half of it for either class: a
    document that doesn't fit ends its class. The driver first gets ids and sizes, then the texts that were chosen.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    ids = some(0).unionByName(some(1))  # 2 * per_class rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = texts.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("th")).join(F.broadcast(ids), "doc_id")
    one = own.groupBy("doc_id", "toxic").agg(F.min(F.struct("size", "th")).alias("k"))
    rows = one.select("doc_id", "toxic", "k.size", "k.th", F.xxhash64("doc_id").alias("at")).collect()
    chosen = []
    for c in (0, 1):
        room = max_bytes // 2
        for r in sorted((r for r in rows if r["toxic"] == c), key=lambda r: (r["at"], r["doc_id"])):
            room -= r["size"]
            if room < 0:
                break
            chosen.append((r["doc_id"], r["th"], c))
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(chosen, "doc_id long, th long, toxic int"))
    found = texts.withColumn("th", F.xxhash64("text")).join(wanted, ["doc_id", "th"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    sample = sorted(found.collect(), key=lambda r: (r["doc_id"] * 2654435761 % (1 << 32), r["doc_id"]))
    return fit([r["text"] for r in sample], [r["toxic"] for r in sample])


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column; one narrow stage."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [model.scores(run) for run in _runs_of(texts.fillna("").tolist(), 250_000)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))
        release_memory()

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, repeated ones too.

    A null text counts as empty, and a text without words scores 0, as every text does when the sample
    lacks a class. An empty table gives no rows. Other columns are ignored.
    """
    model = fit_labelled(docs, labels, per_class)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
