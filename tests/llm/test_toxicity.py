import math
import random
from zlib import crc32

import numpy as np
import pytest

from loomwork.llm import toxicity as T
from tests.llm.helpers import empty, frame, labels, odd

SYLLABLES = "an be co du er fi ga ho in ja ko lu".split()
BAD = ("grumblik", "snorvat", "plexodd")


def made(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(1, 3)))
    rows = []
    for i in range(n):
        text = [word() for _ in range(rng.randint(8, 300))]
        toxic = i % 3 == 0
        for _ in range(max(1, len(text) // 60) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(BAD)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def misspelt(word, rng):
    k = rng.randrange(1, len(word))
    return word[:k] + word[k - 1] + word[k:]


@pytest.fixture(scope="module")
def model():
    rows = made(600, 1)
    return T.fit([t for _, t, _ in rows], [y for *_, y in rows])


def accuracy(model, rows):
    return np.mean((model.scores([t for _, t, _ in rows]) >= T.THRESHOLD) == [y for *_, y in rows])


def test_held_out_accuracy(model):
    assert accuracy(model, made(400, 2)) > 0.97


def test_unseen_misspellings(model):
    rng = random.Random(3)
    rows = []
    for i, t, y in made(300, 4):
        rows.append((i, " ".join(misspelt(w, rng) if w in BAD else w for w in t.split()), y))
    assert accuracy(model, rows) > 0.88
    right, wrong, other = model.words(["grumblik gruumblik anbeco"])[0]
    assert right > wrong > 0.3 * right > 10 * abs(other)


def test_scores_do_not_depend_on_the_batch(model):
    some = [t for _, t, _ in made(50, 5)] + ["", " ", "é", "grumblik"]
    assert np.allclose(model.scores(some), [model.scores([t])[0] for t in some], atol=2e-6)
    assert model.scores([""])[0] == 0
    assert model.scores(["Grumblik, SNORVAT! plexodd."])[0] > 0.7


def test_buckets_of_training_and_scoring_agree():
    texts = ["a bb ccc dddd eeeee", "", "x"]
    rng = np.random.default_rng(0)
    model = T.Model(rng.normal(size=T.BUCKETS).astype(np.float32), 0.0, (0.0, 1.0, 0.0))
    b = T.bags(texts)
    each = np.add.reduceat(model.effect[b.feats].astype(float), b.ptr[:-1]) / np.diff(b.ptr)
    words, _, first = model.words(texts)
    assert np.allclose(each[b.words], words) and list(first) == list(b.first)


def test_scores_against_a_forward_pass_by_hand(model):
    texts = [t for _, t, _ in made(12, 8)] + ["one", "grumblik grumblik an be"]
    for text in texts:
        words = text.lower().split()
        b = T.bags(words)
        effect = lambda i: np.mean([model.effect[f] for f in b.feats[b.ptr[b.words[i]] : b.ptr[b.words[i] + 1]]])
        each = {w: float(effect(i)) for i, w in enumerate(words)}
        starts = list(range(0, len(words), T.WINDOW))
        starts[-1] = max(0, len(words) - T.WINDOW)
        logits = []
        for s in starts:
            window = set(words[s : s + T.WINDOW])
            logits.append(sum(each[w] for w in window) / max(len(window), T.WINDOW // 2) * T.SCALE + model.bias)
        z = model.fit[0] + model.fit[1] * max(logits) + model.fit[2] * math.log(len(logits))
        assert abs(model.scores([text])[0] - 1 / (1 + math.exp(-z))) < 1e-4


def test_a_training_step_against_differences():
    texts, y = ["grumblik an be", "co du er fi", "an snorvat co"], np.array([1.0, 0.0, 1.0])
    b = T.bags(texts)
    usable, weight = np.ones(T.BUCKETS, dtype=bool), np.array([0.25, 0.5, 0.25])
    runs = [np.unique(b.words[lo:hi]) for lo, hi in zip(b.first, b.first[1:], strict=False)]
    emb, soft, bias = T.start(9)

    def loss(emb, soft, bias):
        total = 0.0
        for run, label, w in zip(runs, y, weight, strict=True):
            words = [np.mean(emb[b.feats[b.ptr[i] : b.ptr[i + 1]]], axis=0) @ soft for i in run]
            z = sum(words) / max(len(run), T.WINDOW // 2) * T.SCALE + bias
            total += w * (math.log1p(math.exp(-z)) if label else math.log1p(math.exp(z)))
        return total

    def slope(x, at):
        old, out = x[at], []
        for d in (1e-5, -1e-5):
            x[at] = old + d
            out.append(loss(emb, soft, bias))
        x[at] = old
        return (out[0] - out[1]) / 2e-5

    used = np.unique(b.feats)
    g_emb = np.array([[slope(emb, (f, k)) for k in range(T.DIM)] for f in used])
    g_soft = np.array([slope(soft, k) for k in range(T.DIM)])
    g_bias = (loss(emb, soft, 1e-5) - loss(emb, soft, -1e-5)) / 2e-5
    part = 1 - T.MOMENTUM
    emb[used] -= T.RATE * part * g_emb / np.abs(g_emb).max()
    soft -= 0.2 * T.RATE * part * g_soft / np.abs(g_soft).max()
    bias -= 0.5 * T.RATE * part * np.sign(g_bias) * min(1.0, abs(g_bias) * 4)
    effect, offset = T._train(b, np.diff(b.ptr), usable, runs, y, weight, 9, steps=1)
    assert np.allclose(effect[used], (emb @ soft)[used], atol=1e-4) and abs(offset - bias) < 1e-6


def test_pruned_bags_keep_the_words():
    b = T.bags([t for _, t, _ in made(30, 7)])
    usable = T.common_buckets(b, 4)
    few = T.only_buckets(b, usable)
    rng = np.random.default_rng(1)
    effect = rng.normal(size=T.BUCKETS) * usable
    total = lambda x: np.add.reduceat(effect[x.feats], x.ptr[:-1])
    assert np.allclose(total(b), total(few)) and len(few.feats) < len(b.feats)


def test_the_sample_is_bounded(spark):
    rows = made(60, 9)
    df = frame(spark, [(i, t) for i, t, _ in rows] + [(i, t + " more") for i, t, _ in rows])  # ids repeat
    lab = labels(spark, [(i, 1, y, 0.0) for i, _, y in rows])
    seen = []
    fit, T.fit = T.fit, lambda texts, toxic, seed=5: seen.append((texts, toxic))
    try:
        T.fit_labelled(df, lab, per_class=10, max_bytes=8000)
        T.fit_labelled(df, lab, per_class=5)
    finally:
        T.fit = fit
    for c in (0, 1):
        assert 0 < sum(len(t.encode()) for t, y in zip(*seen[0], strict=True) if y == c) <= 4000
    assert sorted(seen[1][1]) == [0] * 5 + [1] * 5 and {t for t in seen[1][0]} <= {t for _, t, _ in rows}


def test_few_labelled_texts_still_train():
    model = T.fit(["grumblik an be", "co du er fi"], [1, 0])
    toxic, clean = model.scores(["grumblik an be", "co du er fi"])
    assert toxic > clean
    assert list(T.fit(["a", "b"], [0, 0]).scores(["a"])) == [0]


def test_query_rows(spark):
    rows = made(400, 6)
    df = frame(spark, [(i, t) for i, t, _ in rows])
    lab = labels(spark, [(i, 1, y, 0.0) for i, _, y in rows])
    out = {r.doc_id: r for r in T.toxicity(df, lab).collect()}
    right = [out[i].predicted == y for i, _, y in rows if crc32(str(i).encode()) % 3 == 1]
    assert np.mean(right) > 0.9
    assert all(r.held_out == (crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in out.items())
    flipped = labels(spark, [(i, 1, 1 - y if crc32(str(i).encode()) % 3 == 1 else y, 0.0) for i, _, y in rows])
    assert {r.doc_id: r.score for r in T.toxicity(df, flipped).collect()} == {i: r.score for i, r in out.items()}


def test_odd_and_empty_tables(spark):
    out = T.toxicity(odd(spark), labels(spark, [(1, 1, 1, 0.0), (1, 1, 0, 0.0), (None, 1, 1, 0.0), (2, None, None, None)])).collect()
    assert len(out) == 13 and all(r.score == 0 and r.predicted == 0 for r in out)
    assert T.toxicity(empty(spark), labels(spark)).count() == 0
