import random
from collections import Counter

import pytest

from loomwork.llm import lshforest as L
from loomwork.llm.common import Scratch
from loomwork.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import SF, documents, empty, frame, odd, texts, thue_morse
from tests.llm.test_quality import WORD
from tests.oracle import same


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    """(id, class, links) of all pairs, one by one; ids must be unique."""
    sets = {i: shingles(t) for i, t in rows}
    root, links = {i: i for i in sets}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            met = len(sets[a] & sets[b])
            if met and 5 * met >= 4 * (len(sets[a]) + len(sets[b]) - met):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in L.near_duplicates(df).collect()}


def family(rng, start, n, words=60, edits=2):
    """Near copies of one text, with a few words changed in each."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((start + i, " ".join(text)))
    return out


@pytest.mark.parametrize("block", [L.BLOCK, 2])
def test_documents_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    assert result(documents(spark)) == plain(texts(spark).items())


def test_families_copies_and_edges(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 8)
    rng = random.Random(4)
    rows = family(rng, 0, 60) + family(rng, 100, 25, words=200, edits=8) + family(rng, 200, 10, words=20, edits=1)
    rows += [(300 + i, rows[0][1]) for i in range(7)]  # copies
    edge = [f"e{i}" for i in range(13)]  # 9 shingles; 8 of 10 in common are exactly 0.8
    rows += [(400, " ".join(edge)), (401, " ".join([*edge[:12], "other"])), (402, "a b c"), (403, "a b c"), (404, ""), (405, ""), (406, "a  b\tc")]
    want = plain(rows)
    assert want[400] == (400, 1) and want[404] == (404, 0) and want[402] == (402, 2)
    assert result(frame(spark, rows)) == want


def test_repeated_passages_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 8)
    once = family(random.Random(6), 0, 40, edits=1)
    rows = [*once, *((100 + i, f"{t} {t}") for i, t in once[:20])]
    want = plain(rows)
    assert min(n for _, n in want.values()) > 0
    assert result(frame(spark, rows)) == want


def test_dense_families_are_sent_in_wide_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    rows = family(random.Random(8), 0, 300, edits=3)
    rows += [(1000 + i, t) for i, t in rows[:30]]  # copies
    want = plain(rows)
    assert max(n for _, n in want.values()) > 100
    assert result(frame(spark, rows)) == want
    scratch = Scratch(spark)
    signed = L.signatures(frame(spark, rows[:300])).selectExpr("text_md5 AS node", "n_shingles AS n", "keys", "1 AS copies", "xxhash64(text_md5) AS short")
    nodes = scratch.put(signed.dropDuplicates(["node"]))
    m = nodes.count()
    sent = L.dealt_tasks(nodes, scratch).groupBy("node").count().collect()
    times = m // (4 * L.FEW)
    assert times > 1 and max(r["count"] for r in sent) == -(-m // (4 * times))  # m / 4 before


def test_blocks_of_long_texts_stay_narrow(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    monkeypatch.setattr(L, "SPAN", 60)  # texts of 56 shingles
    rows = family(random.Random(9), 0, 200, edits=2)
    assert result(frame(spark, rows)) == plain(rows)
    signed = L.signatures(frame(spark, rows)).selectExpr("text_md5 AS node", "n_shingles AS n", "keys", "1 AS copies", "xxhash64(text_md5) AS short")
    scratch = Scratch(spark)
    nodes = scratch.put(signed.dropDuplicates(["node"]))
    assert min(r["count"] for r in L.dealt_tasks(nodes, scratch).groupBy("node").count().collect()) >= nodes.count() // 4 - 1


def chain(n, words=64):
    """Texts of a sliding window: each is like its neighbours, and far ones have nothing in common."""
    return [(i, " ".join(f"c{k}" for k in range(i, i + words))) for i in range(n)]


def test_chains_are_dealt_by_prefixes(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    rows = chain(700)
    want = plain(rows)
    assert want[350][0] == 0 and want[350][1] > 8
    assert result(frame(spark, rows)) == want
    scratch, mean = Scratch(spark), []
    for n in (700, 1400):
        signed = L.signatures(frame(spark, chain(n))).selectExpr("text_md5 AS node", "n_shingles AS n", "keys", "1 AS copies", "xxhash64(text_md5) AS short")
        tasks = L.dealt_tasks(scratch.put(signed), scratch).groupBy("node").count().collect()
        assert len(tasks) == n
        mean.append(sum(r["count"] for r in tasks) / n)
    assert mean[0] < 700 / L.BLOCK and mean[1] < 1.1 * mean[0]  # a text's copies don't grow with the chain


def test_levels_hold_the_recall_for_all_sizes():
    for n in range(1, 60):
        for m in range(1, 60):
            for met in range(1, min(n, m) + 1):
                j = met / (n + m - met)
                if 1000 * met >= 800 * (n + m - met):
                    both = set(L.levels_for(n)) & set(L.levels_for(m))
                    assert max(1 - (1 - j**d) ** L.TREES for d in both) >= L.RECALL, (n, m, met)
    assert L.levels_for(1) == (L.DEPTH,) and L.levels_for(5000) == (L.depth_for(),)
    for n in (401, 450, 1000):
        least = [-(-800 * (n + m) // 1800) for m in range(-(-n * 8 // 10), n * 10 // 8 + 1)]
        depths = {L.depth_for(i / (n + m - i)) for i, m in zip(least, range(-(-n * 8 // 10), n * 10 // 8 + 1), strict=True)}
        assert depths <= set(L.levels_for(n))


def test_words_of_equal_polynomials_are_unlike(spark):
    one, other = thue_morse(2048)
    assert result(frame(spark, [(1, one), (2, other), (3, f"a b c d {one}"), (4, f"a b c d {other}")])) == {i: (i, 0) for i in (1, 2, 3, 4)}


def test_depth_follows_the_recall():
    assert L.depth_for(recall=0.5) == L.DEPTH
    deep = [L.depth_for(recall=r) for r in (0.9, 0.99, 0.999, 0.99999, 1.0)]
    assert deep == sorted(deep, reverse=True) and deep[-1] == 1
    d = L.depth_for()
    assert 1 - (1 - 0.8**d) ** L.TREES >= L.RECALL


def test_one_of_each(spark):
    rng = random.Random(5)
    rows = [*family(rng, 0, 20), (50, "own text of one more document here"), (51, ""), (52, "")]
    kept = L.one_of_each(frame(spark, rows))
    roots = {c for c, _ in plain(rows).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(roots)


def test_odd_and_empty_tables(spark):
    df = odd(spark)
    out = L.near_duplicates(df).collect()
    assert len(out) == 13
    assert sorted((r.class_id, r.n_links) for r in out if r.doc_id == 1) == [(1, 3), (1, 3)]
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in out if r.root is None)
    kept = L.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), (r.text or "")[:3]) for r in kept.collect()) == sorted(
        [("1", "one"), ("2", "ano"), ("None", ""), ("3", ""), ("4", ""), ("5", " \n\t"[:3]), ("6", "w0x"), ("7", "a"), ("8", "é ñ"), ("9", "\n\n\n")])
    assert L.near_duplicates(empty(spark)).count() == 0
    assert L.one_of_each(empty(spark)).count() == 0


def test_query_equals_sql(spark):
    assert same(spark, SF, QUERIES["op8_jaccard"], ORACLE["op8_jaccard"]) > 0
