import random
import time
from hashlib import blake2b

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm.linededup import common_blocks, dedup_lines, hashed_lines, least_runs, patience
from tests.llm.helpers import documents, empty, frame, odd, texts, thue_morse


def line(k):
    return f"line number {k} has these seven words"


def result(spark, rows):
    return {(r.doc_id, r.n_lines): (r.text, r.n_deleted) for r in dedup_lines(frame(spark, rows)).collect()}


def plain(texts, least=5):
    """Texts without the lines that stand in a run of lines of ``least`` words which an earlier text has, by searching for each."""
    out, before = [], []
    for text in texts:
        lines = text.split("\n")
        gone = set()
        for j in range(len(lines)):
            for s in range(j, -1, -1):
                e = j
                while e < len(lines) and len(" ".join(lines[s : e + 1]).split()) < least:
                    e += 1
                if e < len(lines):
                    run = "\n" + "\n".join(lines[s : e + 1]) + "\n"
                    if any(run in b for b in before):
                        gone.add(j)
                    if j in gone or e == j:
                        break  # longer runs hold this one
        out.append(("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
        before.append(f"\n{text}\n")
    return out


def test_documents_against_brute_force(spark):
    real = sorted(texts(spark).items())
    want = {i: w for (i, _), w in zip(real, plain([t for _, t in real]), strict=True)}
    assert {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in dedup_lines(documents(spark)).collect()} == want
    assert sum(w[2] for w in want.values()) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_moved_and_short_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["", " ", "one", "two words", "three more words", "here are four words", "now these are five words", "x", "y"]
    made = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    made += ["\n".join(rng.sample(t.split("\n"), len(t.split("\n")))) for t in made[:10]] + made[:5]
    rows = list(enumerate(made))
    want = dict(enumerate(plain(made)))
    assert {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in dedup_lines(frame(spark, rows)).collect()} == want


def test_blocks_between_later_documents(spark):
    header = line(1)
    rows = [(1, header), (2, f"{header}\nshort x\nshort y"), (3, f"{header}\nshort x\nshort y")]
    assert result(spark, rows) == {(1, 1): (header, 0), (2, 3): ("short x\nshort y", 1), (3, 3): ("", 3)}


def test_unlike_lines_of_equal_polynomials_stay(spark):
    one, other = thue_morse(4096)
    got = result(spark, [(1, f"a b c d {one}"), (2, f"a b c d {other}\nend")])
    assert got[(2, 2)] == (f"a b c d {other}\nend", 0)


def test_reversed_lines_take_linear_time():
    lines = [line(k) for k in range(20_000)]
    began = time.time()
    assert common_blocks(lines, lines[::-1], [7] * len(lines)) == list(range(len(lines)))
    assert time.time() - began < 20


def test_blocks_copies_and_moves(spark):
    a = "\n".join([line(1), "short", line(2), line(3)])
    moved = "\n".join(["own first line of other words here", line(3), line(1), "short", "ok"])
    rows = [(1, a), (2, a), (3, moved), (4, "short\nshort"), (5, f"{line(9)}\n{line(9)}"), (6, line(9))]
    got = {k[0]: v for k, v in result(spark, rows).items()}
    assert got == {
        1: (a, 0), 2: ("", 4), 3: ("own first line of other words here\nok", 3), 4: ("short\nshort", 0), 5: (f"{line(9)}\n{line(9)}", 0), 6: ("", 1),
    }


def test_passage_of_many_documents(spark):
    passage = "\n".join(line(k) for k in range(8))
    rows = [(i, f"{line(1000 + i)}\n{passage}\n{line(2000 + i)}") for i in range(120)]
    got = {k[0]: v for k, v in result(spark, rows).items()}
    assert got[0][1] == 0
    assert all(got[i] == (f"{line(1000 + i)}\n{line(2000 + i)}", 8) for i in range(1, 120))


def test_short_lines(spark):
    verse = "\n".join(f"verse {k} goes on" for k in range(20))
    words = "\n".join(f"word{k}" for k in range(6))
    rows = [(1, verse), (2, verse), (3, f"{line(1)}\n{verse}\n\nend"), (4, words), (5, f"own\n\n{words}"), (6, "too few words"), (7, "too few words")]
    got = {k[0]: v for k, v in result(spark, rows).items()}
    assert got == {
        1: (verse, 0), 2: ("", 20), 3: (f"{line(1)}\n\nend", 20), 4: (words, 0), 5: ("own\n", 6), 6: ("too few words", 0), 7: ("too few words", 0),
    }


def test_bodies_below_a_header_of_others(spark):
    body = "\n".join(f"item {k}" for k in range(40))
    rows = [(1, line(1)), (2, f"{line(1)}\n{body}"), (3, f"{line(1)}\n{body}"), (4, f"{line(1)}\nitem 0\nown"), (5, f"own\n{body}\n{line(2)}")]
    got = {k[0]: v for k, v in result(spark, rows).items()}
    assert got == {1: (line(1), 0), 2: (body, 1), 3: ("", 41), 4: ("own", 2), 5: (f"own\n{line(2)}", 40)}


def test_least_runs_against_all_runs():
    rng = random.Random(3)
    for _ in range(300):
        texts = [[rng.choice((0, 0, 1, 2, 4, 5, 9)) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        first, last = least_runs(np.array(sum(texts, [])), np.cumsum([len(t) for t in texts]))
        got, at = set(zip(first.tolist(), last.tolist(), strict=True)), 0
        assert len(got) == len(first)
        for t in texts:
            spans = [(i, j) for i in range(len(t)) for j in range(i, len(t)) if sum(t[i : j + 1]) >= 5]
            own = {(i - at, j - at) for i, j in got if at <= i < at + len(t)}
            assert own <= set(spans)
            # Every run that may be deleted is covered by least runs inside it.
            for i, j in spans:
                inside = [s for s in own if i <= s[0] and s[1] <= j]
                assert {k for a, b in inside for k in range(a, b + 1)} == set(range(i, j + 1))
            at += len(t)


def test_patience_pairs_rise():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(20))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert patience(a, a) == [(k, k) for k in range(len(a))]


def test_line_hashes_and_word_counts(spark):
    rows = [(1, "a b\n\nc"), (2, ""), (3, None), (4, "\n"), (5, "x\ty\x0b z\n"), (6, "a b")]
    got = {r.doc_id: r for r in hashed_lines(frame(spark, rows)).collect()}
    assert {i: r.n_words for i, r in got.items()} == {1: [2, 0, 1], 2: [0], 3: [0], 4: [0, 0], 5: [3, 0], 6: [2]}
    digest = lambda i, k: bytes(got[i].lines[16 * k : 16 * k + 16])
    assert digest(1, 0) == digest(6, 0) == blake2b(b"a b", digest_size=16).digest() and digest(1, 1) == digest(4, 0)


def test_columns_of_the_counts_names(spark):
    df = frame(spark, [(1, line(1)), (2, line(1))]).withColumn("n_lines", F.lit(9)).withColumn("n_deleted", F.lit(9))
    assert sorted((r.doc_id, r.n_lines, r.n_deleted) for r in dedup_lines(df).collect()) == [(1, 1, 0), (2, 1, 1)]
    other = dedup_lines(df, counts=("a", "b"))
    assert sorted((r.n_lines, r.n_deleted, r.a, r.b) for r in other.collect()) == [(9, 9, 1, 0), (9, 9, 1, 1)]


def test_odd_and_empty_tables(spark):
    df = odd(spark)
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_deleted"] and out.count() == 13
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert [r.text for r in by_id[None] if r.n_lines] == ["one two three four five six seven eight nine ten eleven twelve"]
    assert [r.text for r in by_id[1]] == ["", ""] and by_id[3][0].text is None and by_id[3][0].n_lines == 0
    assert dedup_lines(empty(spark)).count() == 0
