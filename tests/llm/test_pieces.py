import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomwork.llm import pieces as P
from loomwork.llm.queries import PIECE_MODEL
from tests.llm.helpers import documents, empty, odd, texts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def ids(enc, some):
    return [np.frombuffer(x, np.int32).tolist() for x in enc.encode(some)]


def test_fuzz_equals_the_library(library):
    p = P.load(PIECE_MODEL)
    enc = P.Encoder(p)
    rng = random.Random(3)
    some = ["", " ", "  Hello\n world ▁x  é中\U0001f600", "a" * 40, "   ", "<0x0A> <s> </s> <unk>", "x" * 500 + " " * 50 + "y", "\x00a\tb", "é ﬁ Ⅷ"]
    some += ["".join(rng.choice("abcdetheingionr \n▁éß中!<>0xA") for _ in range(rng.randrange(60))) for _ in range(800)]
    some += ["".join(rng.choice(p.names[300:]) for _ in range(20)).replace("▁", " ") for _ in range(200)]
    got = ids(enc, some)
    assert got == library.encode(some)
    flat, bounds = np.concatenate([np.array(g, dtype=np.int64) for g in got]), np.cumsum([0, *map(len, got)])
    assert enc.decode(flat, bounds) == [t.replace("▁", " ") for t in some]
    assert [d for d, t in zip(library.decode(got), some, strict=True) if "\x00" not in t] == [t.replace("▁", " ") for t in some if "\x00" not in t]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(P, "REMEMBER", 5)
    monkeypatch.setattr(P, "INDEX_CHARS", 30)
    enc = P.Encoder(P.load(PIECE_MODEL))
    some = ["the cat sat on the mat and the hat", "the cat sat", "on the mat"]
    assert ids(enc, some) == ids(enc, some) == library.encode(some)


def test_parts_make_up_the_text():
    enc = P.Encoder(P.load(PIECE_MODEL))
    assert enc.parts("Hello, world  (yes) ") == ["Hello,", "world", "  (yes)", ""]
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab1 .,_-(é\n") for _ in range(rng.randrange(1, 30)))
        assert "".join(x if x.startswith("  ") else f" {x}" for x in enc.parts(text)) == f" {text}"


def test_suffix_array():
    rng = random.Random(1)
    text = np.array([rng.randrange(1, 4) for _ in range(300)])
    order = P.suffix_array(text, 16)
    keys = [tuple(text[i : i + 16]) for i in order]
    assert sorted(order) == list(range(300)) and keys == sorted(keys)


def test_documents_round_trip(spark, library):
    real = texts(spark)
    for r in P.encode_documents(documents(spark), PIECE_MODEL).collect():
        assert r.round_trip and r.ids == library.encode(real[r.doc_id]) and r.n_tokens == len(r.ids)


def test_odd_and_empty_tables(spark):
    out = P.encode_documents(odd(spark), PIECE_MODEL)
    rows = out.collect()
    assert len(rows) == 13 and all(r.round_trip for r in rows)
    assert all(r.n_tokens == 0 for r in rows if not r.text)
    assert P.encode_documents(empty(spark), PIECE_MODEL).count() == 0
    assert out.select(P.decode_column(F.lit(None).cast("array<int>"), PIECE_MODEL)).first()[0] == ""


def test_remembering_less_gives_the_same_ids(library):
    enc = P.Encoder(P.load(PIECE_MODEL))
    some = [" ".join(f"word{i}x{k}" for k in range(50)) for i in range(20)]
    for lo in range(0, 20, 2):
        assert [np.frombuffer(x, np.int32).tolist() for x in enc.encode(some[lo : lo + 2], 60)] == library.encode(some[lo : lo + 2])
        assert len(enc.known) <= 60 and len(enc.older) <= 160
