import hashlib
import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from loomwork.llm.privacy import DEVIATIONS, DISCLOSURE, KINDS, REACH, base_spans, contexts, find_personal, luhn, sanitise, sanitised_documents
from tests.llm.helpers import documents, empty, frame, odd, texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


EDGES = " \t.,;:!?\"'()[]{}<>|*$%&#"


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def test_patterns_against_plain_search():
    rng = random.Random(1)
    bits = ["1", "2", "9", "0", ".", "@", "+", "-", " ", "a", "(", ")", "\n", "1.2.3.4", "a@b.c", "+1 (386) 555-3733", "4041894974608795", "é", ".5"]
    for _ in range(8000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for part in ("1", "a", "1.", "+1", "a@", "1 ", "0"):
        assert len(base_spans(part * 200_000)) >= 0


def test_all_documents(spark):
    real = texts(spark)
    for r in find_personal(documents(spark)).collect():
        want = plain(real[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in KINDS[:4]]
        assert r.n_base == len(want)
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if not x.startswith("term:")] == (line.split(",") if line else [])


def test_terms_that_disclose(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(("the", "of", "and", "went", "house", "tree", "river", "stone")) for _ in range(n))
    rows = [(i, f"{filler(20)}\n{filler(3)} Projekt Zirkon, {filler(3)} max@mail.example {filler(4)}") for i in range(6)]
    rows += [(100 + i, filler(60)) for i in range(60)]
    rows += [(300, rows[0][1]), (301, "Zirkon alone is no context\nof anyone")]
    text = dict(rows)
    out = {r.doc_id: r for r in find_personal(frame(spark, rows)).collect()}
    for i in (*range(6), 300):
        terms = {text[i][int(s) : int(e)] for k, s, e in (x.split(":") for x in out[i].spans.split(",")) if k == "term"}
        assert terms == {"Projekt", "Zirkon"}
        starts = [int(x.split(":")[1]) for x in out[i].spans.split(",")]
        assert starts == sorted(starts) and out[i].n_email == 1
    assert all(out[i].spans == "" for i in text if i >= 100 and i != 300)


def test_terms_of_one_context_and_of_copies(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(("the", "of", "and", "went", "house", "tree", "river", "stone")) for _ in range(n))
    once = f"{filler(5)} Zirkon {filler(3)} max@mail.example {filler(4)}"
    rows = [(1, once), (2, f"{filler(4)} rare {filler(2)} eva@mail.example"), *((10 + i, f"{filler(4)} rare {filler(9)}") for i in range(20))]
    rows += [(100 + i, filler(200)) for i in range(50)]
    rows += [(1000 + i, once) for i in range(300)]  # copies count once
    found = {}
    for r in find_personal(frame(spark, rows)).collect():
        found[r.doc_id] = {dict(rows)[r.doc_id][int(s) : int(e)] for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
    assert all(found[i] == {"Zirkon"} for i in (1, 1000, 1299))
    assert found[2] == set()


def test_terms_are_marked_in_all_texts(spark):
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(("the", "of", "and", "went", "house", "tree", "river", "stone")) for _ in range(n))
    rows = [(i, f"{filler(3)} Zirkon, {filler(3)} max@mail.example {filler(4)}") for i in range(6)]
    rows += [(100 + i, filler(200)) for i in range(40)]
    rows += [(200, "own line\nthe (Zirkon) alone, zirkon! again"), (201, "the zirkon@mail.example"), (202, None)]
    out = {r.doc_id: r for r in find_personal(frame(spark, rows), everywhere=True).collect()}
    assert all(out[i].n_terms == 1 for i in range(6))
    assert out[200].spans == "term:14:20,term:29:35" and out[200].n_terms == 2
    assert out[201].n_terms == 0 and all(out[i].spans == "" for i in (*range(100, 140), 202))


def counted(rows):
    """Term spans of each text by the definition: counts over different texts, one window of words an entity."""
    terms = lambda line, lo: [(m.group().strip(EDGES).lower(), lo + m.start() + len(m.group()) - len(m.group().lstrip(EDGES)), m) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
    n, n_t, n_c, n_ct, found = 0, Counter(), Counter(), Counter(), {}
    for text in {t or "" for _, t in rows}:
        spans, lo, lines = plain(text), 0, []
        for line in text.split("\n"):
            lines.append((lo, line))
            lo += len(line) + 1
        free = lambda a, b, spans=spans: not any(a < e and s < b for _, s, e in spans)
        for lo, line in lines:
            n += len(re.findall(r"[^\x20\x09-\x0D]+", line))
            for t, s, m in terms(line, lo):
                if t:
                    n_t[t] += 1
                    if free(lo + m.start(), lo + m.end()):
                        found.setdefault(text, []).append((t, s, s + len(m.group().strip(EDGES))))
        for kind, s, e in spans:
            c = (kind, text[s:e])
            n_c[c] += 1
            lo, line = next((lo, x) for lo, x in lines if lo <= s <= lo + len(x))
            before, after = terms(text[lo:s], lo)[-REACH:], terms(text[e : lo + len(line)], e)[:REACH]
            near = {t for base, some in ((lo, before), (e, after)) for t, _, m in some if t and free(base + m.start(), base + m.end())}
            for t in near:
                n_ct[c, t] += 1
    shown = set()
    for (c, t), k in n_ct.items():
        seen = max(n_t[t], k)
        share, z2 = k / seen, DEVIATIONS**2
        least = (share + z2 / (2 * seen) - DEVIATIONS * math.sqrt(share * (1 - share) / seen + z2 / (4 * seen * seen))) / (1 + z2 / seen)
        if math.log(n / n_c[c]) > 0 and math.log(least * n / n_c[c]) >= DISCLOSURE * math.log(n / n_c[c]):
            shown.add(t)
    return {text: {(s, e) for t, s, e in some if t in shown} for text, some in found.items()}, shown


def test_terms_against_counting_by_hand(spark):
    rows = list(texts(spark).items()) + [(10_000 + i, t) for i, t in list(texts(spark).items())[:20]]
    rows += [(20_000, "Ask Zirkon at max@mail.example\nnow"), (20_001, "Zirkon at max@mail.example, max@mail.example and Zirkon"), (20_002, "zirkon?"), (20_003, None)]
    want, shown = counted(rows)
    out = find_personal(frame(spark, rows), everywhere=True).collect()
    assert len(out) == len(rows) and "zirkon" in shown and len(shown) > 20
    real = dict(rows)
    for r in out:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert {(int(s), int(e)) for k, s, e in spans if k == "term"} == want.get(real[r.doc_id] or "", set()), r.doc_id
        assert r.n_terms == sum(k == "term" for k, *_ in spans)
        clean = generalised(real[r.doc_id] or "", [(k, int(s), int(e)) for k, s, e in spans])
        assert r.sanitised_sha256 == hashlib.sha256(clean.encode()).hexdigest()
    clean = {r.doc_id: r.text for r in sanitised_documents(frame(spark, rows)).collect()}
    assert clean[20_002] == "[TERM]?" and clean[20_003] is None and len(clean) == len(rows)
    assert clean[20_001].startswith("[TERM] at [EMAIL]")


def generalised(text, spans):
    out, at = "", 0
    for k, s, e in spans:
        if e > max(s, at):
            out, at = out + text[at : max(s, at)] + f"[{k.upper()}]", e
    return out + text[at:]


def test_many_entities_take_linear_time():
    took = []
    for n in (2_000, 16_000):
        text = "word of mail " + " and ".join(f"user{i}@mail{i}.example" for i in range(n))
        spans = base_spans(text)
        began = time.process_time()
        assert sum(1 for _ in contexts(text, spans)) > n
        took.append(time.process_time() - began)
    assert took[1] < 8 * 3 * max(took[0], 0.02)


def test_contexts_stay_in_reach_and_line():
    text = "far away\nnear, \"Name\" me@x.yz after 4111 tail"
    terms = {text[s:e] for *_, s, e in contexts(text, base_spans(text), 2)}
    assert terms == {"near", "Name", "after", "4111"}


def test_sanitised_text(spark):
    df = spark.createDataFrame([("call a@b.cd now", "email:5:11"), ("x", ""), (None, None), ("abcdef", "term:1:3,term:2:5")], "t string, s string")
    assert [r[0] for r in df.select(sanitise(F.col("t"), F.col("s"))).collect()] == ["call [EMAIL] now", "x", "", "a[TERM][TERM]f"]


def test_odd_and_empty_tables(spark):
    out = find_personal(odd(spark)).collect()
    assert len(out) == 13
    assert [r.n_email for r in out if r.doc_id == 8] == [1]
    assert find_personal(empty(spark)).count() == 0
