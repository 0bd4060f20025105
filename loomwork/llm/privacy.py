"""Operator 3, personal data: patterns, and information-theoretic sanitisation of what gives them away.

Emails, addresses, card and phone numbers are found by pattern. Each distinct one is a protected entity.
A term (a word without outer punctuation, in lower case) discloses an entity as far as its presence tells
that the entity is near: PMI(term, entity) / information of the entity, between words at most ``REACH``
words apart in a line. The share of a term's occurrences that have the entity near enters at its lower bound, so a
rare word that stands near an entity by chance is none, and one that stands nowhere else is. Terms at or
above the disclosure threshold become spans of kind ``term`` in reach of that entity, or in all texts, and are
generalised to their kind like the entities themselves.

Counts are over the corpus of different texts, so that copies of a document count once: N words, n(t) occurrences of
a term, n(c) of an entity, and n(c, t) of an entity with the term in reach. A row counts one by the number of rows
with its text; all sums are of such parts and rounded.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import Scratch
from loomwork.llm.vectors import Words, words

# The kinds in their order, and the characters of each pattern.
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: A term's share of the entity's information from which it is a disclosure.
DISCLOSURE = 0.8
#: Deviations below the observed share of a term's occurrences at which its lower bound lies (Wilson, one-sided 95 %).
DEVIATIONS = 1.645
REACH = 10
#: Different terms whose counts a task holds at most.
HELD = 500_000
#: Texts with copies are broadcast (hash and number) up to this many, 16 MB; beyond it texts are joined by a shuffle.
BROADCAST_COPIES = 1_000_000
#: Bits of the filter of terms; its size is fixed, a false hit costs a row and changes nothing.
FILTER_BITS = 1 << 25
#: Bytes of texts whose words are looked up together.
TOGETHER = 1 << 22


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches from one '@' to the next: a local part never holds one, so each is tried once."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four kinds, by start, then kind. Time is linear in the text."""
    found = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


_NEXT = re.compile(r"[\x20\t\x0b\x0c\r]*+([^\x20\x09-\x0D]+)")
_EDGES = " \t.,;:!?\"'()[]{}<>|*$%&#"


def _term(word: str) -> tuple[str, int]:
    """The term of a word and where it starts in it; '' for punctuation only."""
    left = word.lstrip(_EDGES)
    return left.rstrip(_EDGES).lower(), len(word) - len(left)


class Covered:
    """Which places lie in base spans: their union as disjoint ranges, so that each place takes one search."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, s, e in spans:  # by start
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1  # the last range that starts before the end
        return k >= 0 and self.ends[k] > start


def contexts(text: str, spans: list[tuple[str, int, int]], reach: int = REACH) -> Iterator[tuple[int, bool, int, int, int]]:
    """(entity, whether the first of this term at it, term, start, end) of every term in reach, hashed.

    Base spans aren't terms. Reads at most the line of the entity, word by word from it, so all entities of a text
    take time in proportion to ``reach`` each.
    """
    covered = Covered(spans)
    for kind, start, end in spans:
        entity = _hash(f"{kind}:{text[start:end]}")
        near: list[tuple[int, int]] = []
        at = start
        for _ in range(reach):  # backwards
            while at > 0 and text[at - 1] in " \t\x0b\x0c\r":
                at -= 1
            if at == 0 or text[at - 1] == "\n":
                break
            stop = at
            while at > 0 and text[at - 1] not in " \t\n\x0b\x0c\r":
                at -= 1
            near.append((at, stop))
        near.reverse()
        at = end
        for _ in range(reach):
            m = _NEXT.match(text, at)
            if not m:
                break
            near.append(m.span(1))
            at = m.end()
        met: set[str] = set()
        for s, e in near:
            if not covered.meets(s, e):
                term, skip = _term(text[s:e])
                if term:
                    yield entity, term not in met, _hash(term), s + skip, s + skip + len(text[s:e].strip(_EDGES))
                    met.add(term)


def _generalised(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for kind, s, e in spans:
        s = max(s, at)
        if e > s:
            parts += [text[at:s], f"[{kind.upper()}]"]
            at = e
    return "".join([*parts, text[at:]])


def _digest(text: str) -> str:
    return sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _scan() -> Column:
    """A struct of base counts, base spans, entities, terms in their reach, and the digest of the generalised text, of a text column."""

    @F.pandas_udf(
        "n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>, near array<struct<c:long,new:boolean,t:long,s:int,e:int>>, clean string"
    )
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = base_spans(text)
            n = [sum(k == kind for k, _, _ in spans) for kind in KINDS[:4]]
            found = [None] * 3
            if spans:
                near = [dict(zip(("c", "new", "t", "s", "e"), x, strict=True)) for x in contexts(text, spans)]
                found = [[_hash(f"{k}:{text[s:e]}") for k, s, e in spans], near, _digest(_generalised(text, spans))]
            rows.append((*n, ",".join(f"{k}:{s}:{e}" for k, s, e in spans), *found))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "entities", "near", "clean"])

    return scan("text")


def _marks(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of the terms (column t) with two bits each, made where the terms are."""
    cells = terms.select(F.explode(F.array(_cell(F.col("t")), _cell(F.shiftright("t", 25)))).alias("i"))
    parts = cells.groupBy(F.bitmap_bucket_number(F.col("i") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("i") + 1)).alias("b"))
    out = np.zeros((FILTER_BITS // 32768, 4096), dtype=np.uint8)
    for r in parts.collect():  # FILTER_BITS / 8 bytes at most
        out[r["k"] - 1] = np.frombuffer(r["b"], np.uint8)
    return out.ravel()


def _cell(x: Column) -> Column:
    return x.bitwiseAND(F.lit(FILTER_BITS - 1))


def _known_terms(w: Words, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words whose term is in the filter; the term's hash, where it starts in the word and ends."""
    _, one, back = np.unique(w.hashes, return_index=True, return_inverse=True)
    term, skip, stop, fits = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), np.zeros(len(one), bool)
    for k, i in enumerate(one.tolist()):
        word = w.data[w.starts[i] : w.ends[i]].tobytes().decode("utf-8", "surrogatepass")
        name, at = _term(word)
        if name:
            term[k], skip[k], stop[k], fits[k] = _hash(name), at, at + len(word.strip(_EDGES)), True
    for cell in (term & (FILTER_BITS - 1), term >> 25 & (FILTER_BITS - 1)):
        fits &= (marks[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    at = np.flatnonzero(fits[back])
    kind = back[at]
    return at, term[kind], skip[kind], stop[kind]


def term_counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(t, n): occurrences of at least the candidate terms (column t), weighted by the rows' ``weight``; and t null with N, all words.

    A table of fixed size tells each task the words to count; each task shuffles a row a term that it met.
    """
    marks = _marks(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, terms, sums = 0.0, np.zeros(0, np.int64), np.zeros(0)

        def rows(t: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(n, pa.float64())], names=["t", "n"])

        for batch in batches:
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            for w in words(batch.column("text"), TOGETHER):
                own = weight[w.lo : w.hi]
                total += float(own @ w.counts)
                at, term, _, _ = _known_terms(w, marks)
                terms = np.concatenate((terms, term))
                sums = np.concatenate((sums, own[np.searchsorted(w.first, at, side="right") - 1]))
                if len(terms) > 4 * HELD:
                    terms, back = np.unique(terms, return_inverse=True)
                    sums = np.bincount(back, sums, len(terms))
                    if len(terms) > HELD:
                        yield rows(terms, sums)
                        terms, sums = terms[:0], sums[:0]
        terms, back = np.unique(terms, return_inverse=True)
        yield rows(terms, np.bincount(back, sums, len(terms)))
        yield rows(pa.array([None], pa.int64()), np.array([total]))

    met = docs.select("text", "weight").mapInArrow(count, "t long, n double")
    return met.groupBy("t").agg(F.round(F.sum("n")).alias("n"))


def disclosures(rows: DataFrame, docs: DataFrame, scratch: Scratch, threshold: float) -> DataFrame | None:
    """(c, t) pairs of an entity and a term that discloses it; None if no entity has a term in reach."""
    near = rows.select("weight", F.explode("near").alias("x")).where("x.new").groupBy("x.c", "x.t").agg(F.round(F.sum("weight")).alias("nct"))
    alone = scratch.put(rows.select("weight", F.explode("entities").alias("c")).groupBy("c").agg(F.round(F.sum("weight")).alias("nc")))
    together = scratch.put(near.join(alone, "c"))
    if together.isEmpty():
        return None
    counts = scratch.put(term_counts(docs, together.select("t")))
    n = F.lit(float(counts.where("t IS NULL").first()["n"]))
    both = together.join(counts.withColumnRenamed("n", "nt"), "t").withColumn("nt", F.greatest("nt", "nct"))
    share, z2 = F.col("nct") / F.col("nt"), DEVIATIONS**2
    spread = DEVIATIONS * F.sqrt(share * (1 - share) / F.col("nt") + z2 / (4 * F.col("nt") * F.col("nt")))
    least = (share + z2 / (2 * F.col("nt")) - spread) / (1 + z2 / F.col("nt"))
    pmi, information = F.log(least * n / F.col("nc")), F.log(n / F.col("nc"))
    found = scratch.put(both.where((information > 0) & (pmi >= threshold * information)).select("c", "t"))
    scratch.drop(together, counts, alone)
    return found


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """key, text, base and hits (t, s, e) of the texts with a word whose term is in the filter of ``terms`` (column t), outside base spans."""
    marks = _marks(terms)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text"), TOGETHER):
                at, term, skip, stop = _known_terms(w, marks)
                row = np.searchsorted(w.first, at, side="right") - 1
                points = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))  # code points before each byte
                place = points[w.starts[at]] - points[w.offsets[row]]
                size = points[w.ends[at]] - points[w.starts[at]]
                out = []
                for i, lo in zip(*np.unique(row, return_index=True), strict=True):
                    hi = np.searchsorted(row, i, side="right")
                    text = batch.column("text")[w.lo + int(i)].as_py()
                    spans = base_spans(text)
                    covered = Covered(spans)
                    mine = [
                        {"t": t, "s": p + a, "e": p + b}
                        for t, p, n, a, b in zip(*(x[lo:hi].tolist() for x in (term, place, size, skip, stop)), strict=True) if not covered.meets(p, p + n)
                    ]
                    if mine:
                        out.append((batch.column("key")[w.lo + int(i)].as_py(), text, ",".join(f"{k}:{s}:{e}" for k, s, e in spans), mine))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(("key", "text", "base", "hits"), x, strict=True)) for x in out], _HITS)

    return docs.select("key", "text").mapInArrow(find, "key string, text string, base string, hits array<struct<t:long,s:int,e:int>>")


_HITS = pa.schema([
    ("key", pa.string()), ("text", pa.string()), ("base", pa.string()),
    ("hits", pa.list_(pa.struct([("t", pa.int64()), ("s", pa.int32()), ("e", pa.int32())]))),
])


def _key(text: Column) -> Column:
    """What tells rows by doc_id and text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("/"), F.md5(text.cast("binary"))).cast("binary"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, th (hash of the text) and key (of both); equal rows have equal keys."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"), _key(text).alias("key"))


def find_personal(docs: DataFrame, threshold: float = DISCLOSURE, everywhere: bool = False) -> DataFrame:
    """doc_id, counts of the four kinds, base_sha256, spans, n_base, n_terms and sanitised_sha256 of every row, repeated ones too.

    n_base is the number of base spans of any kind, n_terms that of the others. Spans are kind:start:end in code
    points, end exclusive, by start, then kind, joined by commas; sanitised_sha256 is the digest of the text with each
    generalised (``sanitise``). A null text counts as empty and has none; a null doc_id is kept. An empty table gives
    no rows. Other columns are ignored. A term is marked in reach of the entity that it discloses; with ``everywhere``
    also wherever else it stands, in any line or document. Texts go through Python once for patterns, once for counts
    and once for marks; only those with a mark are written or shuffled.
    """
    return _find(_keyed(docs), threshold, everywhere).drop("key")


def _find(docs: DataFrame, threshold: float, everywhere: bool) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", "key", "th", _scan().alias("f"), F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    rows = scratch.put(rows.select("doc_id", "key", "th", "f.*", "own"))
    copies = scratch.put(rows.groupBy("th").agg(F.count("*").alias("n")).where("n > 1"))
    few = copies.count() <= BROADCAST_COPIES
    weighed = lambda df: df.join(F.broadcast(copies) if few else copies, "th", "left").withColumn("weight", 1 / F.coalesce("n", F.lit(1)))
    found = weighed(rows.where("entities IS NOT NULL"))
    pairs = disclosures(found, weighed(docs), scratch, threshold)
    out = rows.select("doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base", F.coalesce("clean", "own").alias("clean"))
    if pairs is None:
        out = out.withColumn("spans", F.col("base")).withColumn("n_terms", F.lit(0))
    else:
        near = rows.select("key", F.explode("near").alias("x")).select("key", "x.*").join(pairs, ["c", "t"]).select("key", "s", "e")
        if everywhere:
            terms = scratch.put(pairs.select("t").distinct())
            marked = scratch.put(occurrences(docs, terms))
            hits = marked.select("key", F.explode("hits").alias("x")).select("key", "x.*").join(terms, "t", "left_semi").select("key", "s", "e")
            texts = marked.select("key", "text", "base")
        else:
            hits, texts = near, docs.select("key", "text").join(rows.where("entities IS NOT NULL").select("key", "base").distinct(), "key")
        places = scratch.put(hits.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("terms")))
        merged = texts.join(places, "key").withColumn("spans", _merged(F.col("base"), F.col("terms")))
        merged = merged.select("key", "spans", F.size("terms").alias("n_terms"), F.sha2(sanitise(F.col("text"), F.col("spans")).cast("binary"), 256).alias("sha"))
        merged = scratch.put(merged.distinct())  # equal rows have equal keys
        out = out.join(merged, "key", "left").withColumn("spans", F.coalesce("spans", "base")).withColumn("clean", F.coalesce("sha", "clean"))
    return out.select(
        "doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans", (F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone")).alias("n_base"),
        F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"), F.col("clean").alias("sanitised_sha256"),
    )


def _merged(base: Column, terms: Column) -> Column:
    """The base spans with the terms' places, by start, then kind."""
    part = lambda x, i: F.get(F.split(x, ":"), i)
    order = F.array(*map(F.lit, KINDS))
    given = F.when(base == "", F.array()).otherwise(F.transform(F.split(base, ","), lambda x: F.struct(
        part(x, 1).cast("int").alias("s"), F.array_position(order, part(x, 0)).alias("k"), part(x, 2).cast("int").alias("e"))))
    own = F.transform(terms, lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).cast("long").alias("k"), x["e"].alias("e")))
    return F.array_join(F.transform(
        F.sort_array(F.concat(given, own)), lambda x: F.concat_ws(":", F.get(order, (x["k"] - 1).cast("int")), x["s"], x["e"])), ",")


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span generalised to its kind in brackets; spans inside another are covered by it."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts.fillna(""), all_spans.fillna(""), strict=True):
            parted = (x.split(":") for x in spans.split(",") if x)
            out.append(_generalised(t, [(k, int(s), int(e)) for k, s, e in parted]))
        return pd.Series(out, dtype=object)

    return clean(text, spans)


def sanitised_documents(docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """All rows and columns of ``docs``, with personal data and the terms that disclose it generalised wherever they stand.

    A null text stays null. Texts with a span are joined with it, so texts move once here.
    """
    spans = _find(_keyed(docs), threshold, everywhere=True).where("spans <> ''").select(F.col("key").alias("__key"), F.col("spans").alias("__spans")).distinct()
    joined = docs.withColumn("__key", _key(F.coalesce("text", F.lit("")))).join(spans, "__key", "left")
    clean = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(sanitise(F.col("text"), F.col("__spans")))
    return joined.withColumn("text", clean).select(*docs.columns)
