"""Operator 5, line dedup: pairwise alignment of documents that share lines.

Lines are hashed to 128 bits of BLAKE2b, for which nobody can name two different lines that share one. Documents are
paired by runs of neighbouring lines: for every line, the shortest runs that hold it and reach ``LEAST_WORDS`` words (a
line that long is such a run itself), and by whole texts. Whatever a common block may delete lies in runs that both
documents have, and each run pairs a later document with its own first holder, so a run that n documents share gives
n - 1 pairs at most, and a document finds the holder of a body also where another one holds its header. That bound lets
frequent lines count like rare ones: with a cut by frequency, a passage of thousands of documents would be lost.

Each pair is aligned by patience diff (lines that are unique in both, longest increasing run, then outwards and
between), and common blocks are deleted from the later document. Blocks of it that moved, which an alignment leaves
behind, are then found by their runs. So a line goes if and only if it stands in a run of lines, ``LEAST_WORDS`` words
or more, that some earlier document has too. Document order is doc_id, then a hash of the text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import Scratch
from loomwork.llm.vectors import BLANK, U, chunks, release_memory, released, run_hashes

#: Words that a run of lines needs to pair documents, and that a common block needs to be deleted.
LEAST_WORDS = 5
#: Bytes of a line's hash.
DIGEST = 16


def least_runs(n_words: np.ndarray, ends: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of all shortest runs that hold some line and reach ``least`` words, and of whole texts that do.

    They are sorted, without repeats. ``n_words`` goes over the lines of several texts, ``ends`` is where each text
    ends. A run starts at the line that it is for or at an earlier line with words, so a line has at most ``least`` + 1.
    """
    n = len(n_words)
    lines = np.arange(n)
    sums = np.concatenate(([0], np.cumsum(n_words, dtype=np.int64)))
    starts = np.concatenate(([0], ends[:-1]))
    text = np.searchsorted(ends, lines, side="right")
    reach = np.searchsorted(sums, sums[:-1] + least) - 1  # last line of the shortest run from each line on
    reach[reach >= ends[text]] = n  # the text ends before
    before = np.concatenate(([-1], np.maximum.accumulate(np.where(n_words > 0, lines, -1))[:-1])) if n else lines
    before[before < starts[text]] = -1  # the line with words before, in the same text
    at, held, last = lines, lines, np.full(n, n)
    found = []
    for _ in range(least + 1):
        stop = np.maximum(reach[at], held)
        shorter = stop < last
        found.append(at[shorter] * (n + 1) + stop[shorter])
        going = (before[at] >= 0) & (stop > held)  # from a run that ends with the line, earlier starts add nothing
        last, held, at = np.minimum(stop, last)[going], held[going], before[at[going]]
    whole = sums[ends] - sums[starts] >= least
    found.append(starts[whole] * (n + 1) + ends[whole] - 1)
    code = np.unique(np.concatenate(found))
    return code // (n + 1), code % (n + 1)


def hashed_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, th (hash of the text), lines (the lines' hashes, joined), n_words of every line, and runs (hashes of its least runs)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                breaks = np.flatnonzero(data == 10)
                # Each text has one line more than line feeds.
                starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
                stops = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
                solid = ~BLANK[data]
                begins = solid.copy()
                begins[1:] &= ~solid[:-1]
                edge = offsets[:-1][offsets[:-1] < len(data)]
                begins[edge] = solid[edge]
                before = np.concatenate(([0], np.cumsum(begins)))
                n_words = (before[stops] - before[starts]).astype(np.int32)
                whole = memoryview(np.ascontiguousarray(data))
                joined = b"".join([blake2b(whole[s:e], digest_size=DIGEST).digest() for s, e in zip(starts.tolist(), stops.tolist(), strict=True)])
                per = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
                ends = np.concatenate(([0], np.cumsum(per)))
                first, last = least_runs(n_words, ends[1:], least)
                runs = run_hashes(np.frombuffer(joined, U)[:: DIGEST // 8], first, last).view(np.int64)
                at = lambda x: pa.array(x.astype(np.int32))
                lines = pa.Array.from_buffers(pa.binary(), hi - lo, [None, at(ends * DIGEST).buffers()[1], pa.py_buffer(joined)])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), batch.column("th").slice(lo, hi - lo), lines,
                    pa.ListArray.from_arrays(at(ends), pa.array(n_words)), pa.ListArray.from_arrays(at(np.searchsorted(first, ends)), pa.array(runs)),
                ], names=["doc_id", "th", "lines", "n_words", "runs"])

    named = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    return named.mapInArrow(released(scan), "doc_id long, th long, lines binary, n_words array<int>, runs array<long>")


def _longest_run(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest part, sorted by the first numbers, whose second numbers rise."""
    tops: list[int] = []
    ids: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(ids[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            ids.append(k)
        else:
            tops[pile], ids[pile] = j, k
    out = []
    k = ids[-1] if ids else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Matched places of two sequences, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        n_a, n_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if n_b[x] == 1}
        anchors = _longest_run([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if n_a[x] == 1 and x in place])
        if not anchors:
            at = b0  # lines that repeat: in order, as they come
            where: dict[int, list[int]] = {}
            for j in range(b0, b1):
                if b[j] in n_a:
                    where.setdefault(b[j], []).append(j)
            for i in range(a0, a1):
                places = where.get(a[i], [])
                k = bisect_left(places, at)
                if k < len(places):
                    out.append((i, places[k]))
                    at = places[k] + 1
            continue
        last_i, last_j = a0, b0
        for i, j in anchors:
            out.append((i, j))
            todo.append((last_i, i, last_j, j))
            last_i, last_j = i + 1, j + 1
        todo.append((last_i, a1, last_j, b1))
    return sorted(out)


def common_blocks(first: Sequence, later: Sequence, n_words: list[int], least: int = LEAST_WORDS, first_words: list[int] | None = None) -> list[int]:
    """Lines of the later document that lie in a common block of at least ``least`` words.

    ``n_words`` is of the later one's lines, ``first_words`` of the first one's; equal lines have equally many words.
    """
    gone: list[int] = []
    block: list[tuple[int, int]] = []
    for pair in [*patience(first, later), (-2, -2)]:
        if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(n_words[j] for _, j in block) >= least:
                gone += [j for _, j in block]
            block = []
        block.append(pair)
    if len(gone) == len(later):
        return gone
    # What moved: least runs of the later document, not all of whose lines are gone, that the first one has.
    if first_words is None:
        words = dict(zip(later, n_words, strict=True))
        first_words = [words.get(x, 0) for x in first]  # a run with other lines matches nothing
    spans = lambda n: zip(*(x.tolist() for x in least_runs(np.array(n, dtype=np.int64), np.array([len(n)]), least)), strict=True)
    met = np.zeros(len(later), dtype=bool)
    met[gone] = True
    held = set(first)
    there = np.array([x in held for x in later])
    other = np.concatenate(([0], np.cumsum(~there)))
    open_runs = [(s, e) for s, e in spans(n_words) if other[s] == other[e + 1] and not met[s : e + 1].all()]
    if open_runs:
        known = {tuple(first[s : e + 1]) for s, e in spans(first_words)}
        for s, e in open_runs:
            if tuple(later[s : e + 1]) in known:
                met[s : e + 1] = True
    return np.flatnonzero(met).tolist()


def deletions(lined: DataFrame, scratch: Scratch, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, th, gone: the numbers of the lines to delete from each document that has any."""
    key = F.struct("doc_id", "th")
    # Written once without repeats: joins on plain tables can be split where one first document serves many.
    sides = scratch.put(lined.select(key.alias("k"), "lines", "n_words", "runs").dropDuplicates(["k"]))
    seen = sides.select(F.col("k").alias("d"), F.explode(F.array_distinct("runs")).alias("run"))
    shared = scratch.put(seen.groupBy("run").agg(F.min("d").alias("f"), F.count("*").alias("df")).where("df > 1"))
    pairs = scratch.put(seen.join(shared, "run").where("d <> f").select("d", "f").distinct())
    with_first = pairs.join(sides.select(F.col("k").alias("f"), F.col("lines").alias("first"), F.col("n_words").alias("first_words")), "f").select("d", "first", "first_words")
    both = with_first.join(sides.select(F.col("k").alias("d"), "lines", "n_words"), "d").select("d.doc_id", "d.th", "first", "first_words", "lines", "n_words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lambda x: [x[k : k + DIGEST] for k in range(0, len(x), DIGEST)]
        for batch in batches:
            out = []
            for i in range(batch.num_rows):  # one pair in memory at a time
                first, first_words, lines, n_words = (batch.column(k)[i].as_py() for k in ("first", "first_words", "lines", "n_words"))
                out.append(list(range(len(n_words))) if first == lines else common_blocks(cut(first), cut(lines), n_words, least, first_words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "th", "gone"])

    cut = both.mapInArrow(released(align), "doc_id long, th long, gone array<int>")
    gone = scratch.put(cut.select("doc_id", "th", F.explode("gone").alias("line_no")).groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("gone")))
    scratch.drop(sides, shared, pairs)
    return gone


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS, counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """All columns of ``docs`` with the text that is left, and n_lines and n_deleted; every row stays.

    The two counts are named by ``counts``; a column of ``docs`` that has such a name is replaced.

    The first document that holds a line keeps it; a later exact copy of ``least`` words or more loses all its
    lines and has the text ''. Rows with equal doc_id and text count as one document and get the same result. A null
    text has no lines and stays null; null ids come first. Lines of fewer words only go as part of a larger block. An
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    lined = scratch.put(hashed_lines(docs, least))
    gone = deletions(lined, scratch, least)
    scratch.drop(lined)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__gth"), F.array_sort("gone").alias("__gone"))
    own = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = own.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__gth")), "left").drop("__id", "__gth", "__th")

    @F.arrow_udf("string")
    def without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gones in batches:
            out = []
            for t, g in zip(texts.to_pylist(), gones.to_pylist(), strict=True):
                if t is not None and g:
                    drop = set(g)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
                out.append(t)
            yield pa.array(out, pa.string())
        release_memory()

    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    counted = joined.withColumn(counts[0], n.cast("long")).withColumn(counts[1], F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    return counted.withColumn("text", without("text", "__gone")).drop("__gone")
