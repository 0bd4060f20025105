"""Operator 7, SentencePiece encoding and decoding: suffix-array matching.

A batch of texts is cut where no piece can straddle (before a run of word marks), and the distinct parts
that are new are joined to one text. Its suffixes are sorted by prefix doubling up to the longest piece,
every piece is binary-searched for its range of occurrences, and the occurrences, edges from their start
to their end, are sorted by position and relaxed from left to right.

For a BPE model the relaxation isn't by score, which would not give the library's ids: a path is extended
by an edge only if its last piece and the edge's are compatible, that is, if merging characters by rank
would leave exactly these two. By BPE's locality exactly one piece ends the encoding of each prefix, so
one pass gives the ids of the merge procedure. Runs of several word marks, whose merges tie, and nothing
else, go through the merge procedure itself.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.llm.vectors import release_memory

MARK = "▁"
#: Parts whose ids a task remembers, twice over, their most characters, and characters that are indexed at a time.
REMEMBER, SHORT, INDEX_CHARS = 150_000, 40, 250_000
#: Characters of texts that are encoded, decoded and handed on at a time.
SLICE_CHARS = 500_000


@dataclass
class Pieces:
    """A BPE vocabulary: strings, ranks of merging, byte pieces, and what the relaxation needs."""

    names: list[str]
    usable: np.ndarray  # takes part in merges
    rank: np.ndarray  # lower merges first
    byte_of: dict[int, int]  # id of a byte piece to its byte
    left: np.ndarray  # last merge of a piece; -1 for characters
    right: np.ndarray
    reach: np.ndarray  # the piece's own string encodes to the piece
    pair_keys: np.ndarray  # sorted left * size + right of all pairs that merge
    pair_rank: np.ndarray

    @property
    def size(self) -> int:
        return len(self.names)


def merge(text: str, ids: dict[str, int], rank: np.ndarray) -> list[tuple[str, tuple[str, str] | None]]:
    """The merge procedure on one string: best rank first, then leftmost; (symbol, its last merge) in order."""
    symbols: list[str | None] = list(text)
    last: list[tuple[str, str] | None] = [None] * len(symbols)
    before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0:
            k = ids.get(symbols[i] + symbols[j])
            if k is not None:
                heapq.heappush(heap, (rank[k], i, j, symbols[i] + symbols[j]))

    for i in range(len(symbols) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != both:
            continue
        last[i] = (symbols[i], symbols[j])
        symbols[i], symbols[j] = both, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [(s, m) for s, m in zip(symbols, last, strict=True) if s is not None]


@cache
def load(path: str) -> Pieces:
    """Read a SentencePiece BPE model on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    byte_of = {i: int(names[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
    usable = np.array([not (i in byte_of or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
    rank = np.array([-sp.get_score(i) for i in range(n)])
    if any(MARK in names[i].lstrip(MARK) for i in np.flatnonzero(usable)):
        raise ValueError("pieces with a word mark inside aren't supported")
    ids = {names[i]: int(i) for i in np.flatnonzero(usable)}
    left, right, reach = np.full(n, -1), np.full(n, -1), np.zeros(n, dtype=bool)
    keys = []
    for name, i in ids.items():
        for k in range(1, len(name)):
            a, b = ids.get(name[:k]), ids.get(name[k:])
            if a is not None and b is not None:
                keys.append((a * n + b, rank[i]))
        done = merge(name, ids, rank)
        if len(done) == 1:
            reach[i] = True
            if done[0][1]:
                left[i], right[i] = (ids.get(x, -1) for x in done[0][1])
    keys.sort()
    rank = np.where(np.array([len(x) == 1 for x in names]), -np.inf, rank)  # characters are there from the start
    return Pieces(names, usable, rank, byte_of, left, right, reach & usable, np.array([k for k, _ in keys]), np.array([r for _, r in keys]))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` characters at least."""
    kinds = np.bincount(text) > 0
    rank = np.cumsum(kinds)[text]
    bits = int(kinds.sum()).bit_length()
    k = max(1, min(62 // bits, depth))  # so many characters fit in one number
    packed = np.zeros_like(rank)
    for j in range(min(k, len(rank))):
        packed[: len(rank) - j] |= rank[j:] << bits * (k - 1 - j)
    rank = packed
    order = np.argsort(rank, kind="stable")
    if k < depth:
        rank = _renumbered(rank, order)
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] if k < len(rank) else 0
        key = rank * (rank.max() + 1) + after
        order = np.argsort(key, kind="stable")
        k *= 2
        rank = _renumbered(key, order) if k < depth else rank
    return order


def _renumbered(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the keys, equal for equal keys."""
    by = key[order]
    rank = np.empty_like(key)
    rank[order] = np.cumsum(np.concatenate(([1], by[1:] != by[:-1])))
    return rank


class Encoder:
    """Encodes and decodes on a worker; remembers the ids of short parts until it is told to forget."""

    def __init__(self, p: Pieces) -> None:
        self.p = p
        self.ids = {p.names[i]: int(i) for i in np.flatnonzero(p.usable)}
        self.bytes = {b: i for i, b in p.byte_of.items()}
        mine = [i for i in np.flatnonzero(p.reach) if MARK not in p.names[i][1:]]
        mine.sort(key=lambda i: p.names[i])
        self.found = np.array(mine, dtype=np.int64)
        self.length = np.array([len(x) for x in p.names] + [1])
        self.most = int(self.length[self.found].max())
        self.chars = np.zeros((len(mine), self.most), dtype=np.int64)
        for r, i in enumerate(mine):
            self.chars[r, : len(p.names[i])] = [ord(c) for c in p.names[i]]
        raw = [x.encode() for x in p.names]
        for i, b in p.byte_of.items():
            raw[i] = bytes([b])
        raw = [b"" if not u and i not in p.byte_of else r for i, (r, u) in enumerate(zip(raw, p.usable, strict=True))]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        # Most pairs don't merge: a small table of marks settles those.
        self.marks = np.zeros(1 << 20, dtype=bool)
        self.marks[self._mark(p.pair_keys)] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.long: dict[str, bytes] = {}  # of the texts at hand only

    def _ids(self, symbols: list[str]) -> bytes:
        out: list[int] = []
        for s in symbols:
            k = self.ids.get(s)
            out += [k] if k is not None else [self.bytes[b] for b in s.encode()]
        return np.array(out, dtype=np.int32).tobytes()

    def parts(self, text: str) -> list[str]:
        """The text with a leading mark, cut before every run of marks; a single mark isn't written, runs are, as blanks."""
        text = text.replace(MARK, " ")
        if "  " not in text and text[:1] != " ":
            return text.split(" ") if text else []
        return [x if x.startswith("  ") else x[1:] for x in re.findall(" +[^ ]*", " " + text)]

    @staticmethod
    def _mark(keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 >> 20) & ((1 << 20) - 1)

    def encode(self, texts: list[str], remember: int | None = None) -> list[bytes]:
        """Ids of each text as int32 bytes; ``remember`` (``REMEMBER`` by default) bounds what is known, not the ids."""
        done: list[list[bytes | None]] = []
        open_parts: list[tuple[list[bytes | None], int, str]] = []  # where ids are still to be filled in
        new: dict[str, None] = {}
        room = 0
        for text in texts:
            parts = self.parts(text)
            ids = list(map(self.known.get, parts))
            done.append(ids)
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                part = parts[at]
                old = self.older.get(part)
                if old is not None:
                    self.known[part] = ids[at] = old
                    continue
                open_parts.append((ids, at, part))
                if part not in new:
                    new[part] = None
                    room += len(part)
            if room > INDEX_CHARS:
                self._learn(list(new))
                new, room = {}, 0
        self._learn(list(new))
        for ids, at, part in open_parts:
            ids[at] = self._keep(part)[part]
        out = [b"".join(ids) for ids in done]
        self.long = {}
        if len(self.known) > (REMEMBER if remember is None else remember):  # what the next generation uses is carried over to it
            self.known, self.older = {}, self.known
        return out

    def _keep(self, part: str) -> dict[str, bytes]:
        return self.known if len(part) <= SHORT else self.long

    def _learn(self, parts: list[str]) -> None:
        plain = []
        for part in parts:
            if part.startswith("  "):
                self._keep(part)[part] = self._ids([s for s, _ in merge(part.replace(" ", MARK), self.ids, self.p.rank)])
            else:
                plain.append(part)
        if plain:
            self._index(plain)

    def _ranges(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every piece, the first suffix that starts with it and the first after those, by binary search."""
        padded = np.concatenate((text, np.zeros(self.most, dtype=text.dtype)))
        length = self.length[self.found]
        out = []
        for upper in (False, True):
            lo, hi = np.zeros(len(length), dtype=np.int64), np.full(len(length), len(order))
            while (todo := np.flatnonzero(lo < hi)).size:
                mid = (lo[todo] + hi[todo]) // 2
                start = order[mid]
                sign = np.zeros(len(todo), dtype=np.int8)
                for j in range(self.most):
                    live = np.flatnonzero((sign == 0) & (j < length[todo]))
                    if not live.size:
                        break
                    sign[live] = np.sign(padded[start[live] + j] - self.chars[todo[live], j])
                below = sign <= 0 if upper else sign < 0
                lo[todo[below]] = mid[below] + 1
                hi[todo[~below]] = mid[~below]
            out.append(lo)
        return out[0], out[1]

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of both strings leaves the pieces a and b.

        Goes back in time from the two: the piece that formed last is taken apart, and the pair that met at
        the border until then must not have merged before that. At equal ranks the left merge comes first.
        """
        p, n = self.p, self.p.size
        fine = np.ones(len(a), dtype=bool)
        at = np.flatnonzero((a < n) & (b < n))
        x, y = a[at], b[at]
        limit, ties = np.full(len(at), np.inf), np.ones(len(at), dtype=bool)
        while len(at):
            pair = x * n + y
            r = np.full(len(pair), np.inf)
            maybe = np.flatnonzero(self.marks[self._mark(pair)])
            k = np.searchsorted(p.pair_keys, pair[maybe])
            k[k == len(p.pair_keys)] = 0
            r[maybe] = np.where(p.pair_keys[k] == pair[maybe], p.pair_rank[k], np.inf)
            bad = (r < limit) | (ties & (r == limit) & np.isfinite(r))
            fine[at[bad]] = False
            rx, ry = p.rank[x], p.rank[y]
            go = ~bad & ((rx > -np.inf) | (ry > -np.inf))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            apart = rx > ry
            limit, ties = np.where(apart, rx, ry), ~apart
            x, y = np.where(apart, p.right[x], x), np.where(apart, y, p.left[y])
        return fine

    def _index(self, parts: list[str]) -> None:
        p, unknown = self.p, self.p.size
        joined = "\n".join([MARK + x for x in parts])
        text = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        size = np.array([len(x) for x in parts]) + 1
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        # A line feed inside a part is a character like any other; the joints become 0, which no piece has.
        joint = begin[1:] - 1
        text[joint] = 0
        order = suffix_array(text, self.most)
        lo, hi = self._ranges(text, order)
        times = hi - lo
        piece = np.repeat(self.found, times)
        inside = np.arange(len(piece)) - np.repeat(np.cumsum(times) - times, times)
        start = order[np.repeat(lo, times) + inside]
        # Characters without a piece: an edge of their own.
        single = np.zeros(len(text), dtype=bool)
        single[start[self.length[piece] == 1]] = True
        single[joint] = True
        lone = np.flatnonzero(~single)
        piece, start = np.concatenate((piece, np.full(len(lone), unknown))), np.concatenate((start, lone))

        owner = np.repeat(np.arange(len(parts)), size + 1)[: len(text)]
        level = start - begin[owner[start]]
        by = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 1 << 16 else level, kind="stable")
        piece, start, level = piece[by], start[by], level[by]
        last = np.full(len(text) + 1, -2)  # the piece that ends at a place; -1 at the start of a part
        last[begin] = -1
        bounds = np.searchsorted(level, np.arange(level[-1] + 2)) if len(level) else np.zeros(1, np.int64)
        # The end of a part is the joint's place, so no part writes over the next one's start.
        for d in range(len(bounds) - 1):
            e = slice(bounds[d], bounds[d + 1])
            s, q = start[e], piece[e]
            before = last[s]
            some = before != -2
            s, q, before = s[some], q[some], before[some]
            good = (before == -1) | self._compatible(np.where(before < 0, unknown, before), q)
            last[s[good] + self.length[q[good]]] = q[good]

        # Back from the ends, all parts at once.
        live, at = np.arange(len(parts)), begin + size
        places, tokens = [], []
        while len(live):
            token = last[at]
            places.append(at)
            tokens.append(token)
            at = at - self.length[token]
            on = at > begin[live]
            live, at = live[on], at[on]
        place, token = np.concatenate(places), np.concatenate(tokens)
        by = np.argsort(place)
        place, token = place[by], token[by]
        count = np.ones(len(place), dtype=np.int64)
        out, lost = token.astype(np.int32), np.flatnonzero(token == unknown)
        if len(lost):  # characters without a piece become their bytes
            spelled = [[self.bytes[b] for b in chr(c).encode()] for c in text[place[lost] - 1].tolist()]
            count[lost] = [len(x) for x in spelled]
            out = np.repeat(out, count)
            out[np.repeat(token == unknown, count)] = [i for x in spelled for i in x]
        ends = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(place, begin + size, side="right")] * 4
        flat, lo = out.tobytes(), 0
        for part, hi in zip(parts, ends.tolist(), strict=True):
            self._keep(part)[part] = flat[lo:hi]
            lo = hi

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids: pieces and bytes joined, marks as blanks, without the leading one."""
        out = []
        for lo in range(0, len(bounds) - 1, 200):
            ends = bounds[lo : lo + 201]
            mine = ids[ends[0] : ends[-1]]
            size = self.raw_size[mine]
            after = np.concatenate(([0], np.cumsum(size)))
            joined = self.raw[np.repeat(self.raw_at[mine] - after[:-1], size) + np.arange(after[-1])].tobytes()
            cuts = after[ends - ends[0]].tolist()
            for s, e in zip(cuts, cuts[1:], strict=False):
                text = joined[s:e].decode("utf-8", "replace").replace(MARK, " ")
                out.append(text[1:] if text.startswith(" ") else text)
        return out


_workers: dict[str, Encoder] = {}


def _encoder(p: Pieces, key: str) -> Encoder:
    """One encoder a model and worker process."""
    if key not in _workers:
        _workers[key] = Encoder(p)
    return _workers[key]


def _slices(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters; one row at least."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(size)))
    lo, n = 0, len(size)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + chars, side="right")) - 1)
        yield lo, hi
        lo = hi


def _lists(ids: list[bytes]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def decode_column(ids: Column, model: str) -> Column:
    """The text of a column of ids; '' for none and null."""
    p = load(model)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        size = np.nan_to_num(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False)  # without the ids of null lists
        return pa.array(_encoder(p, model).decode(ids, np.concatenate(([0], np.cumsum(size)))), pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, model: str, keep: Sequence[str] | None = None, remember: int | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``ids``, ``n_tokens`` and ``round_trip``; every row stays, texts whole.

    A null text counts as empty and has no ids. ``round_trip`` tells whether decoding gives the text back; it
    doesn't for texts that hold the word mark U+2581, which decodes to a blank. Columns of ``docs`` with one of the
    three names are replaced. An empty table gives no rows. One narrow stage; the model is read on the driver and
    sent along. A task remembers the ids of ``remember`` parts (``REMEMBER`` by default), twice over, to its end; fewer
    take less of a worker's memory and more time, for the same ids.
    """
    p, made = load(model), ("ids", "n_tokens", "round_trip")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    given = docs.select(*kept, F.coalesce("text", F.lit("")).alias("__text"))
    schema = StructType([*docs.select(*kept).schema.fields, *StructType.fromDDL("ids array<int>, n_tokens long, round_trip boolean").fields])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(p, model)
        for batch in batches:
            for lo, hi in _slices(batch.column("__text"), SLICE_CHARS):
                part = batch.slice(lo, hi - lo)
                texts = part.column("__text").to_pylist()
                ids = _lists(enc.encode(texts, remember))
                back = enc.decode(ids.values.to_numpy(), ids.offsets.to_numpy())
                right = pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())
                del texts, back
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, ids.value_lengths().cast(pa.int64()), right], names=[*kept, *made])
        enc.forget()
        release_memory()

    return given.mapInArrow(code, schema)
