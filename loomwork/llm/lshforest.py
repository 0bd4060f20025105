"""Operator 8, n-gram Jaccard join: MinHash LSH forest, then exact verification.

Documents are sets of runs of five words (hashed to 64 bits; a text of one to four words is one run). A document has a
label of ``DEPTH`` min-hashes for each of ``TREES`` trees; a tree is the trie of its labels, whose inner nodes are their
prefixes. Two documents are candidates if they share a prefix in some tree. Matching starts from whole labels, and
prefixes are shortened, for each two sizes of sets, until a pair of these sizes is met with the target recall: sets of n
and m shingles that reach the threshold have a least Jaccard index, often well above the threshold for short texts, and
the depth is the greatest at which such a pair meets in some tree with that probability. So short texts, which share
prefixes by the thousand, stay deep. Tries are held as rows (tree, prefix) and not as sorted arrays in one place: a
prefix of very many documents is counted map-side and split over tasks.

Equal texts are one node, so copies multiply no work. Nodes that share a prefix are linked to the least of them, and
connected components of these links are the candidate groups. In a group of up to 2 * ``BLOCK`` nodes every pair is
verified exactly. In a larger one either every pair whose sizes allow it is, in blocks of size classes, or every pair
that shares a prefix, in blocks of the prefix, whichever sends fewer texts: a chain of many small prefixes costs as many
copies of a text as it has prefixes, a dense family ``FEW`` to m / (``WIDE`` * ``BLOCK``), or m / ``BLOCK`` if its texts
are long. A task gives back a row a node, never a row a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import WORD, Scratch, components
from loomwork.llm.vectors import U, mix, per_row, released, shingles, words

TREES, DEPTH = 20, 8
RECALL = 0.9999
THRESHOLD = 0.8
SIZE = 5
#: Nodes of a candidate group that are compared at a time.
BLOCK = 128
#: Blocks of size classes hold up to ``WIDE`` times ``BLOCK`` nodes, as long as a class has ``FEW`` of them and one holds
#: no more shingles than ``BLOCK`` * ``SPAN``.
WIDE, FEW, SPAN = 8, 16, 3200
_A = (mix(np.arange(1, TREES * DEPTH + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, TREES * DEPTH + 1001, dtype=U)) >> U(32)).astype(np.uint32)


def depth_for(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The greatest depth at which a pair at the threshold is met with the wanted probability; 1 at least."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


@cache
def levels_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, ...]:
    """Lengths of the prefixes under which a set of ``n`` shingles looks for others: one for each size of a partner."""
    per_mille = round(threshold * 1000)
    if n > 400:  # the least index is at most this far above the threshold
        above = min(1.0, threshold + 1.1 * (1 + threshold) ** 2 / (n * (1 + threshold)))
        return tuple(range(depth_for(threshold, recall), depth_for(above, recall) + 1))
    found = set()
    for m in range(-(-n * per_mille // 1000), n * 1000 // per_mille + 1):
        met = -(-per_mille * (n + m) // (1000 + per_mille))  # the fewest in common that reach the threshold
        if met <= min(n, m):
            found.add(depth_for(met / (n + m - met), recall))
    return tuple(sorted(found))


def signatures(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_md5, n_shingles (distinct ones) and keys: the prefixes of all trees (none for a text without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for w in words(batch.column("text"), 1 << 18):
                h, bounds = shingles(w, SIZE)
                own = np.array([len(np.unique(h[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], dtype=np.int64)
                sizes[w.lo : w.hi] = own
                levels = [levels_for(n, threshold, recall) if n else () for n in own.tolist()]
                deepest = np.array([max(x, default=0) for x in levels])
                h32 = (h >> U(32)).astype(np.uint32)
                key = np.tile(np.arange(1, TREES + 1, dtype=U), (len(own), 1))
                live = np.arange(len(own))
                for d in range(DEPTH):
                    deep = deepest[live] > d
                    if not deep.any():
                        break
                    if not deep.all():  # the shingles of those that go on
                        h32 = h32[np.repeat(deep, np.diff(bounds))]
                        bounds = np.concatenate(([0], np.cumsum(np.diff(bounds)[deep])))
                        live = live[deep]
                    for t in range(TREES):
                        low = per_row((h32 ^ _B[t * DEPTH + d]) * _A[t * DEPTH + d], bounds, np.minimum, np.uint32(0))
                        key[live, t] = mix(key[live, t] * U(0x9E3779B97F4A7C15) + low.astype(U))
                    here = np.array([i for i in live.tolist() if d + 1 in levels[i]], dtype=np.int64)
                    owners.append(np.repeat(here + w.lo, TREES))
                    keys.append(mix(key[here] + U(d)).ravel().view(np.int64))
            owner = np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=batch.num_rows)))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys)[order]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_md5"), pa.array(sizes), listed], names=["doc_id", "text_md5", "n_shingles", "keys"])

    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_md5", F.md5(F.col("text").cast("binary")))
    return named.mapInArrow(released(sign), "doc_id long, text_md5 string, n_shingles long, keys array<long>")


def _verify(threshold: float):
    """Within each task, rows (node, other, links): links to documents of other nodes, and a root to join."""

    def compare(held: list[tuple]) -> pa.RecordBatch:
        _, nodes, copies, halves, texts, tied, all_keys = zip(*held, strict=True)
        copies, halves, tied = np.array(copies), np.array(halves), tied[0]
        sets: list[np.ndarray] = []
        for w in words(pa.array(texts, pa.large_string())):
            h, bounds = shingles(w, SIZE)
            sets += [np.unique(h[bounds[i] : bounds[i + 1]]) for i in range(w.hi - w.lo)]
        n = np.array([len(s) for s in sets])
        m = len(sets)
        owner = np.repeat(np.arange(m), n)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        new = np.concatenate(([True], every[1:] != every[:-1]))
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1  # a shingle of one node only meets nothing
        group, owner = group[many], owner[many]
        _, group = np.unique(group, return_inverse=True)
        same = not halves.any()
        one, two = (slice(None), slice(None)) if same else (np.flatnonzero(halves == 1), np.flatnonzero(halves == 2))
        met = np.zeros((len(n[one]), len(n[two])), dtype=np.float32)
        rows = group.max() + 1 if len(group) else 0
        width = max(1, 8_000_000 // max(1, m))
        for lo in range(0, rows, width):
            a, b = np.searchsorted(group, [lo, lo + width])
            has = np.zeros((min(width, rows - lo), m), dtype=np.float32)
            has[group[a:b] - lo, owner[a:b]] = 1
            met += has[:, one].T @ has[:, two]
        met = met.astype(np.int64)
        union = n[one][:, None] + n[two][None, :] - met
        # Jaccard >= threshold, in whole thousandths so that the edge is exact.
        linked = (met * 1000 >= round(threshold * 1000) * union) & (met > 0)
        if same:
            np.fill_diagonal(linked, False)
        place = np.arange(m)
        if tied is not None:  # a pair counts under the least prefix that it shares
            own_keys = [frozenset(x) for x in all_keys]
            left, right = place[one].tolist(), place[two].tolist()
            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked) if same else linked)), strict=True):
                if min(own_keys[left[i]] & own_keys[right[j]]) != tied:
                    linked[i, j] = False
                    if same:
                        linked[j, i] = False
        links = np.zeros(m, dtype=np.int64)
        links[one] = linked @ copies[two]
        if not same:
            links[two] = copies[one] @ linked
        root = place.copy()
        left, right = place[one], place[two]
        fresh = links > 0
        for i in np.flatnonzero(fresh).tolist():  # a component from its least node, all neighbours of a step at once
            reached = np.zeros(m, dtype=bool)
            reached[i] = fresh[i]
            while reached.any():
                fresh &= ~reached
                root[reached] = i
                near = np.zeros(m, dtype=bool)
                near[right] = linked[reached[left]].any(axis=0)
                if not same:
                    near[left] = linked[:, reached[right]].any(axis=1)
                reached = near & fresh
        own = [i for i in range(m) if links[i]]
        return pa.RecordBatch.from_arrays([
            pa.array([nodes[i] for i in own], pa.string()), pa.array([nodes[root[i]] for i in own], pa.string()), pa.array([int(links[i]) for i in own], pa.int64()),
        ], names=["node", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = tuple(column[k].as_py() for column in batch.columns)
                if held and held[0][0] != row[0]:
                    if len(held) > 1:
                        yield compare(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield compare(held)

    return run


def dealt_tasks(nodes: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """task, node, copies, half, tied and keys: which nodes are compared where.

    ``half`` 0 meets all others of its task, otherwise 1 meets 2 only. ``tied`` is the prefix by which the nodes of a
    task were dealt, with all ``keys`` of each, so that a pair with several prefixes in common counts once; it is null
    in tasks that see a pair only once anyway.
    """
    prefixes = nodes.select("short", F.explode("keys").alias("key"))
    # Sums are written before they are joined: Spark splits a hot key's rows only between plain tables.
    shared = scratch.put(prefixes.groupBy("key").agg(F.min("short").alias("least"), F.count("*").alias("c")).where("c > 1"))
    star = prefixes.join(shared, "key").where("short <> least").select(F.col("short").alias("u"), F.col("least").alias("v"))
    groups = components(star, scratch)
    inside = nodes.select("node", "short", "copies", "n", "keys").join(groups.select(F.col("node").alias("short"), F.col("root").alias("grp")), "short")
    # Size classes: sizes at the threshold differ by less than one class.
    inside = scratch.put(inside.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) * (1 - 1e-9)).cast("int")))
    whole = inside.groupBy("grp").agg(F.count("*").alias("all"))
    large = scratch.put(whole.where(F.col("all") > 2 * BLOCK).select("grp"))
    none = [F.lit(None).cast("long").alias("tied"), F.lit(None).cast("array<long>").alias("keys")]
    tasks = inside.join(large, "grp", "left_anti").select(F.col("grp").cast("string").alias("task"), "node", "copies", F.lit(0).alias("half"), *none)
    if large.isEmpty():
        return tasks

    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))

    def same(name) -> Column:
        """The blocks that block i of k meets, itself included."""
        return F.transform(upto("k"), lambda j: F.struct(
            name(F.least("i", j), F.greatest("i", j)).alias("task"), F.when(j == F.col("i"), 0).when(j > F.col("i"), 1).otherwise(2).alias("half")))

    sizes = inside.join(large, "grp", "left_semi").groupBy("grp", "cls").agg(F.count("*").alias("m"))
    times = F.greatest(F.lit(1), F.least(F.lit(WIDE), F.floor(F.col("m") / (BLOCK * FEW)), F.floor(SPAN * F.pow(F.lit(threshold), F.col("cls") + 1))))
    blocks = scratch.put(sizes.select(
        "grp", "cls", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("narrow"), F.ceil(F.col("m") / (BLOCK * times)).cast("int").alias("k")))
    # Texts to send by size classes, and by prefixes, in blocks of one size.
    members = scratch.put(inside.join(large, "grp", "left_semi"))
    beside = [blocks.select("grp", (F.col("cls") + by).alias("cls"), F.col("narrow").alias(name)) for by, name in ((-1, "n_above"), (1, "n_below"))]
    counted = blocks.join(beside[0], ["grp", "cls"], "left").join(beside[1], ["grp", "cls"], "left").na.fill(0, ["n_above", "n_below"])
    by_class = counted.groupBy("grp").agg(F.sum(F.col("m") * (F.col("narrow") + F.col("n_above") + F.col("n_below"))).alias("by_class"))
    above = blocks.select("grp", (F.col("cls") - 1).alias("cls"), F.col("k").alias("k_above"))
    below = blocks.select("grp", (F.col("cls") + 1).alias("cls"), F.col("k").alias("k_below"))
    blocks = scratch.put(blocks.join(above, ["grp", "cls"], "left").join(below, ["grp", "cls"], "left").na.fill(0, ["k_above", "k_below"]))
    of_group = members.select("grp", F.col("short").alias("least")).join(shared, "least")  # each prefix lies in one group
    by_key = of_group.groupBy("grp").agg(F.sum(F.col("c") * F.ceil(F.col("c") / BLOCK)).alias("by_key"))
    chained = scratch.put(by_class.join(by_key, "grp").where("by_key < by_class").select("grp"))

    mine = members.join(chained, "grp", "left_anti").join(blocks, ["grp", "cls"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    name = lambda c1, i, c2, j: F.concat_ws("/", "grp", c1, i, c2, j)
    one, up, down = F.col("cls"), F.col("cls") + 1, F.col("cls") - 1
    higher = F.transform(upto("k_above"), lambda j: F.struct(name(one, F.col("i"), up, j).alias("task"), F.lit(1).alias("half")))
    lower = F.transform(upto("k_below"), lambda j: F.struct(name(down, j, one, F.col("i")).alias("task"), F.lit(2).alias("half")))
    dealt = mine.select("node", "copies", F.explode(F.concat(same(lambda i, j: name(one, i, one, j)), higher, lower)).alias("t"))
    tasks = tasks.unionByName(dealt.select("t.task", "node", "copies", "t.half", *none))

    held = members.join(chained, "grp", "left_semi")
    under = held.select("node", "copies", "keys", F.explode("keys").alias("tied")).join(shared.select(F.col("key").alias("tied"), "c"), "tied")
    under = under.withColumn("k", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = under.select("node", "copies", "tied", "keys", F.explode(same(lambda i, j: F.concat_ws("/", F.lit("by"), "tied", i, j))).alias("t"))
    return tasks.unionByName(dealt.select("t.task", "node", "copies", "t.half", "tied", "keys"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_md5, root, class_id and n_links of every row, repeated ones too.

    Two rows are linked if their texts are equal or the Jaccard index of their shingle sets reaches the
    threshold; ``n_links`` counts the rows that a row is linked to. ``class_id`` is the least doc_id of the
    connected component, ``root`` names it also where ids repeat (null for a class of its own). A text without words
    (and null) has no shingles: it links to nothing, not even to its copies, and is a class of its own. Null ids count
    as links and have the class of their text. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    signed = scratch.put(signatures(docs, threshold, recall))
    nodes = signed.where("n_shingles > 0").groupBy(F.col("text_md5").alias("node")).agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    short = F.conv(F.substring("node", 1, 15), 16, 10).cast("long")  # joins candidates only, so a clash costs a comparison
    nodes = scratch.put(nodes.withColumn("short", short))

    tasks = scratch.put(dealt_tasks(nodes, scratch, threshold))

    # Texts of the nodes, one row of each, then of the tasks.
    firsts = nodes.select("node", F.col("first").alias("doc_id"))
    chosen = tasks.select("node").distinct().join(firsts, "node")
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = text.join(chosen, text["doc_id"].eqNullSafe(chosen["doc_id"])).where(F.md5(F.col("text").cast("binary")) == F.col("node"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ready = tasks.join(texts.select("node", "text").dropDuplicates(["node"]), "node").select("task", "node", "copies", "half", "text", "tied", "keys")
    ready = ready.repartition(parts, "task").sortWithinPartitions("task", "node")
    found = scratch.put(ready.mapInArrow(released(_verify(threshold)), "node string, other string, links long"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")), scratch)
    named = nodes.select("node", "first", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = scratch.put(named.groupBy("root").agg(F.min("first").alias("class_id")))
    classes = named.join(least, "root").join(links, "node", "left").select(
        F.col("node").alias("text_md5"), "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "text_md5", "n_shingles").join(scratch.put(classes), "text_md5", "left")
    return out.select(
        "doc_id", "text_md5", "root", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` of each class: the least doc_id (null last), then text. Rows without words all stay."""
    scratch = Scratch(docs.sparkSession)
    classes = scratch.put(near_duplicates(docs, threshold))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5"))
    kept = classes.where("root IS NOT NULL").groupBy("root").agg(F.min(key).alias("k")).select("k.__id", "k.__md5")
    kept = scratch.put(kept.unionByName(classes.where("root IS NULL").select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5"))).distinct())
    mine = docs.withColumn("__m", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    mine = mine.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__md5")), "left_semi").drop("__m")
    repeated = classes.where("root IS NOT NULL").groupBy("doc_id", "text_md5").count().where("count > 1")
    if not repeated.isEmpty():  # equal rows cannot be told apart
        words = F.col("text").rlike(WORD)
        mine = mine.where(words).dropDuplicates(["doc_id", "text"]).unionByName(mine.where(~words | F.col("text").isNull()))
    return mine
