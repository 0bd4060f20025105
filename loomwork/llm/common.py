"""Shared pieces: tables in the shared folder, distributed prefix sums, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.vectors import release_memory

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables written to the folder in spark.checkpoint.dir, which cut a plan's lineage.

    They outlive the loss of executors. ``drop`` frees one early, ``free_since`` what was made after a ``mark``, once
    the results that read it are written; the rest goes when the driver ends. Only in local mode may the setting be
    missing; a temporary folder serves then.
    """

    _made: list[Scratch] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._made.append(self)
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.partition("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="loomwork-")
        self.root = f"{root.rstrip('/')}/loomwork-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def put(self, df: DataFrame) -> DataFrame:
        """Write the rows now and read them back."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._scratch)

    @classmethod
    def mark(cls) -> int:
        return len(cls._made)

    @classmethod
    def free_since(cls, mark: int) -> None:
        """Delete the tables of all folders made since the mark."""
        for one in cls._made[mark:]:
            one._clear()
        del cls._made[mark:]

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended
            return


#: Spark's bound on the bytes of a batch that a Python worker gets; without it, batches have 10,000 rows of any size.
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame, most: int) -> DataFrame:
    """The same rows, in a clone of the session whose Python workers get about ``most`` bytes at a time, one row at least.

    The setting holds when a plan runs, so it can't be lifted again in the caller's session before that. A lower one
    of the caller stays.
    """
    spark = df.sparkSession
    clone = spark._jsparkSession.cloneSession()
    own = int(spark.conf.get(BATCH_KEY, None) or 0)
    clone.conf().set(BATCH_KEY, str(min(own, most) if own > 0 else most))
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(clone, plan), SparkSession(spark.sparkContext, clone))


def slice_of(hash64: Column, n: int) -> Column:
    """0 to n-1, in the order of the upper 31 bits of a non-negative or negative 64-bit hash."""
    high = F.shiftrightunsigned(hash64, 33)
    return F.shiftright(high * F.lit(n).cast("long"), 31).cast("long")


#: Pieces of a part that are summed to one before the parts' own running sums.
PIECES = 1024


def prefix_sum(df: DataFrame, part: list[str], piece: str, order: list[Column], weight: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same ``part`` that come before.

    Rows are ordered by ``piece``, then ``order``. Sums a (part, piece) come first, then sums of ``PIECES`` pieces, so
    a task holds one piece, or so many pieces, or one row in so many pieces of a part. Key columns must not be null.
    """
    weighted = df.withColumn("__w", weight.cast("long"))
    sums = weighted.groupBy(*part, piece).agg(F.sum("__w").alias("__s")).withColumn("__p", F.expr(f"{piece} div {PIECES}"))
    past = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda keys, by: F.coalesce(F.sum("__s").over(past(keys, by)), F.lit(0))
    large = sums.groupBy(*part, "__p").agg(F.sum("__s").alias("__s")).select(*part, "__p", before(part, "__p").alias("__l"))
    small = sums.select(*part, "__p", piece, before([*part, "__p"], piece).alias("__m"))
    sums = small.join(large, [*part, "__p"]).select(*part, piece, (F.col("__l") + F.col("__m")).alias("__b"))
    inside = Window.partitionBy(*part, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = weighted.join(sums, [*part, piece])
    return joined.withColumn(out, F.col("__b") + F.coalesce(F.sum("__w").over(inside), F.lit(0))).drop("__b", "__w")


#: Edges that a task holds before it merges them.
EDGES = 1 << 20


def _merged(edges: pa.Table) -> pa.RecordBatch:
    """Rows (u, v, home): every node with the least node of its component in these edges, least ones themselves left out.

    Nodes that stand as ``u`` in a row of ``home`` keep that mark, and keep a row even if they are the least.
    """
    both = pa.chunked_array(edges.column("u").chunks + edges.column("v").chunks).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(both.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ends = rank[both.indices.to_numpy()]
    a, b = ends[: len(edges)], ends[len(edges) :]
    home = np.zeros(len(order), dtype=bool)
    home[a[edges.column("home").to_numpy()]] = True
    least = np.arange(len(order))
    while True:
        one, two = least[a], least[b]
        live = one != two
        if not live.any():
            break
        a, b, one, two = a[live], b[live], one[live], two[live]
        np.minimum.at(least, np.maximum(one, two), np.minimum(one, two))
        while (least[least] != least).any():
            least = least[least]
    kept = np.flatnonzero(home | (least != np.arange(len(order))))
    nodes = both.dictionary.take(order)
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(kept)), nodes.take(pa.array(least[kept])), pa.array(home[kept])], names=["u", "v", "home"])


def _merge(whole: bool):
    """Merge the edges of a task: all of them, with ``home`` at the nodes that came as ``u``, or ``EDGES`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, rows, most = [], [], 0, 0
        for batch in batches:
            mark = pa.array(np.full(batch.num_rows, whole))
            held.append(pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), mark], names=["u", "v", "home"]))
            rows += batch.num_rows
            most = max(most, rows)
            if rows >= max([EDGES, *(x.num_rows for x in done)]):
                done, held, rows = [_merged(pa.Table.from_batches(done + held))], [], 0
                if not whole:
                    yield done.pop()
        if held:
            done = [_merged(pa.Table.from_batches(done + held))]
        yield from done
        if most >= EDGES >> 2:
            release_memory()

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node on an edge (u, v), once: the least node of its connected component.

    First, tasks merge the edges that they happen to hold. Then the edges meet by the larger node, which gets one row, at
    ``home``, with the least node that it reaches there, and smaller ends that it has joined get rows for their own homes:
    a node has one row a task at most. A round takes each edge on from its smaller end to the node of that one's own row,
    and lets them meet again: a large and a small star in one job, whose edges are written before the next. Both sides of
    its join are plain tables, so Spark can split a node with very many edges. It ends when no smaller end has a row.
    """
    kind = edges.schema["u"].dataType.simpleString()
    schema = f"u {kind}, v {kind}, home boolean"

    def met(e: DataFrame) -> DataFrame:
        return scratch.put(e.select("u", "v").repartition("u").mapInArrow(_merge(True), schema))

    now = met(edges.where("u <> v").select("u", "v").mapInArrow(_merge(False), schema))
    while True:
        if now.where("NOT home").isEmpty():
            roots = scratch.put(now.select("v").distinct())
            if roots.join(now.select("u"), F.col("v") == F.col("u"), "left_semi").isEmpty():
                break
            scratch.drop(roots)
        up = now.where("home").select(F.col("u").alias("w"), F.col("v").alias("up"))
        after = met(now.join(up, F.col("v") == F.col("w"), "left").select("u", F.coalesce("up", "v").alias("v")))
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
