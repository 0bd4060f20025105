"""Operator 10, sharding: balanced label propagation with DataFrame operations only.

Documents with equal texts are linked through one hub a text, so a group of n copies has n links and
not n * n pairs. Each round joins the documents with the votes of their hub and moves whole hubs to
the shard that holds most of their documents, among those whose quota of rows still takes the hub, or to one
of these by hash if it holds none. Rounds go on until every hub has a place or fits nowhere: in each the
first hub of every shard that is wished for moves. Documents without links, and hubs that fit nowhere, fill
what is left, hubs first and each in one run, so that counts end at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import Scratch, prefix_sum, slice_of

#: Rows that a slice of a prefix sum should hold.
SLICE_ROWS = 1024


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    A null text counts as empty. Rows are told apart even if they repeat; a null doc_id is kept.
    An empty table gives no rows. Other columns are ignored. A group of copies larger than a shard's
    quota is cut into as many hubs as it needs shards.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put(_rows(docs))
    total = rows.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    linked = scratch.put(_links(rows, max(1, total // n_shards), n_shards, scratch))
    hubs = scratch.put(linked.groupBy("hub").agg(F.count("*").alias("w")))
    n_hubs = hubs.count()

    # Rounds: votes, moves under quotas.
    settled: DataFrame | None = None
    load = [0] * n_shards
    open_hubs, turn = hubs, 0
    while n_hubs:
        free = F.array(*(F.lit(quota[s] - load[s]).cast("long") for s in range(n_shards)))
        votes = linked.groupBy("hub", "shard").count().join(open_hubs, "hub").where(F.get(free, F.col("shard")) >= F.col("w"))
        best = votes.groupBy("hub").agg(F.max(F.struct("count", (-F.col("shard")).alias("s"))).alias("b"))
        roomy = F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.get(free, s) >= F.col("w"))
        any_one = F.get(roomy, F.pmod(F.xxhash64("hub", F.lit(turn)), F.size(roomy)).cast("int"))
        wish = open_hubs.where(F.size(roomy) > 0).join(best, "hub", "left")
        wish = wish.select("hub", "w", F.coalesce((-F.col("b.s")).cast("int"), any_one).alias("shard"))
        n_slices = max(1, n_hubs // (n_shards * SLICE_ROWS))
        # Large hubs first: size classes, then slices of the hash.
        klass = F.lit(63) - F.floor(F.log2(F.col("w")))
        wish = wish.withColumn("piece", klass * n_slices + slice_of(F.xxhash64("hub"), n_slices))
        ranked = prefix_sum(wish, ["shard"], "piece", [F.col("w").desc(), F.col("hub")], F.col("w"), "ahead")
        moved = scratch.put(ranked.where(F.col("ahead") + F.col("w") <= F.get(free, F.col("shard"))).select("hub", "w", "shard"))
        gained = moved.groupBy("shard").agg(F.sum("w").alias("w")).collect()  # a row a shard
        for r in gained:
            load[r["shard"]] += r["w"]
        settled = moved if settled is None else settled.unionByName(moved)
        if not gained:
            break
        open_hubs = scratch.put(open_hubs.join(moved, "hub", "left_anti"))
        n_hubs = open_hubs.count()
        turn += 1

    label = rows.join(linked.select("rid", "hub"), "rid", "left")
    if settled is not None:
        label = label.join(settled.select("hub", F.col("shard").alias("home")), "hub", "left")
    else:
        label = label.withColumn("home", F.lit(None).cast("int"))
    label = scratch.put(label)

    # What is left fills the shards up to their quotas, in the order of hubs, then single documents.
    rest = label.where("home IS NULL")
    n_slices = max(1, total // SLICE_ROWS)
    key = F.coalesce(F.col("hub"), F.xxhash64("rid"))
    rest = rest.select("rid", "doc_id", "size", "text_crc32", "hub", F.lit(0).alias("all"), key.alias("key"))
    rest = rest.withColumn("piece", slice_of(F.col("key"), n_slices) + F.when(F.col("hub").isNull(), n_slices).otherwise(0))
    # A large hub without a place would be one piece: cut it by the row.
    fine = F.when(F.col("hub").isNull(), 0).otherwise(F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(64)))
    rest = rest.withColumn("piece", F.col("piece") * 64 + fine)
    ranked = prefix_sum(rest, ["all"], "piece", [F.col("key"), F.col("rid")], F.lit(1), "rank")
    ends, at = [], 0
    for s in range(n_shards):
        at += quota[s] - load[s]
        ends.append(at)
    ends = F.array(*(F.lit(e).cast("long") for e in ends))
    filled = ranked.select("rid", "doc_id", "size", "text_crc32", F.size(F.filter(ends, lambda e: e <= F.col("rank"))).alias("shard"))
    home = label.where("home IS NOT NULL").select("rid", "doc_id", "size", "text_crc32", F.col("home").alias("shard"))
    placed = scratch.put(filled.unionByName(home))

    n_slices = max(1, total // (n_shards * SLICE_ROWS))
    placed = placed.withColumn("piece", slice_of(F.xxhash64("rid"), n_slices))
    slots = prefix_sum(placed, ["shard"], "piece", [F.xxhash64("rid"), F.col("rid")], F.lit(1), "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def _rows(docs: DataFrame) -> DataFrame:
    """rid, doc_id, size, text_crc32 and grp (the text's digest) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("grp"),
    )


def _links(rows: DataFrame, room: int, n_shards: int, scratch: Scratch) -> DataFrame:
    """rid, hub and first shard of the rows whose text occurs twice or more; groups larger than ``room`` have several hubs."""
    sizes = scratch.put(rows.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"))
    pieces = F.when(F.col("n") > room, F.ceil(F.col("n") * 1.25 / room)).otherwise(1)
    return rows.select("rid", "grp").join(sizes, "grp").select(
        "rid",
        F.xxhash64("grp", F.pmod(F.xxhash64("rid", F.lit(7)), pieces)).alias("hub"),
        F.pmod(F.xxhash64("rid"), F.lit(n_shards)).cast("int").alias("shard"),
    )
