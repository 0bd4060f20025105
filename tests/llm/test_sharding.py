import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from loomwork.llm import sharding
from loomwork.llm.common import Scratch
from loomwork.llm.sharding import shard_documents
from tests.llm.helpers import documents, empty, frame, odd, odd_rows, texts


def whole(rows, n_shards, n):
    count = Counter(r.shard for r in rows)
    assert len(rows) == n and set(count) <= set(range(n_shards))
    sizes = [count[s] for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)


def test_counts_slots_and_groups(spark):
    out = shard_documents(documents(spark)).collect()
    real = texts(spark)
    whole(out, 40, len(real))
    for r in out:
        raw = (real[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, crc32(raw))
    at = defaultdict(set)
    for r in out:
        at[real[r.doc_id]].add(r.shard)
    assert sum(len(s) - 1 for s in at.values()) <= 4


def test_groups_larger_than_a_shard(spark):
    rows = [(i, "hot") for i in range(300)] + [(1000 + i, f"pair {i // 2}") for i in range(200)] + [(5000 + i, f"one {i}") for i in range(500)]
    out = shard_documents(frame(spark, rows), n_shards=10).collect()
    whole(out, 10, 1000)
    at = defaultdict(set)
    text = dict(rows)
    for r in out:
        at[text[r.doc_id]].add(r.shard)
    assert len(at["hot"]) <= 6
    assert sum(len(s) > 1 for t, s in at.items() if t != "hot") <= 5


def placed_by_hand(spark, df, n_shards):
    """Shards of all rows by the rules of the method, one hub after the other; hashes are Spark's."""
    scratch = Scratch(spark)
    rows = scratch.put(sharding._rows(df))
    total = rows.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    linked = scratch.put(sharding._links(rows, max(1, total // n_shards), n_shards, scratch))
    votes, members, hub_of = defaultdict(Counter), defaultdict(list), {}
    for r in linked.collect():
        votes[r.hub][r.shard] += 1
        members[r.hub].append(r.rid)
        hub_of[r.rid] = r.hub
    load, home, open_hubs, turn = [0] * n_shards, {}, set(members), 0
    while open_hubs:
        free = [q - n for q, n in zip(quota, load, strict=True)]
        hashed = {r.hub: (r.a, r.b) for r in spark.createDataFrame([(h,) for h in open_hubs], "hub long").select(
            "hub", F.xxhash64("hub", F.lit(turn)).alias("a"), F.xxhash64("hub").alias("b")).collect()}
        wishes = defaultdict(list)
        for h in open_hubs:
            w = len(members[h])
            roomy = [s for s in range(n_shards) if free[s] >= w]
            fits = [(n, -s) for s, n in votes[h].items() if free[s] >= w]
            if roomy:
                wishes[-max(fits)[1] if fits else roomy[hashed[h][0] % len(roomy)]].append(h)
        slices = max(1, len(open_hubs) // (n_shards * sharding.SLICE_ROWS))
        moved = set()
        for s, some in wishes.items():
            ahead = 0
            for h in sorted(some, key=lambda h: (63 - len(bin(len(members[h]))) + 3, ((hashed[h][1] % (1 << 64)) >> 33) * slices >> 31, -len(members[h]), h)):
                if ahead + len(members[h]) <= free[s]:
                    home[h] = s
                    moved.add(h)
                ahead += len(members[h])
        for h in moved:
            load[home[h]] += len(members[h])
        open_hubs -= moved
        turn += 1
        if not moved:
            break
    out = {r: home[h] for h, some in members.items() if h in home for r in some}
    keys = {r.rid: (r.k, r.f) for r in rows.select("rid", F.xxhash64("rid").alias("k"), F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(64)).alias("f")).collect()}
    slices = max(1, total // sharding.SLICE_ROWS)

    def place(rid):
        h = hub_of.get(rid)
        key = keys[rid][0] if h is None else h
        piece = (((key % (1 << 64)) >> 33) * slices >> 31) + (slices if h is None else 0)
        return piece * 64 + (0 if h is None else keys[rid][1]), key, rid

    rest = sorted((r for r in keys if r not in out), key=place)
    at = [s for s in range(n_shards) for _ in range(quota[s] - load[s])]
    return out | dict(zip(rest, at, strict=True)), {r.rid: (r.doc_id, r.grp) for r in rows.collect()}


@pytest.mark.parametrize("n_shards", [7, 40])
def test_placement_by_hand(spark, n_shards):
    rng = random.Random(n_shards)
    made = [(i, f"text {rng.randrange(60)}" if i % 3 else f"own {i}") for i in range(900)] + [(2000 + i, "hot") for i in range(300)]
    df = frame(spark, made).coalesce(1)
    want, names = placed_by_hand(spark, df, n_shards)
    got = shard_documents(df, n_shards).collect()
    assert {r.doc_id: r.shard for r in got} == {names[rid][0]: s for rid, s in want.items()}


def test_all_equal(spark):
    whole(shard_documents(frame(spark, [(i, "same") for i in range(95)])).collect(), 40, 95)


def test_odd_and_empty_tables(spark):
    whole(shard_documents(odd(spark)).collect(), 40, len(odd_rows()))
    assert shard_documents(empty(spark)).count() == 0
