import random
import zlib

import xxhash
from pyspark.sql import functions as F

from roadpulse.llm import sharding as sd


def least_capacity(sizes, shards):
    low, high = 0, sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > middle:
                used = shards + 1
                break
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def check(docs, rows, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(k), size(t), zlib.crc32((t or "").encode())) for k, t in docs)
    groups = {}
    for _, t in docs:
        groups[t or ""] = groups.get(t or "", 0) + size(t)
    order = sorted(groups, key=lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest())
    loads = {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert max(loads.values()) == least_capacity([groups[t] for t in order], shards)
    for s in loads:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert set(loads) <= set(range(shards))
    where = {}
    for r in rows:
        where.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_query_is_minimax(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(docs, sd.op5_sharding(spark, sf).collect(), 16)


def test_odd_rows(odd_docs, no_docs):
    check([(r.doc_id, r.text) for r in odd_docs.collect()], sd.shard(odd_docs, 3).collect(), 3)
    assert sd.shard(no_docs, 16).count() == 0


def test_refined_cuts_equal_greedy_over_all_groups(spark):
    for seed in range(4):
        rng = random.Random(seed)
        groups = sorted((format(rng.getrandbits(64), "064b") + f"{i:064x}", rng.choice([1, 3, 50, rng.randint(1, 900)]))
                        for i in range(400))
        frame = spark.createDataFrame(groups, "key string, size long").coalesce(1).persist()
        for shards in (1, 5, 16):
            ends = sd.cut_points(frame, shards, first_bits=3, bits=2)
            loads = [0] * shards
            for key, size in groups:
                loads[sum(key > e for e in ends)] += size
            assert max(loads) == least_capacity([s for _, s in groups], shards)
        frame.unpersist()


def test_hash_order_is_that_of_the_bits(spark):
    row = spark.sql("select 'abc' t").select(F.lpad(F.bin(F.xxhash64("t")), 64, "0").alias("b")).first()
    assert int(row.b, 2) == xxhash.xxh64(b"abc", seed=42).intdigest()
