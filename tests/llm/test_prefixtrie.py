"""The trie against a plain dictionary of prefixes, for one shard and many."""

import hashlib
import math
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from roadpulse.llm import prefixtrie as pt


def plain(rows):
    """The contract's nodes from (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            own[c].append(((t is not None, t or 0, r, digest), (r, x)))
    own = {c: [turn for _, turn in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest())
                   for k, m in members.items()), key=repr)


def made(spark, rows):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, path string, depth long")
    c = F.col("conv_id")
    return pt.rebuilt(pt.turns(df), c - c % 100, (F.crc32(c.cast("string").cast("binary")) % 6).cast("int"), 5)


ODD = [(None, 1, "u", "x"), (1000, None, None, None), (1000, None, "a", "b"), (1000, 3, None, ""), (-5, 0, "q", "é" * 5),
       (-105, 0, "q", "é" * 5), (2000, 1, "u", "z"), (2000, 1, "u", "z"), (2001, 5, "u", "w" * 100_000)]


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("shards", [1, 3, 48])
def test_trie_equals_dictionary_with_a_hot_conversation(spark, partitions, shards):
    partitions(shards)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"same {t}" if c % 3 else f"t{c % 7} {t}")
            for c in range(250) for t in range(1 + c % 4)] + ODD
    assert sorted(map(tuple, pt.trie(made(spark, rows)).collect()), key=repr) == plain(rows)


def test_whole_table_with_clashing_columns(spark, sf, partitions):
    partitions(12)
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, pt.op11_prefix_trie(spark, sf).collect()), key=repr) == plain(map(tuple, rows))


def test_long_conversation_and_copies_across_shards(spark, partitions):
    partitions(4)
    path = b"".join(hashlib.sha256(str(i).encode()).digest()[:16] for i in range(3000))
    rows = spark.createDataFrame([(c, bytearray(path), [1] * 3000) for c in range(7)], "conv_id long, path binary, lens array<int>")
    got = pt.trie(rows).collect()
    assert len(got) == 3001 and {r["n_convs"] for r in got} == {7} and {r["n_leaves"] for r in got} == {1}
    assert max(r["saved_tokens"] for r in got) == 6 * 3000
    last = [r for r in got if r["depth"] == 3000][0]
    assert last["ends_sha256"] == hashlib.sha256(b"0,1,2,3,4,5,6").hexdigest()


def test_many_ids_end_at_one_node(spark, partitions):
    partitions(5)
    rows = spark.range(20_000).select(F.col("id").alias("conv_id"), F.lit(b"a" * 16).alias("path"), F.array(F.lit(2)).alias("lens"))
    got = {r["depth"]: r for r in pt.trie(rows, shard_turns=3000).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest()
    assert got[0]["saved_tokens"] == 2 * 19_999 and got[0]["n_convs"] == 20_000


def test_empty_table(spark):
    assert pt.trie(made(spark, [(None, 1, "u", "x")])).collect() == []
