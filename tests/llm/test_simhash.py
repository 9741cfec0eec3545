import random

import xxhash
from pyspark.sql import functions as F

from roadpulse.llm import simhash as sh
from roadpulse.llm.common import components


def plain_fingerprint(text):
    words, word = [], b""
    for byte in (text or "").encode():
        if byte in b" \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), b""
        else:
            word += bytes([byte + 32 if 65 <= byte <= 90 else byte])
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, distance=2):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(rows))]


def test_query_equals_brute_force(spark, sf):
    from roadpulse.llm.queries import REGISTRY
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {k: (f"{f:016x}", c) for (k, f), c in zip(rows, plain_groups(rows))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in REGISTRY["op7_simhash_near_dedup"](spark, sf).collect()}
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in odd_docs.collect()]
    want = sorted((str(k), f"{f:016x}", str(c)) for (k, f), c in zip(rows, plain_groups(rows)))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in sh.near_duplicates(odd_docs).collect())
    assert got == want
    assert sh.near_duplicates(no_docs).count() == 0


def test_links_equal_brute_force_in_dense_families(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    prints = sorted(prints)
    for distance in (0, 1, 2, 3):
        signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
        got = {(r.a, r.b) for r in sh.links(spark.createDataFrame(signed, "fp long"), distance).collect()}
        flat = sorted(x for x, in signed)
        want = {(a, b) for i, a in enumerate(flat) for b in flat[i + 1:]
                if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
        assert got == want


def test_components_of_path_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(50, 51), (51, 52), (52, 50), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 40)} | {i: 50 for i in range(50, 53)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long").select(F.col("a"), "b")).count() == 0


def test_keep_one_keeps_every_group_when_texts_share_an_id(spark):
    one, two, three = ("alpha beta gamma delta", "one two three four five", "red green blue black white")
    rows = [(1, one), (1, two), (2, one), (3, two), (5, three), (5, "lone text without any company here"), (4, three), (None, three)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in sh.keep_one(frame).collect())
    assert got == sorted([(1, one), (1, two), (4, three), (5, rows[5][1])])
