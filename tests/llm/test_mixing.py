"""The mix against a plain queue simulation with fractions."""

import heapq
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from roadpulse.llm import mixing
from roadpulse.llm.common import stored


def plain_targets(words, weights=(1, 2, 3), repeats=3, share=1):
    """{source: target} by sharing excess again until no source is above its bound."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, fixed = int(Fraction(share) * sum(words.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = budget - sum(fixed.values())
        level = Fraction(left, sum(weight[s] for s in free)) if free else 0
        over = [s for s in free if weight[s] * level >= repeats * words[s]]
        if not over:
            return {s: Fraction(fixed[s]) if s in fixed else weight[s] * level for s in order}
        fixed |= {s: repeats * words[s] for s in over}


DOCS = ([(i, "w " * (i % 9), "big", "z") for i in range(300)] + [(i, "a b c", "", "z") for i in range(300, 310)]
        + [(400, None, None, "z"), (401, " \t\n", None, "z"), (402, "x" * 50_000, None, None), (None, "one two", "é", "z"),
           (403, "y " * 5000, "long", "z"), (404, "y", "long", "z"), (404, "y", "long", "z"), (405, "\x00a\x85b c", "\U0001f600", "z")])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string, size string")


@pytest.mark.parametrize("share", [1, Fraction(1, 3), Fraction(14, 5)])
def test_targets_and_words_taken(docs, share):
    rows = mixing.mix(docs, share=share).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in DOCS]
    words = defaultdict(int)
    for (_, _, s, _), n in zip(DOCS, size):
        words[s] += n
    want = plain_targets(words, share=share)
    assert len(rows) == len(DOCS) and sorted(r["size"] for r in rows) == sorted(size)
    of = {sum(1 for d in DOCS if d[2] == s): s for s in words}
    taken, target = defaultdict(int), {}
    by_id = {d[0]: d[2] for d in DOCS}
    for r in rows:
        s = by_id[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["source_size"] == words[s] and r["taken"] <= 3 * r["size"]
    for s in words:
        assert target[s] == pytest.approx(float(want[s])) and abs(taken[s] - want[s]) < 1 + 1e-9
    assert sum(taken.values()) == int(Fraction(share) * sum(size)) and of


def test_order_is_that_of_a_fair_queue(docs):
    sized = stored(docs.select(F.col("doc_id").alias("id"), "source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
                               .cast("long").alias("size")).withColumn("_k", F.monotonically_increasing_id()), "t")
    sources = mixing.targets(sized).withColumnRenamed("source", "of")
    got = mixing.schedule(sized, sources).orderBy("offset").collect()
    rank_of = {r["rank"]: r for r in sources.collect()}
    # each source's own queue, then the queues merged by finish time
    queue, sizes = defaultdict(list), {r["_k"]: r["size"] for r in sized.collect()}
    for r in sorted(got, key=lambda r: (r["rank"], r["offset"])):
        queue[r["rank"]].append(r["_k"])
    heap, served = [], defaultdict(int)
    for rank, ks in queue.items():
        heapq.heappush(heap, (Fraction(min(sizes[ks[0]], rank_of[rank]["quota"])) / Fraction(rank_of[rank]["target"]), rank, 0))
    offset = 0
    for r in got:
        finish, rank, i = heapq.heappop(heap)
        assert (rank, queue[rank][i]) == (r["rank"], r["_k"]) and r["offset"] == offset
        served[rank] += r["words"]
        offset += r["words"]
        if i + 1 < len(queue[rank]):
            now = min(served[rank] + sizes[queue[rank][i + 1]], rank_of[rank]["quota"])
            heapq.heappush(heap, (min(Fraction(1), Fraction(now) / Fraction(rank_of[rank]["target"])), rank, i + 1))
    assert offset == sum(sizes.values())
    for rank, ks in queue.items():  # each pass takes every document with words once, in one order
        n = len([k for k, s in sizes.items() if k in set(ks)])
        assert all(ks[i] == ks[i - n] for i in range(n, len(ks)))


def test_reruns_and_partitionings_agree(docs):
    runs = [sorted(map(repr, mixing.mix(d).collect())) for d in (docs, docs.repartition(5), docs.repartition(2, "size"))]
    assert runs[0] == runs[1] == runs[2]


def test_nothing_to_mix(spark, docs):
    assert mixing.mix(docs.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0.0, 0)] * 2
