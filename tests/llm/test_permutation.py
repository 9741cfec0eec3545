import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import permutation as pm


def plain(rows, k, every=20):
    """Exact nearest of each query among distinct (id, vector) rows."""
    size = max((len(v) for _, v in rows if v), default=0)
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i, tuple([*v, *[0.0] * (size - len(v))])] = None
    for i, v in good:
        if i % every == 0:
            near = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in good if j != i)
            yield i, [(j, -s) for s, j in near[:k]]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_query_recall_and_scores(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = dict(plain(rows, 20)), found(pm.op2_permutation_index(spark, sf))
    assert set(got) == set(want)
    vectors = {i: np.array(v) for i, v in rows}
    hits = 0
    for q, near in want.items():
        assert len(got[q]) == 20
        hits += len({j for j, _ in near} & {j for j, _ in got[q]})
        for j, score in got[q]:
            assert score == pytest.approx(float(vectors[q] @ vectors[j]), abs=1e-12)
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
    assert hits >= 0.9 * 20 * len(want)


def test_recall_when_only_a_share_is_reranked(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(pm.search(frame, F.col("id") % 100 == 0, k=10, pivots=128, prefix=32, rerank=0.2, least=50,
                          shard_rows=1000, block_rows=7))
    want = dict(plain(rows, 10, 100))
    assert sum(len({j for j, _ in want[q]} & {j for j, _ in got[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None),
            (5, [0.0, 0.0]), (6, [1.0, nan]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [2.0]), (10, []),
            (40, [-1.0, 3.0]), (11, [-1.0, 3.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows],
                                  "vec_id long, embedding array<double>, id long, h long, v double")
    for k in (2, 20):
        assert found(pm.search(frame, F.col("id") % 20 == 0, k=k)) == dict(plain(rows, k))
    assert pm.search(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_footrule_order_equals_definition():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(200, 8))
    band = pm.Band(vectors, np.sqrt((vectors ** 2).sum(1)), 30, 10, 40, 0.0)
    level = np.c_[vectors, np.sqrt(band.longest ** 2 - (vectors ** 2).sum(1).clip(max=band.longest ** 2))]
    query = rng.normal(size=8)

    def places(prefix):
        return {p: k for k, p in enumerate(prefix.tolist())}
    q = places(pm.prefixes(query[None], band.pivots[:, :-1], 10)[0])
    rule = [sum(abs(q.get(p, 10) - x.get(p, 10)) for p in range(30)) for x in map(places, pm.prefixes(level, band.pivots, 10))]
    got = band.candidates(query)
    assert len(got) == 40 and sorted(rule)[:40] == sorted(rule[i] for i in got)


@pytest.mark.parametrize("sigma", [0.0, 0.5, 1.0])
def test_recall_when_lengths_differ(sigma):
    """A whole shard of 16,384 vectors under the registered settings; lengths are log-normal."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(16384, 64))
    vectors *= (np.exp(sigma * rng.normal(size=len(vectors))) / np.sqrt((vectors ** 2).sum(1)))[:, None]
    shard = pm.Shard(vectors, 256, 64, 1.1, 512, 0.15)
    queries = vectors[::130]
    hits = 0
    for q, (at, score) in zip(queries, shard.nearest(queries, 21)):
        want = np.argsort(-(vectors @ q), kind="stable")[:21]
        hits += len(set(want.tolist()) & set(at[np.argsort(-score, kind="stable")[:21]].tolist()))
    assert hits >= 0.93 * 21 * len(queries)


def test_an_id_with_two_vectors_has_a_list_for_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [3.0, 0.5])]
    got = pm.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 2.0), (0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 2, 2, 1.0)]
