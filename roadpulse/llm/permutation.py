"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order (pivots are at most
``pivots`` of its band's vectors).  An index posts its vectors, with the pivot's place, in one
inverted file for each pivot.  A query walks the files of its own prefix and
adds up, for every vector met, how much shorter the footrule distance of the
two (truncated) permutations becomes; the vectors nearest by footrule, a
``rerank`` share of the band, are reranked by the inner product in double
precision on the original components.

An order of pivots does not know a vector's length, which an inner product
depends on.  Vectors are therefore sorted by length, a shard holds neighbours
in that order, and within a shard bands hold vectors of nearly the same length
(``band`` at most, from longest to shortest).  In a band every vector gets one more coordinate that
brings it to the band's greatest length (queries have 0 there), so that nearness of
directions is that of inner products.  A query visits its shard's bands from the
longest on, and leaves out those whose greatest length times its own cannot reach the
products that it has found; small bands are compared as a whole.

Every vector is indexed.  Shards and blocks of queries have a bounded number of
rows, and a task searches one shard for one block of queries.  Equal vectors
are searched once: each distinct vector carries its ``k + 1`` smallest ids,
which is all that a result of ``k`` can hold, and results of equal queries are
copied at the end.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part; neither do rows with a null id.  A vector shorter
than the longest one counts as padded with zeros.  Repeated rows (same id and
vector) count once; an id with several vectors is a query with each of them, a list for each;
a query never returns its own id.  Fewer candidates than
``k`` give all of them.  An empty table gives no rows.  Columns other than the
id and the vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import positions, stored


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, h, g): usable vectors as doubles of one length, and their 128-bit hash."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    good = (rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), bad.alias("bad"), some.alias("some"))
            .where("id is not null and v is not null and not bad and some"))
    longest = good.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v")))
    return good.select("id", padded.alias("v")).withColumns(
        {"h": F.xxhash64("v"), "g": F.xxhash64(F.lit("second"), F.col("v"))})


def prefixes(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of each vector's nearest pivots, nearest first."""
    near = vectors @ pivots.T
    length = min(length, len(pivots))
    top = np.argpartition(-near, length - 1, axis=1)[:, :length]
    order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


class Band:
    """Inverted files of pivots over vectors of nearly the same length."""

    def __init__(self, vectors: np.ndarray, lengths: np.ndarray, pivots: int, length: int, least: int, share: float):
        self.vectors, self.longest = vectors, float(lengths.max())
        self.count = max(least, int(np.ceil(share * len(vectors))))
        if self.count >= len(vectors):
            return
        level = np.c_[vectors, np.sqrt(np.maximum(self.longest ** 2 - lengths ** 2, 0))]
        self.pivots = level[np.unique(np.linspace(0, len(vectors) - 1, pivots).astype(int))]
        near = prefixes(level, self.pivots, length)
        width = near.shape[1]
        self.length = width
        by = np.argsort(near, axis=None, kind="stable")
        self.rows = (by // width).astype(np.int32)
        self.places = (by % width).astype(np.int32)
        self.starts = np.r_[0, np.cumsum(np.bincount(near.ravel(), minlength=len(self.pivots)))]

    def candidates(self, query: np.ndarray) -> np.ndarray:
        """Vectors with the smallest footrule distance to a query's prefix.

        The distance is a constant minus twice the sum, over pivots in both
        prefixes, of length minus the later of the two places.
        """
        n = len(self.vectors)
        if self.count >= n:
            return np.arange(n)
        prefix = prefixes(query[None], self.pivots[:, :-1], self.length)[0]
        closer, length = np.zeros(n, np.int32), len(prefix)
        for place, pivot in enumerate(prefix.tolist()):
            a, b = self.starts[pivot], self.starts[pivot + 1]
            closer[self.rows[a:b]] += length - np.maximum(self.places[a:b], place)
        return np.argpartition(-closer, self.count - 1)[:self.count]


class Shard:
    """Bands of a bounded number of vectors, the longest vectors first."""

    def __init__(self, vectors: np.ndarray, pivots: int, length: int, band: float, least: int, share: float):
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        self.order = np.argsort(-lengths, kind="stable")
        sorted_, self.bands, at = lengths[self.order], [], 0
        while at < len(sorted_):
            end = max(int(np.searchsorted(-sorted_, -sorted_[at] / band, side="right")), min(at + least, len(sorted_)))
            rows = self.order[at:end]
            self.bands.append((at, Band(vectors[rows], lengths[rows], pivots, length, least, share)))
            at = end

    def nearest(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query: numbers and inner products of its best ``k`` vectors found, with all that tie."""
        found = []
        for query in queries:
            own = float(np.sqrt((query * query).sum()))
            places, scores, bar = [], [], -np.inf
            for first, band in self.bands:
                if own * band.longest * (1 + 1e-9) < bar:
                    break
                at = band.candidates(query)
                rough = band.vectors[at] @ query
                if len(at) > k:
                    bar = max(bar, np.partition(rough, len(at) - k)[len(at) - k])
                keep = rough >= bar - 1e-9 * (1 + abs(bar))  # whatever could tie with the k-th before exact sums decide
                places.append(self.order[first + at[keep]])
                scores.append((band.vectors[at[keep]] * query).sum(axis=1))
            at, score = np.concatenate(places), np.concatenate(scores)
            if len(at) > k:
                best = score >= np.partition(score, len(at) - k)[len(at) - k]
                at, score = at[best], score[best]
            found.append((at, score))
        return found


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
           pivots: int = 256, prefix: int = 64, rerank: float = 0.15, least: int = 512, band: float = 1.1,
           shard_rows: int = 16384, block_rows: int = 2048) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of every query row.

    ``is_query`` is a condition over the column ``id``.
    """
    good = stored(valid_vectors(rows, id_col, vec_col), "vectors")
    keys = ["h", "g"]
    ids = positions(good.select("id", *keys).distinct(), keys, ["id"], "place")
    copies = stored(ids.where(F.col("place") <= k), "copies")
    asked = stored(ids.where(is_query).select("id", *keys), "asked")
    distinct = stored(good.groupBy(*keys).agg(F.first("v").alias("v")), "distinct")
    queries = stored(distinct.join(asked.select(*keys).distinct(), keys, "left_semi"), "queries")
    n, m = distinct.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    shorter = -F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    ranked = positions(distinct.withColumn("shorter", shorter), [], ["shorter", *keys], "nth")
    sharded = ranked.withColumn("shard", F.floor(F.col("nth") * shards / n).cast("int")) if n else ranked.withColumn("shard", F.lit(0))

    def cell(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if index.empty or asked.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in
                                 (("qh", "int64"), ("qg", "int64"), ("h", "int64"), ("g", "int64"), ("score", "float64"))})
        index = index.sort_values(["h", "g"])  # pivots then do not depend on the order of arrival
        shard = Shard(np.stack(index["v"].to_numpy()), pivots, prefix, band, least, rerank)
        found = shard.nearest(np.stack(asked["v"].to_numpy()), k + 1)
        size = [len(at) for at, _ in found]
        at = np.concatenate([at for at, _ in found])
        return pd.DataFrame({"qh": np.repeat(asked["h"].to_numpy(), size), "qg": np.repeat(asked["g"].to_numpy(), size),
                             "h": index["h"].to_numpy()[at], "g": index["g"].to_numpy()[at],
                             "score": np.concatenate([s for _, s in found])})

    every = lambda other_n: F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))
    index = sharded.select("shard", "h", "g", "v").withColumn("block", every(blocks))
    queries = queries.select(F.pmod("h", F.lit(blocks)).cast("int").alias("block"), "h", "g", "v").withColumn("shard", every(shards))
    near = stored(index.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(
        cell, "qh long, qg long, h long, g long, score double"), "near")
    best = Window.partitionBy("qh", "qg").orderBy(F.desc("score"), "id")
    top = stored(near.join(copies, keys).select("qh", "qg", "id", "score")
                 .withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1), "top")
    own = Window.partitionBy("query_id", "qh", "qg").orderBy(F.desc("score"), "id")
    return (asked.select(F.col("id").alias("query_id"), F.col("h").alias("qh"), F.col("g").alias("qg"))
            .join(top, ["qh", "qg"]).where("id <> query_id")
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))


def op2_permutation_index(spark, sf_dir):
    """Twenty nearest of every twentieth row of ``embeddings`` among all other rows."""
    from .common import table
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
