"""Vector codes by product quantisation, with Lloyd's rounds on cover trees.

A component x becomes the whole number floor(256 x); a vector is cut into
``parts`` equal consecutive parts, each with a codebook of ``entries``.  The
codebooks start as the parts of the first vectors by id; a round assigns every
part to its nearest entry and moves each entry to the floored mean.

Vectors stay in blocks of a bounded number of components.  For each block and
part one cover tree is built: a node's points lie within its radius of its
centre, its children's centres are more than half of that apart, the first
child has the node's own centre, and equal points end in one node of radius 0.
Points are stored in tree order, so a node is a range and running sums give
its sum and count.  In a round the trees are read from the top: with radius r,
an entry further than 2 r beyond the nearest one cannot be nearest to any
point of the node (triangle inequality).  A node left with one entry is
assigned as a whole, from the running sums; only ambiguous nodes descend, and
points of radius 0 are compared exactly, in whole numbers.  All trees of a
block descend together, level by level.

A round returns sums and counts for each task, part and entry, which Spark
adds up; only the codebooks (``entries`` vectors) reach the driver.

Edge cases: rows whose vector is null or holds a null or non-finite component
are dropped.  A vector shorter than the longest one, or than a multiple of
``parts``, counts as padded with zeros.  Rows stand by id, null ids last, then
by vector; the first ``entries`` rows start the codebooks, repeated rows
included.  With fewer rows there are fewer entries.  An empty table gives no
rows.  Whole numbers beyond 2^25 in size (components beyond 131,072) are set
to that bound, which keeps distances exact.  A label's total that does not fit a
long is null.  Only the id, vector and label columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BOUND = 1 << 25
NODES = ("centre", "radius", "lo", "hi", "child", "children")


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, exact in whole numbers, of rows of points (n, w) to (n, k, w) or (k, w) centres."""
    gap = points[:, None, :] - centres
    return np.einsum("nkw,nkw->nk", gap, gap)


def cover_trees(points: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Cover trees of ``points`` (n, w), one for each value of ``tree`` (n, from 0).

    Returns the points' order and the nodes: centre (a row of ``points``),
    radius (squared), lo and hi (range in the order), child (first child) and
    children (their number).  Roots are the first nodes, in order of ``tree``.
    """
    n = len(points)
    nodes = {k: [] for k in NODES}
    home = np.asarray(tree, np.int64)            # node of each point at this level
    roots = np.arange(int(home.max()) + 1 if n else 0)
    first = np.full(len(roots), n, np.int64)
    np.minimum.at(first, home, np.arange(n))
    centre = first
    base, active = 0, np.arange(n)               # number of the level's first node; points below open nodes
    path = [home]
    gap = points - points[centre[home]]
    far = np.einsum("nw,nw->n", gap, gap)        # squared distance to the centre of the point's node
    at = home.copy()                             # node within the level
    while True:
        radius = np.zeros(len(centre), np.int64)
        np.maximum.at(radius, at[active], far[active])
        nodes["centre"].append(centre)
        nodes["radius"].append(radius)
        open_ = radius > 0
        active = active[open_[at[active]]]
        if not len(active):
            break
        # children: nets of half the radius (a quarter of its square) within each node, all nodes at once
        reach = np.zeros(n, np.int64)
        reach[active] = radius[at[active]] // 4
        child_of, child_centre = [np.flatnonzero(open_)], [centre[open_]]
        number = np.cumsum(open_) - 1            # the first child has the node's own centre
        to = np.full(n, -1, np.int64)
        near = active[far[active] <= reach[active]]
        to[near] = number[at[near]]
        left, total = active[far[active] > reach[active]], int(open_.sum())
        while len(left):
            where = at[left]
            new = np.r_[True, where[1:] != where[:-1]] if (where[1:] >= where[:-1]).all() else None
            if new is None:                      # keep points grouped by node: the first of each is the next centre
                left = left[np.argsort(where, kind="stable")]
                where = at[left]
                new = np.r_[True, where[1:] != where[:-1]]
            heads = left[new]
            mine = np.cumsum(new) - 1
            gap = points[left] - points[heads[mine]]
            d = np.einsum("nw,nw->n", gap, gap)
            inside = d <= reach[left]
            got = left[inside]
            to[got], far[got] = total + mine[inside], d[inside]
            child_of.append(at[heads])
            child_centre.append(heads)
            total += len(heads)
            left = left[~inside]
        parent, centres = np.concatenate(child_of), np.concatenate(child_centre)
        by = np.argsort(parent, kind="stable")   # children of one node side by side
        place = np.empty(total, np.int64)
        place[by] = np.arange(total)
        count = np.bincount(parent, minlength=len(centre))
        level = base + len(centre)
        nodes["child"].append(level + np.cumsum(count) - count)
        nodes["children"].append(count)
        at[active] = place[to[active]]
        stay = np.full(n, -1, np.int64)
        stay[active] = at[active]
        path.append(stay)
        base, centre = level, centres[by]
    nodes["child"].append(np.zeros(len(centre), np.int64))
    nodes["children"].append(np.zeros(len(centre), np.int64))
    order = np.lexsort(path[::-1])
    # ranges: a node's points share its path, so they are consecutive in the order
    for stay in path:
        seen = stay[order]
        lo = np.full(int(stay.max(initial=-1)) + 1, n, np.int64)
        hi = np.zeros(len(lo), np.int64)
        inside = np.flatnonzero(seen >= 0)
        np.minimum.at(lo, seen[inside], inside)
        np.maximum.at(hi, seen[inside], inside + 1)
        nodes["lo"].append(lo)
        nodes["hi"].append(hi)
    return order, {k: np.concatenate(v) for k, v in nodes.items()}


def descend(points: np.ndarray, nodes: dict[str, np.ndarray], book: np.ndarray, chunk: int = 1 << 15):
    """(node, entry) pairs whose ranges cover every point once: the entry nearest to all points of the node.

    ``book`` is (parts, entries, w), or one codebook (entries, w) for all trees.  Ties go to the lower entry.
    """
    parts, entries = book.shape[0], book.shape[1]
    now, part = np.arange(parts), np.arange(parts)
    alive = np.ones((parts, entries), bool)
    found_n, found_e = [], []
    while len(now):
        next_now, next_part, next_alive = [], [], []
        for a in range(0, len(now), chunk):
            node, own, mask = now[a:a + chunk], part[a:a + chunk], alive[a:a + chunk]
            d = distances(points[nodes["centre"][node]], book[own])
            d[~mask] = np.iinfo(np.int64).max
            best = d.argmin(axis=1)
            radius = nodes["radius"][node]
            root = np.sqrt(d.astype(float))
            # margin for the rounding of the square roots
            limit = (root[np.arange(len(node)), best] + 2 * np.sqrt(radius.astype(float))) * (1 + 1e-12) + 1e-9
            mask = mask & (root <= limit[:, None])
            sure = (radius == 0) | (mask.sum(axis=1) == 1)
            found_n.append(node[sure])
            found_e.append(best[sure])
            node, own, mask = node[~sure], own[~sure], mask[~sure]
            count = nodes["children"][node]
            of = np.repeat(np.arange(len(node)), count)
            step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            next_now.append(nodes["child"][node][of] + step)
            next_part.append(own[of])
            next_alive.append(mask[of])
        now, part, alive = (np.concatenate(x) for x in (next_now, next_part, next_alive))
    return np.concatenate(found_n), np.concatenate(found_e)


class Block:
    """Vectors of one block with their trees: points (parts * n, w) in tree order."""

    def __init__(self, vectors: np.ndarray, parts: int, packed: tuple | None = None):
        n, dims = vectors.shape
        w = dims // parts
        points = vectors.reshape(n, parts, w).transpose(1, 0, 2).reshape(parts * n, w)
        if packed is None:
            order, nodes = cover_trees(points, np.repeat(np.arange(parts), n))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            nodes["centre"] = place[nodes["centre"]]
        else:
            order, nodes = packed
        self.n, self.parts, self.order, self.nodes = n, parts, order, nodes
        self.points = points[order]

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (parts, entries) and sums (parts, entries, w) of the points by nearest entry."""
        node, entry = descend(self.points, self.nodes, book)
        lo, hi = self.nodes["lo"][node], self.nodes["hi"][node]
        running = np.vstack([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])
        slot = lo // self.n * book.shape[1] + entry   # a tree's points are one run of n
        count, total = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)
        np.add.at(count.reshape(-1), slot, hi - lo)
        np.add.at(total.reshape(-1, book.shape[2]), slot, running[hi] - running[lo])
        return count, total

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, parts) and errors (n) of the vectors."""
        node, entry = descend(self.points, self.nodes, book)
        lo, hi = self.nodes["lo"][node], self.nodes["hi"][node]
        by = np.argsort(lo)
        given = np.repeat(entry[by], (hi - lo)[by])
        gap = self.points - book.reshape(-1, book.shape[2])[np.arange(len(given)) // self.n * book.shape[1] + given]
        code, error = np.empty(len(given), np.int64), np.empty(len(given), np.int64)
        code[self.order], error[self.order] = given, np.einsum("nw,nw->n", gap, gap)
        return code.reshape(self.parts, self.n).T, error.reshape(self.parts, self.n).sum(axis=0)


def whole(column: pd.Series, dims: int, scale: int) -> np.ndarray:
    """Vectors as whole numbers, padded with zeros to ``dims``."""
    out = np.zeros((len(column), dims), np.int64)
    size = column.map(len).to_numpy()
    if len(column) and (size == size[0]).all():
        flat = np.stack(column.to_numpy()).astype(float) if size[0] else np.zeros((len(column), 0))
        out[:, :size[0]] = np.clip(np.floor(scale * flat), -BOUND, BOUND)
    else:
        for i, v in enumerate(column):
            out[i, :len(v)] = np.clip(np.floor(scale * np.asarray(v, float)), -BOUND, BOUND)
    return out


STORED = ("centre", "radius", "lo", "hi", "children")


def _pack(block: Block) -> bytes:
    """The trees in four bytes a number; radii are rounded up, and first children follow from the numbers of children."""
    above = np.nextafter(block.nodes["radius"].astype("<f4"), np.float32(np.inf))
    nodes = block.nodes | {"radius": np.where(block.nodes["radius"] > 0, above, np.float32(0))}
    return b"".join(a.astype("<f4" if k == "radius" else "<i4").tobytes()
                    for k, a in [("order", block.order), *((k, nodes[k]) for k in STORED)])


def _unpack(raw: bytes, points: int, parts: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    order = np.frombuffer(raw, "<i4", points).astype(np.int64)
    n = (len(raw) // 4 - points) // len(STORED)
    nodes = {k: np.frombuffer(raw, "<f4" if k == "radius" else "<i4", n, 4 * (points + i * n)) for i, k in enumerate(STORED)}
    nodes = {k: a if k == "radius" else a.astype(np.int64) for k, a in nodes.items()}
    # nodes stand level by level, children in the order of their parents
    nodes["child"] = parts + np.cumsum(nodes["children"]) - nodes["children"]
    return order, nodes


def fit_blocks(kept: DataFrame, dims: int, parts: int, scale: int, block_components: int) -> DataFrame:
    """(ids, labels, vectors, tree) of bounded blocks of rows, each with its trees."""
    rows = max(1, block_components // max(dims, 1))

    def run(frames):
        for frame in frames:
            for a in range(0, len(frame), rows):
                part = frame.iloc[a:a + rows]
                block = Block(whole(part["v"], dims, scale), parts)
                points = np.empty_like(block.points)
                points[block.order] = block.points
                vectors = points.reshape(parts, len(part), dims // parts).transpose(1, 0, 2)
                yield pd.DataFrame({"ids": [part["id"].tolist()], "labels": [part["label"].tolist()], "n": [len(part)],
                                    "vectors": [vectors.astype("<i4").tobytes()], "tree": [_pack(block)]})

    return kept.mapInPandas(run, "ids array<string>, labels array<string>, n int, vectors binary, tree binary")


def quantize(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
             block_components: int = 1 << 19) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) for every kept row, codebooks (parts, entries, w))."""
    if entries > 256:
        raise ValueError("a code has two hex digits")
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kinds = [rows.schema[c].dataType for c in (id_col, label_col)]
    kept = (rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"), bad.alias("bad"))
            .where("v is not null and not bad").drop("bad"))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    schema = f"id {kinds[0].simpleString()}, label {kinds[1].simpleString()}, code string, error long"
    if longest is None:
        return rows.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    dims = max(-(-longest // parts), 1) * parts
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toPandas()
    book = whole(first["v"], dims, scale).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    blocks = stored(fit_blocks(kept.select(F.col("id").cast("string"), F.col("label").cast("string"), "v"),
                               dims, parts, scale, block_components), "code-blocks")

    def opened(frame: pd.DataFrame):
        for row in frame.itertuples(index=False):
            vectors = np.frombuffer(row.vectors, "<i4").reshape(row.n, dims).astype(np.int64)
            yield row, Block(vectors, parts, _unpack(row.tree, row.n * parts, parts))

    def totals(now: np.ndarray):
        def run(frames):
            count, total = np.zeros(now.shape[:2], np.int64), np.zeros(now.shape, np.int64)
            for frame in frames:
                for _, block in opened(frame):
                    c, t = block.sums(now)
                    count, total = count + c, total + t
            slot = np.flatnonzero(count.reshape(-1))
            w = now.shape[2]
            yield pd.DataFrame({"slot": np.repeat(slot, w), "at": np.tile(np.arange(w), len(slot)),
                                "n": np.repeat(count.reshape(-1)[slot], w), "sum": total.reshape(-1, w)[slot].reshape(-1)})
        return run

    for _ in range(rounds):
        got = (blocks.select("n", "vectors", "tree").mapInPandas(totals(book), "slot int, at int, n long, sum long")
               .groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).toPandas())
        flat = book.reshape(-1, book.shape[2])  # entries without parts stay
        flat[got["slot"].to_numpy(), got["at"].to_numpy()] = got["sum"].to_numpy() // got["n"].to_numpy()

    def assign(frames):
        digits = np.array([f"{i:02x}" for i in range(256)])
        for frame in frames:
            for row, block in opened(frame):
                code, error = block.codes(book)
                yield pd.DataFrame({"id": row.ids, "label": row.labels,
                                    "code": ["".join(x) for x in digits[code].tolist()], "error": error})

    coded = blocks.mapInPandas(assign, "id string, label string, code string, error long")
    return coded.select(F.col("id").cast(kinds[0]), F.col("label").cast(kinds[1]), "code", "error"), book


def book_sha256(book: np.ndarray) -> str:
    """Digest of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, broadcast_labels: int = 100_000) -> DataFrame:
    """``coded`` with label_error, the errors of equal labels added up, nulls together."""
    totals = stored(coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_sum(error)").alias("label_error")), "label-errors")
    if totals.count() <= broadcast_labels:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op12_vector_codes(spark, sf_dir):
    """Codes of all ``embeddings``: 16 parts, codebooks of 64, two rounds."""
    from .common import table
    coded, book = quantize(table(spark, sf_dir, "embeddings"))
    return with_label_error(stored(coded, "codes")).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(book_sha256(book)).alias("codebooks_sha256"))
