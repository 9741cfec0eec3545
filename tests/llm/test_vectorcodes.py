"""Cover trees and codes against plain comparisons of every part with every entry."""

import hashlib

import numpy as np
import pytest

from roadpulse.llm import vectorcodes as vc


def nearest(points, book):
    return ((points[:, None, :] - book[None]) ** 2).sum(-1)


def plain(vectors, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks of whole-number vectors in order of their ids."""
    w = vectors.shape[1] // parts
    cut = vectors.reshape(len(vectors), parts, w)
    book = [cut[:entries, p].copy() for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            to = nearest(cut[:, p], book[p]).argmin(1)
            for e in np.unique(to):
                book[p][e] = cut[to == e, p].sum(0) // (to == e).sum()
    d = [nearest(cut[:, p], book[p]) for p in range(parts)]
    return np.stack([x.argmin(1) for x in d], 1), sum(x.min(1) for x in d), np.stack(book)


@pytest.mark.parametrize("n, w, parts, entries", [(1, 1, 1, 1), (60, 2, 3, 5), (2500, 4, 4, 64), (900, 1, 2, 7)])
def test_block_equals_all_comparisons(n, w, parts, entries):
    rng = np.random.default_rng(n)
    vectors = rng.integers(-40, 40, (n, w * parts))
    vectors[: n // 3] = vectors[0]  # a third are copies
    block = vc.Block(vectors, parts)
    book = vectors[-entries:].reshape(-1, parts, w).transpose(1, 0, 2)
    code, error = block.codes(book)
    count, total = block.sums(book)
    for p in range(parts):
        own = vectors.reshape(n, parts, w)[:, p]
        d = nearest(own, book[p])
        assert (code[:, p] == d.argmin(1)).all()
        for e in range(book.shape[1]):
            assert count[p, e] == (code[:, p] == e).sum() and (total[p, e] == own[code[:, p] == e].sum(0)).all()
    assert (error == sum(nearest(vectors.reshape(n, parts, w)[:, p], book[p]).min(1) for p in range(parts))).all()


def test_trees_cover_and_separate():
    rng = np.random.default_rng(3)
    points = rng.integers(-300, 300, (1500, 3))
    order, nodes = vc.cover_trees(points, np.zeros(1500, int))
    assert sorted(order) == list(range(1500))
    for v in range(len(nodes["lo"])):
        inside = points[order[nodes["lo"][v]:nodes["hi"][v]]]
        centre = points[nodes["centre"][v]]
        assert ((inside - centre) ** 2).sum(1).max() == nodes["radius"][v]
        a, n = nodes["child"][v], nodes["children"][v]
        assert n or nodes["radius"][v] == 0
        if n:
            heads = points[nodes["centre"][a:a + n]]
            assert (heads[0] == centre).all() and nodes["lo"][a] == nodes["lo"][v] and nodes["hi"][a + n - 1] == nodes["hi"][v]
            apart = nearest(heads, heads)[~np.eye(n, dtype=bool)]
            assert n == 1 or apart.min() > nodes["radius"][v] // 4
            assert (nodes["radius"][a:a + n] <= nodes["radius"][v] // 4).all()


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(0, 20, (4000, 4)), rng.integers(1000, 1020, (4000, 4))])
    block = vc.Block(points, 1)
    node, _ = vc.descend(block.points, block.nodes, np.array([[[10, 10, 10, 10], [1010, 1010, 1010, 1010]]]))
    assert len(node) < 20


@pytest.mark.parametrize("block_components", [1 << 19, 64 * 70])
def test_codes_of_odd_rows(spark, block_components):
    rng = np.random.default_rng(8)
    vectors = (rng.normal(size=(300, 64)) / 3).astype(np.float32)
    vectors[::3] = vectors[0]
    rows = [(i * 7 % 300, [float(x) for x in v], [None, 1, 2][i % 3], "z", 5) for i, v in enumerate(vectors)]
    bad = [(900, None, 1, "z", 1), (901, [1.0, None] * 32, 1, "z", 1), (902, [float("nan")] * 64, 1, "z", 1),
           (903, [float("inf")] * 64, None, "z", 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, code string, error long")
    coded, book = vc.quantize(df, block_components=block_components)
    got = {r["id"]: r for r in vc.with_label_error(coded).collect()}
    by = sorted(rows, key=lambda r: r[0])
    code, error, books = plain(np.floor(256 * np.array([r[1] for r in by])).astype(int))
    assert (book == books).all() and sorted(got) == list(range(300))
    for i in range(300):
        assert got[i]["code"] == "".join(f"{x:02x}" for x in code[i]) and got[i]["error"] == error[i]
        assert got[i]["label_error"] == sum(error[j] for j in range(300) if by[j][2] == by[i][2])
    assert vc.book_sha256(book) == hashlib.sha256(",".join(str(x) for x in books.reshape(-1)).encode()).hexdigest()


def test_short_long_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(1, [], "a"), (2, [0.5] * 17, "a"), (None, [1e300] * 3, None), (3, [-1e300], "b"), (2, [0.5] * 17, "a")]
    coded, book = vc.quantize(spark.createDataFrame(rows, schema))
    assert coded.count() == 5 and book.shape == (16, 5, 2) and abs(book).max() == vc.BOUND
    assert {r["error"] for r in coded.collect()} == {0}
    assert vc.quantize(spark.createDataFrame([], schema))[0].collect() == []
    assert vc.quantize(spark.createDataFrame([(1, None, "a")], schema))[0].collect() == []
