import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from roadpulse.llm import packing as pk


@pytest.fixture(scope="module")
def path():
    return pk.tokenizer_path()


def check(docs, rows, path, capacity=4096):
    tokenizer, want = Tokenizer.from_file(path), []
    for k, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((str(k), len(ids), ids))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, n, ids in want:
        mine = sorted(by_doc[k, n], key=lambda r: r.start)
        repeats = sum(w[:2] == (k, n) for w in want)
        covered = np.zeros(n, int)
        for r in mine:
            covered[r.start:r.start + r.length] += 1
            if repeats == 1:
                assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        assert (covered == repeats).all()
    assert {(k, n) for k, n, _ in want} == set(by_doc)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows) / capacity / max(1, len(by_sequence))


def test_query_packs_every_id_once(spark, sf, path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check(docs, pk.op10_packing(spark, sf).collect(), path) > 0.9


def test_odd_rows(odd_docs, no_docs, path):
    rows = pk.pack(odd_docs, path, capacity=512, grain=4).collect()
    check([(r.doc_id, r.text) for r in odd_docs.collect()], rows, path, 512)
    assert pk.pack(no_docs, path).count() == 0


def test_encoder_equals_tokenizer(path):
    tokenizer = Tokenizer.from_file(path)
    texts = ["<|endoftext|>a b", "<|ENDOFTEXT|> I'm it's. don't, 5th. 12.5, a.b, x!! ... J̌", "Å é  　 K İ ΣΑΣ «été», déjà. ª²",
             "á. ́b , .́", "", None, "The the THE, The. the.. \x1c x\x85y"]
    for encode in (pk.Encoder(path), pk.Encoder(path, cached=2)):
        for _ in range(2):
            for text, got in zip(texts, encode(texts)):
                assert got == np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def best(sizes, capacity):
    """Fewest bins by exhaustive search."""
    def fill(rest, room, bins):
        if not rest:
            return bins
        first, *rest = rest
        options = [fill(rest, [*room[:i], r - first, *room[i + 1:]], bins) for i, r in enumerate(room) if r >= first]
        return min([*options, fill(rest, [*room, capacity - first], bins + 1)])
    return fill(sorted(sizes, reverse=True), [], 0)


def lower_bound(demand, capacity):
    """Sequences that any packing needs, by weak duality; that no pattern is worth over 1 is checked here."""
    _, prices = pk.generate(demand, capacity)
    sizes = np.flatnonzero(demand) + 1
    worth = [0.0] * (capacity + 1)
    for room in range(1, capacity + 1):
        worth[room] = max([worth[room - 1], *(p + worth[room - s] for s, p in zip(sizes.tolist(), prices.tolist()) if s <= room)])
    assert worth[capacity] <= 1 + 1e-9 and (prices >= 0).all()
    return float(prices @ demand[sizes - 1])


def test_column_generation_is_near_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 11, 8)
        demand = np.bincount(sizes, minlength=11)[1:]
        plan = pk.whole_patterns(demand, 10)
        assert (sum(t * c for c, t in plan) == demand).all()
        assert all((c * np.arange(1, 11)).sum() <= 10 for c, _ in plan)
        assert sum(t for _, t in plan) <= best(sizes.tolist(), 10) + 1
    many = rng.integers(1, 1000, 256)
    plan = pk.whole_patterns(many, 256)
    assert (sum(t * c for c, t in plan) == many).all()
    # many pieces are over half a sequence, so the volume alone is no attainable bound
    assert sum(t for _, t in plan) <= 1.01 * lower_bound(many, 256) + 2
    short = np.r_[rng.integers(1, 1000, 100), np.zeros(156, int)]
    assert sum(t for _, t in pk.whole_patterns(short, 256)) <= 1.01 * (short * np.arange(1, 257)).sum() / 256 + 2


def test_knapsack_price_equals_brute_force():
    values = np.array([0.11, 0.19, 0.35, 0.0, 0.52])
    best, took = pk.price(values, 9)
    worth, counts = best[9], pk.pattern(took, 9, len(values))
    best_worth = max(a * .11 + b * .19 + c * .35 + e * .52 for a in range(10) for b in range(5) for c in range(4)
                     for e in range(2) if a + 2 * b + 3 * c + 5 * e <= 9)
    assert worth == pytest.approx(best_worth) and counts @ values == pytest.approx(worth)


@pytest.mark.parametrize("words", [8, 16, 2100, 4000])
def test_sequences_of_one_length_are_full(spark, path, words):
    docs = [(k, " ".join(["the"] * (words + (k % 3 if words > 99 else 0)))) for k in range(700 if words < 99 else 90)]
    rows = pk.pack(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()
    check(docs, rows, path)
    total = sum(r.length for r in rows)
    assert sorted({r.sequence_id for r in rows}) == list(range(-(-total // 4096)))


def test_only_dissolved_sequences_are_cut(spark, path):
    docs = [(k, " ".join(["the"] * (15 + 16 * (k % 40)))) for k in range(400)]
    rows = pk.pack(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()
    check(docs, rows, path)
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 4096)
    assert len(rows) - 400 <= 2 * len({r.sequence_id for r in rows})
