import hashlib
import random
import re

import numpy as np

from roadpulse.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, width):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        if item is None or not w:
            continue
        for k in range(max(1, len(w) - width + 1)):
            windows.setdefault(tuple(w[k:k + width]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    for k, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        yield (k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = dc.op1_benchmark_decontamination(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(plain(docs, items, 10))
    assert any(r.contaminated for r in got)


ITEMS = [(1, "The quick, BROWN fox jumps"), (1, "lazy dog"), (2, "lazy dog and THEN runs"), (None, "two words"), (3, None),
         (4, "..."), (5, "one"), (10, "quick brown fox jumps over the lazy dog"), (6, "w1x1 w2x2 w3x3"), (7, "déjà vu été à")]


def test_odd_rows_in_one_and_many_blocks_and_shards(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(i, t, t) for i, t in ITEMS], "item_id long, text string, doc_id string")
    docs = odd_docs.collect()
    want = sorted(str(x[1:3]) + x[4] for x in plain([(r.doc_id, r.text) for r in docs], ITEMS, 3))
    for options in ({}, {"block_words": 3}, {"shard_words": 5}):
        found = dc.occurrences(odd_docs, bench, width=3, **options)
        assert found.columns[:len(odd_docs.columns)] == odd_docs.columns
        got = sorted(str((r._dc_words, sum(b - a for a, b in r._dc_spans)))
                     + hashlib.sha256(",".join(r._dc_items).encode()).hexdigest() for r in found.collect())
        assert got == want
    assert dc.occurrences(no_docs, bench, width=3).count() == 0
    clean = dc.occurrences(odd_docs, bench.limit(0), width=3).collect()
    assert len(clean) == len(docs) and not any(r._dc_spans for r in clean)


def test_passages_are_cut_and_clean_texts_stay(spark):
    docs = spark.createDataFrame([(1, "Keep this. The Quick, brown fox! And this."), (2, "the quick brown fox"), (3, None),
                                  (4, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    got = dict(map(tuple, dc.decontaminate(docs, bench, width=3).collect()))
    assert got == {1: "Keep this. ! And this.", 3: None, 4: "nothing here"}


def test_index_counts_and_locates_like_a_scan():
    rng = random.Random(1)
    for top in (1, 2, 5, 300):
        text = np.array([rng.randint(1, top) for _ in range(700)])
        index = dc.FMIndex(text)
        assert (dc.suffix_array(np.r_[text, 0]) == sorted(range(701), key=lambda i: [*text[i:], 0])).all()
        for n in (1, 2, 4):
            phrases = np.array([[rng.randint(1, top + 1) for _ in range(n)] for _ in range(60)])
            low, high = index.search(phrases, np.full(60, n))
            for p, a, b in zip(phrases, low, high):
                want = [i for i in range(701 - n) if (text[i:i + n] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want
