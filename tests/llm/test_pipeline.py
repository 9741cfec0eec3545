"""Each stage against brute force on what its predecessor kept."""

import re

import corpus_pipeline as cp
from pyspark.sql import functions as F

from test_decontaminate import plain as hits
from test_packing import check as packed
from test_simhash import plain_fingerprint, plain_groups

from roadpulse.llm import decontaminate, packing
from roadpulse.llm import toxicity as tox
from roadpulse.llm.common import stored


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    before = {r.doc_id: r for r in docs.collect()}
    kept = stored(stages["toxicity"](spark, docs, sf), "t")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == columns and all(before[k] == r for k, r in left.items())
    assert sum(k in left for k, t in labels.items() if t == 0) >= 0.97 * sum(t == 0 for t in labels.values())
    assert sum(k not in left for k, t in labels.items() if t == 1) >= 0.9 * sum(t == 1 for t in labels.values())

    one = stored(stages["simhash_near_dedup"](spark, kept, sf), "t")
    rows = sorted((k, plain_fingerprint(r.text)) for k, r in left.items())
    want = {c for c in plain_groups(rows)}
    single = {r.doc_id: r for r in one.collect()}
    assert one.columns == columns and set(single) == want and all(before[k] == r for k, r in single.items())

    clean = stored(stages["benchmark_decontamination"](spark, one, sf), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {x[0]: x for x in hits([(k, r.text) for k, r in single.items()], items, 10)}
    after = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and set(after) == {k for k, x in found.items() if not x[5] or x[2] < x[1]}
    for k, r in after.items():
        assert r.n_chars == len(r.text)
        assert (r.text == single[k].text) == (not found[k][5])
        assert len(decontaminate.words(r.text)) == found[k][1] - found[k][2]

    private = stored(stages["pii"](spark, clean, sf), "t")
    named = {r.doc_id: r.text for r in private.collect()}
    assert private.columns == columns and set(named) == set(after)
    email = re.compile(r"[a-z.\d]+@mail\d\.example")
    for k, t in named.items():
        assert not set(email.findall(t)) & set(email.findall(after[k].text))

    out = stages["packing"](spark, private, sf).collect()
    assert packed(list(named.items()), out, packing.tokenizer_path()) > 0.85


def test_odd_rows_go_through(spark, sf, odd_docs):
    docs = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"),
                           F.length("text").cast("long").alias("n_chars"))
    for rows in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            rows = stored(stage(spark, rows, sf), "t")
            assert name == "packing" or rows.columns == docs.columns
        assert rows.count() >= 0


def test_run_equals_its_stages(spark, sf):
    assert cp.run(spark, sf).count() > 0
    assert tox.CATEGORIES
