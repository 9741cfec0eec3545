import numpy as np
import pytest

from roadpulse.llm import toxicity as tx


@pytest.fixture(scope="module")
def corpus(spark):
    """Rude words make toxic; shouting makes low quality; some toxic texts only shout and threaten."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(900):
        words = [f"w{''.join(rng.choice(list('abcdef'), 3))}" for _ in range(rng.integers(5, 60))]
        low, toxic = rng.random() < 0.3, rng.random() < 0.2
        if low:
            words += ["buynow"] * 2
        if toxic:
            words += list(rng.choice(["idiotic", "idiots", "scum", "scummy"], 2))
        rows.append((k, " ".join(rng.permutation(words)), int(not low), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, t) for k, _, q, t in rows if k < 600], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy_and_chain(spark, corpus):
    rows, docs, labels = corpus
    chain = tx.fit(docs, labels, tx.CATEGORIES, kept=200)
    assert [len(w) for w in chain.weights] == [len(chain.vocabulary.number), len(chain.vocabulary.number) + 1]
    got = {r.doc_id: r._tox for r in tx.predict(docs, chain, list(tx.CATEGORIES)).collect()}
    held = [r for r in rows if r[0] >= 600]
    assert np.mean([(got[k].toxic >= 0.5) == t for k, _, _, t in held]) > 0.97
    assert np.mean([(got[k].low_quality >= 0.5) != q for k, _, q, _ in held]) > 0.97


def test_probabilities_equal_the_definition(corpus):
    vocabulary = ["=scum", "idi", "2=scum"]
    chain = tx.Chain(["a", "b"], vocabulary, [np.array([1.0, 2.0, 4.0]), np.array([0.5, 0.0, 0.0, 3.0])], [-1.0, -2.0])
    got = chain(["scum scum idiot", "", None, "idiots Idiom"])
    sigmoid = lambda m: 1 / (1 + np.exp(-m))
    a = sigmoid(np.array([-1.0 + 1 + 2 + 4, -1, -1, -1 + 2]))
    b = sigmoid(-2.0 + np.array([0.5, 0, 0, 0]) + 3 * a)
    assert np.allclose(got, np.stack([a, b], axis=1))


def test_odd_rows(spark, corpus, odd_docs, no_docs):
    _, docs, labels = corpus
    more = spark.createDataFrame([(None, 1, 1), (5, None, 1), (10**9, 1, 1), (3, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    chain = tx.fit(docs.union(odd_docs.select("doc_id", "text")), labels.union(more), tx.CATEGORIES, kept=50)
    got = tx.predict(odd_docs, chain, list(tx.CATEGORIES)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r._tox.toxic <= 1 for r in got)
    assert tx.predict(no_docs, chain, list(tx.CATEGORIES)).count() == 0
    none = tx.fit(docs, labels.limit(0), tx.CATEGORIES)
    assert none is None and {r._tox.toxic for r in tx.predict(odd_docs, none, list(tx.CATEGORIES)).collect()} == {0.0}
    single = tx.fit(docs, labels.where("toxic = 0"), {"toxic": "toxic = 1"}, kept=20)
    assert all(r._tox.toxic == 0 or r._tox.toxic < 1e-9 for r in tx.predict(odd_docs, single, ["toxic"]).collect())


def test_query_returns_every_document(spark, sf):
    got = tx.op6_toxicity_chain(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id", suffixes=("", "_label"))
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (both.toxic == (both.toxic_label == 1)).mean() > 0.95
