"""Toxicity by a classifier chain over annotated categories.

Categories are predicted one after the other by logistic regressions.  Each
sees the words of the text and the probabilities of the categories before it.
While training, those are out-of-fold: the rows of a fold get their
probability from a model fitted on the other folds, so a later model learns
from probabilities as uncertain as those it will meet.  At prediction the
chain runs with models fitted on the whole sample.

Text features are the presence, and the repeated presence, of a word or of a
word's beginning (three to six letters, which inflected and compounded words
share).  Of the features in the sample those with the largest chi-squared
against any category are kept.  The sample is at most ``sample`` labelled
documents chosen by hash; prediction reads every whole text.

Edge cases: null and empty texts have no features and get the chain's base
rates.  Labels that are null or belong to no document are ignored; a document
labelled several times has a category if any of its labels say so.  A category
without positive or without negative rows gets the constant 0 or 1, and with no
labels at all every probability is 0.  Null ids are kept, repeated rows stay,
an empty table gives no rows.  Extra columns pass through ``predict``, whose
working column is named ``_tox``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)


def word_features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def count_features(text: str | None) -> dict[str, int]:
    counts: dict[str, int] = {}
    for word in _WORD.findall((text or "").lower()):
        for f in word_features(word):
            counts[f] = counts.get(f, 0) + 1
    return counts


class Vocabulary:
    """Numbers of the kept features; texts to sorted feature numbers."""

    def __init__(self, kept: list[str], remembered: int = 150_000):
        # "f" stands for the presence of f, "2f" for two places or more
        self.number = {f: k for k, f in enumerate(kept)}
        self.known: dict[str, tuple[str, ...]] = {}
        self.remembered = remembered
        self.wanted = {f.removeprefix("2") for f in kept}

    def __call__(self, text: str | None) -> list[int]:
        counts: dict[str, int] = {}
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        for word in _WORD.findall((text or "").lower()):
            found = known.get(word)
            if found is None:
                found = known[word] = tuple(f for f in word_features(word) if f in self.wanted)
            for f in found:
                counts[f] = counts.get(f, 0) + 1
        names = [f for f in counts] + ["2" + f for f, n in counts.items() if n > 1]
        return sorted(self.number[f] for f in names if f in self.number)


def choose_features(rows: DataFrame, categories: list[str], kept: int, least: int = 4) -> list[str]:
    """The ``kept`` features (in ``least`` documents or more) with the largest chi-squared against a category."""
    def run(frames):
        for frame in frames:
            total: dict[str, list[int]] = {}
            labels = frame[categories].to_numpy(int)
            for text, label in zip(frame["text"], labels):
                for f, n in count_features(text if isinstance(text, str) else None).items():
                    for name in (f, "2" + f) if n > 1 else (f,):
                        got = total.setdefault(name, [0] * (1 + len(categories)))
                        got[0] += 1
                        for k, y in enumerate(label):
                            got[k + 1] += int(y)
            if total:
                yield pd.DataFrame([(f, *c) for f, c in total.items()], columns=["f", "n", *categories])

    parts = rows.mapInPandas(run, "f string, n long, " + ", ".join(f"`{c}` long" for c in categories))
    sums = parts.groupBy("f").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in categories)).where(F.col("n") >= least)
    size = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in categories)).first()

    def chi2(c: str) -> Column:
        total, positive = float(size["n"]), float(size[c] or 0)
        joint = F.col(c) * total - F.col("n") * positive
        return F.coalesce(F.try_divide(joint * joint, F.col("n") * (total - F.col("n")) * positive * (total - positive)), F.lit(0.0))

    score = F.greatest(*(chi2(c) for c in categories), F.lit(0.0))
    return [r["f"] for r in sums.withColumn("score", score).orderBy(F.desc("score"), "f").limit(kept).collect()]


class Chain:
    """Fitted chain: for each category a weight per feature and per earlier category, and an intercept."""

    def __init__(self, categories: list[str], kept: list[str], weights: list[np.ndarray], intercepts: list[float]):
        self.categories, self.vocabulary = categories, Vocabulary(kept)
        self.weights, self.intercepts = weights, intercepts

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.categories)))
        size = len(self.vocabulary.number)
        found = [self.vocabulary(t) for t in texts]
        for k, (w, b) in enumerate(zip(self.weights, self.intercepts)):
            margin = np.array([w[f].sum() for f in found]) + b + out[:, :k] @ w[size:]
            out[:, k] = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return out


def _linear(rows: DataFrame, category: str, regularization: float, lasso: float):
    """(model or None, constant): logistic regression, or the only class there is."""
    sums = rows.agg(F.count(F.lit(1)), F.sum(category)).first()
    if not sums[0] or sums[1] in (0, sums[0]):
        return None, float(bool(sums[1]))
    return LogisticRegression(labelCol=category, regParam=regularization, elasticNetParam=lasso, maxIter=30,
                              tol=1e-5, standardization=False,
                              probabilityCol="probability").fit(rows.coalesce(2)), 0.0  # a bounded sample: few, large tasks


def _append(vector: Column, value: Column, size: int) -> Column:
    """``vector`` with one more element."""
    @F.udf(VectorUDT())
    def longer(v, p):
        return Vectors.sparse(size + 1, [*v.indices.tolist(), size], [*v.values.tolist(), float(p)])
    return longer(vector, value)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text",
        sample: int = 8000, kept: int = 1500, folds: int = 3, regularization: float = 3e-4,
        lasso: float = 0.7) -> Chain | None:
    """Chain over ``categories`` (name -> SQL condition over ``labels``, in order) from at most ``sample`` documents."""
    names = list(categories)
    chosen = (labels.select(F.col(id_col).alias("_key"), *(F.expr(sql).cast("double").alias(c) for c, sql in categories.items()))
              .dropna().groupBy("_key").agg(*(F.max(c).alias(c) for c in names))
              .orderBy(F.xxhash64("_key"), "_key").limit(sample))
    chosen = stored(chosen, "labels")
    # a bounded table: at most ``sample`` narrow rows
    texts = (docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("text"))
             .join(F.broadcast(chosen), "_key").dropna(subset=["text"]).dropDuplicates(["_key"]))
    rows = stored(texts.repartition(12), "labelled")
    if rows.isEmpty():
        return None
    features = choose_features(rows.select("text", *names), names, kept)
    vocabulary, size = Vocabulary(features), len(features)

    def vectors(frames):
        for frame in frames:
            frame["at"] = [vocabulary(t) for t in frame["text"]]
            yield frame.drop(columns="text")

    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("at", T.ArrayType(T.IntegerType()))])
    sparse = F.udf(lambda at: Vectors.sparse(size, at, [1.0] * len(at)), VectorUDT())
    rows = stored(rows.mapInPandas(vectors, schema).coalesce(6), "vectors").select(
        *names, sparse("at").alias("features"), F.pmod(F.xxhash64("_key"), F.lit(folds)).alias("fold"))
    rows = stored(rows, "chain")
    weights, intercepts = [], []
    for k, category in enumerate(names):
        model, constant = _linear(rows, category, regularization, lasso)
        weights.append(np.zeros(size + k) if model is None else model.coefficients.toArray())
        intercepts.append(model.intercept if model else (500.0 if constant else -500.0))
        if k + 1 == len(names):
            break
        parts = []
        for fold in range(folds):
            other, held = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
            model, constant = _linear(other, category, regularization, lasso)
            if model is None:
                held = held.withColumn("p", F.lit(constant))
            else:
                held = (model.transform(held).withColumn("p", vector_to_array("probability")[1])
                        .drop("rawPrediction", "probability", "prediction"))
            parts.append(held)
        joined = parts[0]
        for part in parts[1:]:
            joined = joined.unionByName(part)
        rows = stored(joined.withColumn("features", _append(F.col("features"), F.col("p"), size + k)).drop("p").coalesce(6), "chain")
    return Chain(names, features, weights, intercepts)


def predict(docs: DataFrame, chain: Chain | None, categories: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` with ``_tox``: a struct of one probability per category."""
    kind = "struct<" + ", ".join(f"`{c}`: double" for c in categories) + ">"
    if chain is None:
        return docs.withColumn("_tox", F.struct(*(F.lit(0.0).alias(c) for c in categories)))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = chain(part.column(text_col).to_pylist())
                tox = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(categories))], categories)
                yield pa.RecordBatch.from_arrays([*part.columns, tox], [*part.schema.names, "_tox"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, _tox {kind}")


#: Categories that the table ``labels`` annotates, in the order of the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op6_toxicity_chain(spark, sf_dir):
    """Category probabilities of all ``documents`` by a chain fitted on ``labels``."""
    from .common import table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return predict(docs, chain, list(CATEGORIES)).select(
        "doc_id", *(F.col(f"_tox.{c}").alias(f"p_{c}") for c in CATEGORIES), (F.col("_tox.toxic") >= 0.5).alias("toxic"))
