"""Mixing sources to target weights by weighted fair queueing.

The budget is ``share`` of all words.  Sources in code point order, null last,
weigh ``weights``, repeating; a source's target is its part of the budget by
weight, at most ``repeats`` times its own words, and what it cannot take is
shared again by weight until no source is above its bound.  Targets become
whole words by cumulative rounding, so they add up to the budget.

Every source queues its documents in an order shuffled by a hash of their ids,
``repeats`` times over.  A document's virtual finish time is the number of
words that its source has queued up to its end, divided by the source's
target.  All queued documents are range-sorted by finish time over all sources
and the order is cut where its running total reaches the budget.  A document
still in service at virtual time 1, when its source has its target, is cut
there, so that one very long document cannot push the mix away from the
weights; documents that would start later lie beyond the budget and are not
sorted.

Running sums come from range-partitioned, sorted rows: a task sums its own
rows and a table with one row for each task and source carries the offsets, so
a source of any size spreads over tasks.  The number of sources is unbounded;
the driver sees sums over sources only.

Edge cases: a null text has no words, and a document without words takes none.
A null source is a source of its own; a null id is kept.  Rows equal in id and
size are separate documents, interchangeable in the result.  An empty table
gives no rows; without any words all targets are 0.  Only the id, text and
source columns are read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import positions, stored

WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, group: str | None, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: sum of ``value`` (long) over the rows before this one, in ``order``, within ``group`` (a long)."""
    keys = [group, *order] if group else order
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, of = df.columns.index(value), df.columns.index(group) if group else None

    def run(batches):
        import pyarrow as pa
        last, carry = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            value_ = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(value_) - value_
            if of is None:
                out = before + carry
                carry = int(out[-1] + value_[-1])
            else:
                key = batch.column(of).to_numpy(zero_copy_only=False)
                new = np.r_[True, key[1:] != key[:-1]]
                run_of = np.cumsum(new) - 1
                out = before - before[new][run_of]
                if key[0] == last:
                    out[run_of == 0] += carry
                last, carry = key[-1], int(out[-1] + value_[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ranged = stored(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, f"{schema}, `{name}` long")
                    .withColumn("_task", F.spark_partition_id()), f"running-{name}")
    by = ["_task", *([group] if group else [])]
    sums = ranged.groupBy(*by).agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task and group
    sums = sums.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (ranged.join(sums, by).select(*df.columns, (F.col(name) + F.col("_base")).alias(name)))


def _bound(high: Fraction, repeats: int):
    """Whether a source's part at this level reaches ``repeats`` times its words, in exact whole numbers."""
    most = (F.col("words") * repeats).cast("decimal(20,0)") * F.lit(high.denominator).cast("decimal(18,0)")
    return most <= F.lit(high.numerator).cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")


def level(sources: DataFrame, budget: int, repeats: int) -> Fraction:
    """Words for each unit of weight, so that min(weight * level, repeats * words) adds up to ``budget``."""
    now = Fraction(0)
    while True:
        # sources bound at the present level stay bound: it only rises
        bound = _bound(now, repeats)
        got = sources.groupBy(bound.alias("bound")).agg(F.sum(F.col("words").cast("decimal(38,0)")).alias("words"),
                                                        F.sum("weight").alias("weight")).collect()
        taken = repeats * sum(int(r["words"]) for r in got if r["bound"])
        weight = sum(int(r["weight"]) for r in got if not r["bound"])
        following = Fraction(budget - taken, weight) if weight else now
        if following <= now:
            return now
        now = following


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, share: Fraction | int = 1) -> DataFrame:
    """(source, rank, words, target, quota) for each source of ``sized`` (source, size)."""
    sources = positions(sized.groupBy("source").agg(F.sum("size").alias("words")).withColumn("last", F.col("source").isNull()),
                        [], ["last", "source"], "rank").drop("last")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    sources = stored(sources.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long")),
                     "sources")
    budget = int(Fraction(share) * int(sources.agg(F.sum(F.col("words").cast("decimal(38,0)"))).first()[0] or 0))
    high = level(sources, budget, repeats)
    bound = _bound(high, repeats)
    parts = sources.withColumns({
        "free": F.when(bound, 0).otherwise(F.col("weight")).cast("long"),
        "whole": F.when(bound, F.col("words") * repeats).otherwise(0).cast("long"),
        "target": F.when(bound, (F.col("words") * repeats).cast("double")).otherwise(
            F.element_at(F.array(*[F.lit(float(high * w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))})
    parts = running(parts, None, ["rank"], "free", "free_before")
    words = lambda c: F.expr(f"cast(({c}) * cast({high.numerator} as decimal(30,0)) div cast({high.denominator} as decimal(20,0)) as long)")
    quota = F.col("whole") + words("free_before + free") - words("free_before")
    return stored(parts.select("source", "rank", "words", "target", quota.alias("quota")), "targets")


def schedule(sized: DataFrame, sources: DataFrame, repeats: int = 3) -> DataFrame:
    """The mix in order: (_k, rank, repeat, words, finish, offset); ``sized`` has _k, id, source and size.

    ``offset`` is the number of words before this document's in the mix.
    """
    known = sources if sources.count() > 200_000 else F.broadcast(sources)  # at most 200,000 rows are broadcast
    queued = (sized.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("of")))
              .select("_k", "rank", "size", "words", "target", "quota",
                      F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("id").cast("string"), F.lit("-")))), 1, 15),
                             16, 10).cast("long").alias("shuffle"), F.col("id").cast("string").alias("tie")))
    queued = running(queued, "rank", ["shuffle", "tie", "size", "_k"], "size", "before")
    start = F.expr("repeat * words + before")
    entries = (queued.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
               .where(start < F.col("quota"))
               .withColumn("take", F.least(F.col("size"), F.col("quota") - start))
               .withColumn("finish", F.least(F.lit(1.0), (start + F.col("take")) / F.col("target")))
               .select("_k", "rank", "repeat", "take", "finish", start.alias("start")))
    mix = running(entries, None, ["finish", "rank", "start"], "take", "offset")
    budget = int(sources.agg(F.sum("quota")).first()[0] or 0)
    return mix.where(F.col("offset") < budget).select(
        "_k", "rank", "repeat", F.least("take", F.lit(budget) - F.col("offset")).alias("words"), "finish", "offset")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, share: Fraction | int = 1) -> DataFrame:
    """(id, size, source_size, target, taken, quota, repeats_begun) for every row; ``schedule`` has the order of the mix."""
    sized = stored(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        .withColumn("_k", F.monotonically_increasing_id()), "sized")
    sources = targets(sized, weights, repeats, share).withColumnRenamed("source", "of")
    taken = schedule(sized, sources, repeats).groupBy("_k").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("begun"))
    known = sources if sources.count() > 200_000 else F.broadcast(sources)
    return (sized.join(taken, "_k", "left").join(known, F.col("source").eqNullSafe(F.col("of")))
            .select(F.col("id").alias(id_col), "size", F.col("words").alias("source_size"), "target",
                    F.coalesce("taken", F.lit(0)).alias("taken"), "quota",
                    F.coalesce("begun", F.lit(0)).alias("repeats_begun")))


def op13_mixing(spark, sf_dir):
    """All ``documents`` mixed to weights 1, 2, 3 over their sources, every word budgeted once."""
    from .common import table
    return mix(table(spark, sf_dir, "documents"))
