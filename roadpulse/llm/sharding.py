"""Sharding by the minimax contiguous partition of ordered atomic groups.

Rows with equal texts form one atomic group.  Groups stand in the order of
their text's hash; the groups of a shard are contiguous in that order.  The
smallest feasible capacity is found by binary search, each candidate checked
by greedy filling, and the shards are cut where greedy filling at that
capacity cuts.

The driver never sees all groups.  Consecutive groups are summed into blocks
by leading hash bits.  Greedy filling that treats every block as divisible
bounds the capacity from below, greedy filling that treats it as atomic
bounds it from above; only blocks in which a cut can still fall are split
further, until those are single groups and both bounds meet.

Edge cases: a null text has no bytes, so size 1 and checksum 0, and counts as
equal to the empty text.  Null ids are kept.  Repeated rows are separate rows
of one group.  An empty table gives no rows.  With fewer groups than shards
the last shards stay empty.  Columns other than the id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, stored

FIRST, FINER = 14, 6  # hash bits of the first blocks, and bits that each refinement adds


def _greedy(sums: list[int], atomic: list[bool], capacity: int, shards: int, divisible: bool) -> list[float] | None:
    """Where each shard ends (block index, fractional when inside one), or None if ``shards`` do not suffice."""
    total, cuts, start = sums[-1], [], 0
    for _ in range(shards):
        reach = start + capacity
        if reach >= total:
            return [*cuts, *[float(len(atomic))] * (shards - len(cuts))]
        k = bisect_right(sums, reach) - 1  # whole blocks that fit
        if divisible and not atomic[k]:
            cuts.append(k + (reach - sums[k]) / (sums[k + 1] - sums[k]))
            start = reach
        else:
            cuts.append(float(k))
            start = sums[k]
    return None


def _least(sums, atomic, shards, divisible) -> int:
    low, high = 0, sums[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy(sums, atomic, middle, shards, divisible) is None:
            low = middle + 1
        else:
            high = middle
    return low


def cut_points(groups: DataFrame, shards: int, first_bits: int = FIRST, bits: int = FINER) -> list[str]:
    """Last group key of each shard but the last that has rows.

    ``groups``: key (64 binary digits of the hash, then the digest) and size.
    """
    def blocks(within: list[str] | None, length: int) -> list[tuple[str, int, int, str]]:
        rows = groups
        if within is not None:
            rows = rows.where(F.substring("key", 1, length - bits).isin(within))
        return sorted(tuple(r) for r in rows.groupBy(F.substring("key", 1, length).alias("head")).agg(
            F.sum("size"), F.count(F.lit(1)), F.max("key")).collect())

    length = first_bits
    now = blocks(None, length)
    while True:
        sums = [0]
        for _, size, _, _ in now:
            sums.append(sums[-1] + int(size))
        atomic = [n == 1 for _, _, n, _ in now]
        if not now:
            return []
        low, high = _least(sums, atomic, shards, True), _least(sums, atomic, shards, False)
        # cuts only move right as the capacity grows, and divisible blocks reach at least as far
        first, last = _greedy(sums, atomic, low, shards, False), _greedy(sums, atomic, high, shards, True)
        if first is None:  # at ``low`` atomic filling runs out of shards: take its cuts up to there
            first = _prefix(sums, low, shards)
        open_ = sorted({k for a, b in zip(first, last) for k in range(int(a), min(int(b) + 1, len(now)))
                        if not atomic[k]})
        if not open_:
            cuts = _greedy(sums, atomic, high, shards, False)
            return [now[int(c) - 1][3] for c in cuts if 0 < c < len(now)]
        length += bits
        if length > 64 + 64 * 4:
            raise ValueError("group keys are not distinct")
        finer: dict[str, list] = {}
        heads = [now[k][0] for k in open_]
        for row in blocks(heads, length):
            finer.setdefault(row[0][:length - bits], []).append(row)
        split = set(open_)
        # blocks without a possible cut keep their sum; their heads stay shorter but in order
        now = [x for k, row in enumerate(now)
               for x in (finer[row[0]] if k in split else [row])]


def _prefix(sums: list[int], capacity: int, shards: int) -> list[float]:
    cuts, start = [], 0
    for _ in range(shards):
        k = bisect_right(sums, start + capacity) - 1
        cuts.append(float(min(k, len(sums) - 1)))
        start = sums[min(k, len(sums) - 1)]
    return cuts


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row, sizes near equal."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.lpad(F.bin(F.xxhash64(text)), 64, "0"), F.sha2(text, 256)).alias("key")), "sizes")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    ends = cut_points(groups, shards)
    number = F.lit(0)
    for end in ends:
        number = number + (F.col("key") > F.lit(end)).cast("int")
    placed = positions(rows.withColumn("shard", number), ["shard"], ["key", "id"], "slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark, sf_dir):
    """All ``documents`` into 16 shards of nearly equal bytes."""
    from .common import table
    return shard(table(spark, sf_dir, "documents"), 16)
