"""Benchmark decontamination by an FM-index over each shard of the training text.

A word is a run of ASCII letters and digits and of characters from U+0080 up,
after lower-casing A-Z.  A test phrase is a window of ``width`` consecutive
words of a benchmark item, or the whole item if it has fewer words.

Each task cuts its documents into shards of bounded size.  Words outside the
benchmark's vocabulary cannot be part of an occurrence: they end a segment,
and segments shorter than the shortest phrase are dropped, which loses no
occurrence.  The rest of the shard, one symbol per word, is sorted into a
suffix array, from which the Burrows-Wheeler transform, a wavelet matrix over
it and every ``SAMPLE``-th suffix position are kept.  All phrases are searched
backwards at once through ranks in the wavelet matrix; occurrences are located
by stepping back to a sampled position, and their spans are merged.

The benchmark is read in blocks of at most ``block_words`` words (an item is
never cut), one broadcast at a time; between blocks the partial result is
written to the shared folder.

Edge cases: null texts have no words.  Benchmark items with a null id or no
words take no part; rows that repeat an item id count as one item.  An empty
benchmark leaves every document clean.  Repeated documents each keep a row;
null ids stay null.  Extra columns pass through ``decontaminate`` unchanged;
working columns are named with a leading ``_dc_``.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 8
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a whole text; bytes from 0x80 up only occur inside non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling; only suffixes still tied are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    starts = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    step = 1
    while not starts.all():
        head = np.flatnonzero(starts)
        tied = np.repeat(np.diff(np.r_[head, n]) > 1, np.diff(np.r_[head, n]))
        at = np.flatnonzero(tied)
        here = order[at]
        after = np.where(here + step < n, rank[np.minimum(here + step, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[here]))
        here, after = here[by], after[by]
        order[at] = here
        same = np.r_[False, (rank[here][1:] == rank[here][:-1]) & (after[1:] == after[:-1])]
        starts[at] = ~same
        rank[here] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))[at]
        step *= 2
    return order


class FMIndex:
    """Burrows-Wheeler transform of ``symbols`` (1 and up) with wavelet-matrix ranks."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        text = np.r_[symbols, 0].astype(np.int64)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n, self.levels = len(text), max(1, int(text.max()).bit_length())
        self.before = np.r_[0, np.cumsum(np.bincount(text))]
        kept = order % sample == 0
        self.sampled, self.samples = np.r_[0, np.cumsum(kept)], order[kept]
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)])
            self.zeros.append(self.n - int(bit.sum()))
            bwt = np.r_[bwt[bit == 0], bwt[bit == 1]]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before row ``at`` of the transform."""
        low = np.zeros_like(at)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit, ones = (symbol >> level) & 1, self.ones[k]
            low = np.where(bit, self.zeros[k] + ones[low], low - ones[low])
            at = np.where(bit, self.zeros[k] + ones[at], at - ones[at])
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        found = np.zeros_like(at)
        for k in range(self.levels):
            ones = self.ones[k]
            bit = ones[at + 1] - ones[at]
            found = 2 * found + bit
            at = np.where(bit, self.zeros[k] + ones[at], at - ones[at])
        return found

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases (left-aligned rows of symbols) by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for k in range(phrases.shape[1]):
            alive = np.flatnonzero((lengths > k) & (low < high))
            if not len(alive):
                break
            c = phrases[alive, lengths[alive] - 1 - k].astype(np.int64)
            known = c < len(self.before) - 1
            low[alive[~known]] = high[alive[~known]] = 0
            alive, c = alive[known], c[known]
            low[alive] = self.before[c] + self.rank(c, low[alive])
            high[alive] = self.before[c] + self.rank(c, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of transform rows: step back until a sampled position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        position = np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = rows[todo]
            hit = self.sampled[here + 1] > self.sampled[here]
            done = todo[hit]
            position[done] = self.samples[self.sampled[here[hit]]] + steps[done]
            todo, here = todo[~hit], here[~hit]
            c = self.symbol(here)
            rows[todo] = self.before[c] + self.rank(c, here)
            steps[todo] += 1
        return position


class Phrases:
    """Distinct windows of a block of benchmark items, and the items of each.

    Only the items' word numbers travel; each worker makes the windows from them when it first needs them.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 2)
        self.width, self.names = width, [name for name, _ in items]
        self.sizes = np.array([len(text) for _, text in items], np.int64)
        self.ids = np.fromiter((number(w) for _, text in items for w in text), np.int32, int(self.sizes.sum()))
        self.shortest, self.windows = int(min(width, self.sizes.min())), int(np.maximum(1, self.sizes - width + 1).sum())
        self.symbols = None

    def __getstate__(self):
        return self.__dict__ | {"symbols": None, "lengths": None, "item_at": None, "item_of": None}

    def build(self) -> "Phrases":
        """``symbols`` (left-aligned windows), ``lengths``, and the items of window p: item_of[item_at[p]:item_at[p + 1]]."""
        if self.symbols is not None:
            return self
        each = np.maximum(1, self.sizes - self.width + 1)
        item = np.repeat(np.arange(len(each)), each)
        start = np.repeat(np.cumsum(self.sizes) - self.sizes - (np.cumsum(each) - each), each) + np.arange(len(item))
        length = np.minimum(self.sizes, self.width)[item]
        place = np.arange(self.width)
        padded = np.r_[self.ids, np.zeros(self.width, np.int32)]
        rows = np.where(place < length[:, None], padded[start[:, None] + place], 0).astype(np.int32)
        self.symbols, of = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.symbols > 0).sum(axis=1)
        pairs = np.unique(of.reshape(-1).astype(np.int64) * len(each) + item)
        self.item_of = (pairs % len(each)).astype(np.int32)
        self.item_at = np.searchsorted(pairs // len(each), np.arange(len(self.symbols) + 1))
        return self

    def items(self, window: int) -> list[str]:
        return [self.names[i] for i in self.item_of[self.item_at[window]:self.item_at[window + 1]]]


def _segments(ids: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Runs of words of the vocabulary that are long enough to hold a phrase."""
    edge = np.flatnonzero(np.diff(np.r_[0, (ids > 0).astype(np.int8), 0]))
    return [(a, b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= shortest]


def search_shard(texts: list[np.ndarray], phrases: Phrases) -> dict[int, tuple[list[list[int]], set[str]]]:
    """For each document with occurrences: merged word spans [from, to) and items.

    ``texts``: for each document its words' numbers in the vocabulary, 0 if none.
    """
    parts, owner, origin = [], [], []
    for d, ids in enumerate(texts):
        for a, b in _segments(ids, phrases.shortest):
            parts += [ids[a:b], [1]]  # 1 ends a segment and is in no phrase
            owner.append(np.full(b - a + 1, d))
            origin.append(np.arange(a, b + 1))
    if not parts:
        return {}
    phrases.build()
    index = FMIndex(np.concatenate(parts))
    owner, origin = np.concatenate(owner), np.concatenate(origin)
    low, high = index.search(phrases.symbols, phrases.lengths)
    which = np.repeat(np.arange(len(low)), high - low)
    rows = np.concatenate([np.arange(a, b) for a, b in zip(low, high) if a < b] or [np.empty(0, np.int64)])
    at = index.locate(rows)
    found: dict[int, tuple[list[list[int]], set[str]]] = {}
    by = np.lexsort((origin[at], owner[at]))
    for d, start, p in zip(owner[at][by].tolist(), origin[at][by].tolist(), which[by].tolist()):
        spans, items = found.setdefault(d, ([], set()))
        stop = start + int(phrases.lengths[p])
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([start, stop])
        items.update(phrases.items(p))
    return found


def _blocks(benchmark: DataFrame, width: int, block_words: int, id_col: str, text_col: str):
    """Phrases of successive blocks of items; one block at a time is on the driver."""
    rows = (benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
            .where("i is not null and t is not null"))
    items, held = [], 0
    for row in rows.toLocalIterator():
        if not (got := words(row["t"])):
            continue
        if items and held + len(got) > block_words:
            yield Phrases(items, width)
            items, held = [], 0
        items.append((row["i"], got))
        held += len(got)
    if items:
        yield Phrases(items, width)


def occurrences(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 10,
                id_col: str = "item_id", bench_text: str = "text", shard_words: int = 1 << 19,
                block_words: int = 400_000) -> DataFrame:
    """``docs`` with _dc_words (long), _dc_spans (merged word spans) and _dc_items (sorted ids)."""
    added = "_dc_words long, _dc_spans array<array<int>>, _dc_items array<string>"
    out = docs.withColumns({"_dc_words": F.lit(None).cast("long"),
                            "_dc_spans": F.expr("cast(array() as array<array<int>>)"),
                            "_dc_items": F.expr("cast(array() as array<string>)")})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    held = None
    for phrases in _blocks(benchmark, width, block_words, id_col, bench_text):
        if held is not None:
            out = stored(out, "decontaminate")
            held.unpersist()
        held = docs.sparkSession.sparkContext.broadcast(phrases)
        out = out.mapInArrow(_searcher(held, text_col, shard_words), f"{fields}, {added}")
    if held is None:  # no benchmark: only count words
        none = docs.sparkSession.sparkContext.broadcast(None)
        out = out.mapInArrow(_searcher(none, text_col, shard_words), f"{fields}, {added}")
    return out


def _searcher(phrases, text_col: str, shard_words: int):
    def run(batches):
        import pyarrow as pa
        block = phrases.value
        # every shard is asked for every window: larger blocks of windows get larger shards
        most_words = max(shard_words, 2 * block.windows) if block else shard_words
        number = (block.vocabulary if block else {}).get

        def finish(waiting):
            found = search_shard([ids for _, texts in waiting for ids in texts], block) if block else {}
            first = 0
            for part, texts in waiting:
                spans, items = part.column("_dc_spans").to_pylist(), part.column("_dc_items").to_pylist()
                for k in range(len(texts)):
                    if first + k in found:
                        more, names = found[first + k]
                        spans[k] = _merge(spans[k] + more)
                        items[k] = sorted(names.union(items[k]))
                first += len(texts)
                at = part.schema.get_field_index
                yield (part.set_column(at("_dc_words"), "_dc_words", pa.array([len(t) for t in texts], pa.int64()))
                       .set_column(at("_dc_spans"), "_dc_spans", pa.array(spans, pa.list_(pa.list_(pa.int32()))))
                       .set_column(at("_dc_items"), "_dc_items", pa.array(items, pa.list_(pa.string()))))

        waiting, held = [], 0
        for batch in batches:
            for cut in range(0, batch.num_rows, 128):
                part = batch.slice(cut, 128)
                texts = []
                for text in part.column(text_col).to_pylist():
                    got = words(text)
                    texts.append(np.fromiter((number(w, 0) for w in got), np.int32, len(got)))
                held += sum(map(len, texts)) + part.get_total_buffer_size() // 64
                waiting.append((part, texts))
                if held >= most_words:
                    yield from finish(waiting)
                    waiting, held = [], 0
        if waiting:
            yield from finish(waiting)
    return run


def _merge(spans: list[list[int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def remove_spans(text: str, spans: list[list[int]]) -> str:
    """``text`` without the characters from each span's first word to its last."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    kept, done = [], 0
    for a, b in spans:
        kept.append(text[done:at[a][0]])
        done = at[b - 1][1]
    return "".join([*kept, text[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with benchmark passages cut from the text; a document with no word left goes."""
    found = occurrences(docs, benchmark, text_col, **options)

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: remove_spans(t, [list(x) for x in s]) if len(s) else t)

    hit = F.size("_dc_spans") > 0
    left = F.when(hit, cut(F.col(text_col), F.col("_dc_spans"))).otherwise(F.col(text_col))
    return (found.where(~hit | (F.element_at("_dc_spans", 1)[0] > 0)
                        | (F.element_at("_dc_spans", 1)[1] < F.col("_dc_words")))
            .withColumn(text_col, left).drop("_dc_words", "_dc_spans", "_dc_items"))


def op1_benchmark_decontamination(spark, sf_dir):
    """Occurrences of ``benchmark`` windows of ten words in all ``documents``."""
    from .common import table
    found = occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"),
                        table(spark, sf_dir, "benchmark"), width=10)
    hits = F.aggregate("_dc_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", F.col("_dc_words").alias("n_words"), hits.alias("n_hit"),
                        F.size("_dc_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("_dc_items", ","), 256).alias("items_sha256"),
                        (F.size("_dc_spans") > 0).alias("contaminated"))
