"""Sequence packing as a cutting-stock problem solved by column generation.

Every document becomes its token ids plus an end id.  Full sequences are cut
off the front; the rest is one piece.  The histogram of piece lengths is the
demand of a cutting-stock linear program over classes of lengths: exact up to
128 tokens, above that at most a 64th of the length and at most ``grain``
tokens wide, rounded up; capacity is counted in tokens.  A column is a pattern
(how many pieces of each class one sequence takes), the restricted program is
solved by the revised simplex method, and an unbounded-knapsack dynamic program
over the dual prices finds the next column until none helps.  The solution is
rounded down, the rest of the demand is filled by first-fit-decreasing
patterns.  Only this histogram (at most capacity rows) reaches the driver;
pieces are ranked within their class in Spark and take the pattern places of
their rank.

What room is left goes to cut pieces: with T tokens in all, the fullest
ceil(T / capacity) sequences stay, the pieces of the others are laid end to
end along the rooms of those that stay, and are cut where a room ends.  All
sequences but the last are then full, and only pieces of the dissolved
sequences are cut; their documents are encoded once more for the checksums of
the parts, so no ids are ever stored.

Edge cases: null and empty texts are the end id alone.  A null id is kept.
Repeated rows are separate documents.  An empty table gives no rows.  Special
token strings in a text are read as the tokenizer reads them by default.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, stored

PIECE = "start long, length long, ids_crc32 long, doc_tokens long"
COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte: itself, or the next free one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    The vocabulary drops white space and cuts at it, so the ids of a text are
    those of its white-space-separated chunks.  Chunks met before come from a
    bounded cache of two generations: what was met since the last change of
    generation, and before it what was met in the one before.  The vocabulary's splitting rule cuts a chunk into runs of
    letters, single digits and runs of other signs, and each piece is merged on its own: a new
    chunk of ASCII signs and Latin letters is cut that way here and its new pieces go to the
    merge model alone.  Chunks with an apostrophe (contractions), a special
    token's mark or any other sign go to the whole tokenizer.
    """

    _ASCII = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
    _LATIN = re.compile(r"[^\W\d_]+|[0-9]|[\W_]+")
    _NON_ASCII = re.compile(r"[^\x00-\x7f]+")

    def __init__(self, path: str, cached: int = 600_000):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer, self.cached, self.known = Tokenizer.from_file(path), cached, {}
        self.old: dict[bytes, bytes] = {}
        self.model, self.signs = self.tokenizer.model, _byte_signs()

    def _pieces(self, chunk: bytes) -> list[bytes] | None:
        """The chunk's pieces in lower case; None if the rule here does not cover it."""
        if b"'" in chunk or b"<|" in chunk:
            return None
        if chunk.isascii():
            return self._ASCII.findall(chunk.lower())
        text = chunk.decode()
        others = "".join(self._NON_ASCII.findall(text))
        if not others.isalpha() or max(others) >= "\u0250" or "\u0130" in others:
            return None
        return [p.encode() for p in self._LATIN.findall(text.lower())]

    def _merged(self, piece: bytes) -> bytes:
        """Ids of one piece."""
        got = self.known.get(piece) or self.old.get(piece)
        if got is None:
            signs = piece.decode("latin-1")
            ids = [t.id for t in self.model.tokenize(signs if piece.isalnum() else signs.translate(self.signs))]
            got = self.known[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def _learn(self, chunks: set[bytes]) -> None:
        known, old, merged, odd = self.known, self.old.get, self._merged, []
        for chunk in chunks:
            if (ids := old(chunk)) is not None:
                known[chunk] = ids
                continue
            core = chunk if chunk.isalpha() else chunk.rstrip(b".,;:!?")
            if core.isalpha():  # ASCII letters only, the usual case
                ids = merged(core.lower())
                known[chunk] = ids if core is chunk else ids + merged(chunk[len(core):])
            elif (pieces_ := self._pieces(chunk)) is None:
                odd.append(chunk)
            else:
                known[chunk] = b"".join([merged(p) for p in pieces_])
        if odd:
            for chunk, got in zip(odd, self.tokenizer.encode_batch_fast([c.decode() for c in odd], add_special_tokens=False)):
                known[chunk] = np.array(got.ids, "<u4").tobytes()

    def __call__(self, texts: list[str | bytes | None]) -> list[bytes]:
        """Ids of each text; bytes are UTF-8."""
        if 2 * len(self.known) > self.cached:
            self.known, self.old = {}, self.known
        chunks, ends = [], []
        for text in texts:
            chunks += (text if isinstance(text, bytes) else (text or "").encode()).split()
            ends.append(len(chunks))
        ids = list(map(self.known.get, chunks))
        if None in ids:
            new = [i for i, got in enumerate(ids) if got is None]
            self._learn({chunks[i] for i in new})
            for i in new:
                ids[i] = self.known[chunks[i]]
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends)]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept while the worker is reused."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): a row's id, its text in UTF-8 and the text's hash; rows equal in id and text are interchangeable."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """(id, h, start, length, ids_crc32, doc_tokens): full sequences and one rest for each row."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        encode = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, cols = [], ([], [], [], [])
                for i, ids in enumerate(encode(part.column(2).to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        piece = ids[4 * start:4 * (start + capacity)]
                        row.append(i)
                        for c, v in zip(cols, (start, len(piece) // 4, zlib.crc32(piece), total)):
                            c.append(v)
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), *(pa.array(c, pa.int64()) for c in cols)],
                    ["id", "h", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _rows(docs, id_col, text_col).mapInArrow(run, f"id {kind}, h long, {PIECE}")


def checksums(docs: DataFrame, parts: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int,
              most_broadcast: int = 100_000) -> DataFrame:
    """``parts`` (id, h, start, length, ...) with ids_crc32; only the documents that have parts are encoded again.

    Their keys and cuts are broadcast if they are at most ``most_broadcast`` parts, so that no text is shuffled.
    """
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    spans = parts.groupBy("id", "h").agg(F.collect_set(F.struct("start", "length")).alias("spans"))  # one text's own cuts
    if parts.count() <= most_broadcast:
        spans = F.broadcast(spans)
    texts = _rows(docs, id_col, text_col).withColumnsRenamed({"id": "id_", "h": "h_"})
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))

    def run(batches):
        import pyarrow as pa
        encode = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, cols = [], ([], [], [])
                for i, (ids, own) in enumerate(zip(encode(part.column(2).to_pylist()), part.column(3).to_pylist())):
                    ids += end
                    for span in own:
                        start, length = span["start"], span["length"]
                        row.append(i)
                        for c, v in zip(cols, (start, length, zlib.crc32(ids[4 * start:4 * (start + length)]))):
                            c.append(v)
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), *(pa.array(c, pa.int64()) for c in cols)],
                    ["id_", "h_", "start", "length", "ids_crc32"])

    found = (texts.join(spans, same).select("id", "h", "text", "spans")
             .mapInArrow(run, f"id_ {kind}, h_ long, start long, length long, ids_crc32 long")
             .groupBy("id_", "h_", "start", "length").agg(F.max("ids_crc32").alias("ids_crc32"))  # repeated rows agree
             .withColumnsRenamed({"start": "start_", "length": "length_"}))
    return parts.join(found, same & (F.col("start") == F.col("start_")) & (F.col("length") == F.col("length_"))
                      ).drop("id_", "h_", "start_", "length_")


def price(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over item sizes 1..n: for each room its best value, and the size taken last (0: none)."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for size in (np.flatnonzero(values[:capacity] > 0) + 1).tolist():
        # rooms in rows of ``size``: down a column each row has space for one more of this size
        rows = -(-(capacity + 1) // size)
        gain = values[size - 1] * np.arange(rows)[:, None]
        grid = np.zeros(rows * size)
        grid[:capacity + 1] = best
        offers = (np.maximum.accumulate(grid.reshape(rows, size) - gain) + gain).ravel()[:capacity + 1]
        better = offers > best + 1e-12
        best[better], took[better] = offers[better], size
    return best, took


def pattern(took: np.ndarray, room: int, length: int) -> np.ndarray:
    """Counts of the sizes that fill ``room`` best."""
    counts = np.zeros(length, int)
    while room > 0 and took[room]:
        counts[took[room] - 1] += 1
        room -= took[room]
    return counts


def first_fit(left: np.ndarray, capacity: int):
    """Patterns and how often each is used, first fit decreasing, until nothing is left of the demand."""
    left = left.astype(np.int64).copy()
    while left.any():
        counts, room = np.zeros(len(left), np.int64), capacity
        while room and (fit := np.flatnonzero(left[:room] > counts[:room])).size:
            size = int(fit[-1]) + 1
            take = min(room // size, int(left[size - 1] - counts[size - 1]))
            counts[size - 1] += take
            room -= take * size
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        left -= times * counts
        yield counts, times


class Program:
    """The restricted linear program: a basis of patterns, its inverse, amounts and costs."""

    def __init__(self, need: np.ndarray, each: np.ndarray):
        self.need, self.basis, self.inverse = need, np.diag(each.astype(float)), np.diag(1.0 / each)
        self.amount, self.cost, self.pivots = self.inverse @ need, np.ones(len(need)), 0

    def dual(self) -> np.ndarray:
        return self.cost @ self.inverse

    def enter(self, column: np.ndarray, price_of: float = 1.0) -> bool:
        """Put ``column`` in the basis; not if only a pivot near zero could make room for it."""
        way = self.inverse @ column
        ratio = np.full(len(way), np.inf)
        up = way > 1e-7
        ratio[up] = self.amount[up] / way[up]
        ties = np.flatnonzero(ratio <= ratio.min() * (1 + 1e-12) + 1e-12)
        out = int(ties[np.argmax(way[ties])])  # of equal ratios the largest pivot keeps the inverse accurate
        if not np.isfinite(ratio[out]):
            return False
        self.amount = np.maximum(self.amount - ratio[out] * way, 0)
        self.amount[out] = ratio[out]
        self.basis[:, out], self.cost[out] = column, price_of
        row = self.inverse[out] / way[out]
        self.inverse -= np.outer(way, row)
        self.inverse[out] = row
        self.pivots += 1
        if self.pivots % 100 == 0:
            self.inverse = np.linalg.inv(self.basis)
            self.amount = np.maximum(self.inverse @ self.need, 0)
        return True

    def offer(self, column: np.ndarray) -> bool:
        """Enter a pattern if it is worth more than a sequence at the present prices."""
        return bool(self.dual() @ column > 1 + 1e-9) and self.enter(column)


def generate(demand: np.ndarray, capacity: int, gap: float = 2e-3, several: int = 48, patience: int = 200
             ) -> tuple[list[tuple[np.ndarray, float]], np.ndarray]:
    """Patterns and amounts of the linear program's solution, by column generation, and prices.

    ``demand[s - 1]`` pieces of size s.  The basis starts with patterns of one
    size, and the patterns of first fit decreasing are offered first.  One dynamic
    program prices many columns: the best pattern around each size, of which
    the ``several`` most valuable ones are offered in turn.  The returned prices let no
    pattern be worth more than 1, so the demand at these prices is a lower
    bound on the sequences.  Prices are smoothed towards those with the best
    bound so far, which saves most of the pivots.  Stops when no column prices
    out or the bound is within ``gap`` of the value; the gap asked for
    doubles after every ``patience`` dynamic programs, so the search ends.
    """
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return [], np.empty(0)
    need = demand[sizes - 1].astype(float)
    lp = Program(need, capacity // sizes)
    for counts, _ in first_fit(demand, capacity):
        lp.offer(counts[sizes - 1].astype(float))
    best, bound = sizes / capacity, float(sizes @ need) / capacity
    values, tried = np.zeros(int(sizes.max())), 0
    while True:
        dual = lp.dual()
        for _ in range(len(sizes)):  # more than asked of a class: its surplus enters for nothing
            if dual.min() >= -1e-9:
                break
            column = np.zeros(len(sizes))
            column[int(np.argmin(dual))] = -1
            if not lp.enter(column, 0.0):
                break
            dual = lp.dual()
        entered = False
        for weight in (0.8, 0.0):
            trial = np.maximum(weight * best + (1 - weight) * dual, 0)
            values[sizes - 1] = trial
            filled, took = price(values, capacity)
            tried += 1
            worth = float(filled[capacity])
            if worth > 0 and float(trial @ need) / max(worth, 1) > bound:
                best, bound = trial / max(worth, 1), float(trial @ need) / max(worth, 1)
            around = trial + filled[capacity - sizes]
            seen = set()
            for k in np.argsort(-around, kind="stable")[:several]:
                counts = pattern(took, capacity - int(sizes[k]), len(demand))
                counts[sizes[k] - 1] += 1
                column = counts[sizes - 1].astype(float)
                if column.tobytes() not in seen:
                    seen.add(column.tobytes())
                    entered |= lp.offer(column)
            if entered:
                break
        value = float(lp.cost @ lp.amount)
        if not entered or value - bound <= gap * 2 ** (tried // patience) * value:
            break
    found = []
    for k in np.flatnonzero(lp.cost):
        counts = np.zeros(len(demand), int)
        counts[sizes - 1] = np.rint(lp.basis[:, k]).astype(int)
        found.append((counts, float(lp.amount[k])))
    return found, best


def whole_patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Integer pattern amounts that take all of ``demand``: the program rounded down, then first fit decreasing."""
    left, plan = demand.astype(np.int64).copy(), []
    for counts, amount in generate(demand, capacity)[0]:
        used = counts > 0
        times = min(int(amount + 1e-6), int((left[used] // counts[used]).min()) if used.any() else 0)
        if times:
            left -= times * counts
            plan.append((counts, times))
    return [*plan, *first_fit(left, capacity)]


def cut_to_fill(seated: DataFrame, capacity: int, block: int = 1 << 16) -> DataFrame:
    """``seated`` (id, h, PIECE, _k, sequence_id, offset) in the fewest sequences; a cut piece has no checksum yet.

    Sequences are placed by falling fill, so where a room or a dissolved
    sequence begins on the line follows from the histogram of fills.  The line
    is cut in blocks of ``block`` tokens; a task sees the intervals of one.
    """
    fill = stored(seated.groupBy("sequence_id").agg(F.sum("length").alias("used")), "fills")
    levels = sorted(((r["used"], r["count"]) for r in fill.groupBy("used").count().collect()), reverse=True)
    used, n = np.array(levels, np.int64).reshape(-1, 2).T  # at most capacity rows
    first = np.cumsum(n) - n
    keep = -(-int(used @ n) // capacity)
    # before each level: room of the sequences that stay, tokens of those dissolved
    stay = np.clip(keep - first, 0, n)
    room, loose = np.cumsum((capacity - used) * stay), np.cumsum(used * (n - stay))
    total = int(loose[-1]) if len(n) else 0
    if total == 0:
        return seated.select("id", "h", *COLUMNS)
    table = seated.sparkSession.createDataFrame(
        [tuple(map(int, r)) for r in zip(used, first, room - (capacity - used) * stay, loose - used * (n - stay),
                                         np.maximum(first, keep))],
        "used long, first long, room long, loose long, cut_from long")
    placed = (positions(fill, ["used"], ["sequence_id"], "nth").join(F.broadcast(table), "used")
              .withColumn("place", F.col("first") + F.col("nth")))
    placed = stored(placed.select(
        "sequence_id", "used", "place", F.when(F.col("place") < keep, F.expr(f"room + nth * ({capacity} - used)")).alias("room"),
        F.expr("loose + (place - cut_from) * used").alias("loose")), "places")
    pieces_ = seated.join(placed.drop("used"), "sequence_id")
    rooms = placed.where(f"place < {keep} and used < {capacity} and room < {total}").select(
        F.lit(0).alias("kind"), F.col("place").alias("key"), F.col("room").alias("lo"),
        F.least(F.expr(f"room + {capacity} - used"), F.lit(total)).alias("hi"), "used")
    moved = pieces_.where(f"place >= {keep}").select(
        F.lit(1).alias("kind"), F.col("_k").alias("key"), F.expr("loose + offset").alias("lo"),
        F.expr("loose + offset + length").alias("hi"), F.lit(0).cast("long").alias("used"))

    def match(frame):
        import pandas as pd
        at = int(frame["block"].iloc[0]) * block
        frame = frame.sort_values("lo")
        rest, piece = frame[frame["kind"] == 0], frame[frame["kind"] == 1]
        cuts = np.unique(np.maximum(frame["lo"].to_numpy(), at))
        ends = np.append(cuts[1:], min(at + block, total))
        to = rest.iloc[np.searchsorted(rest["lo"].to_numpy(), cuts, side="right") - 1]
        of = piece.iloc[np.searchsorted(piece["lo"].to_numpy(), cuts, side="right") - 1]
        return pd.DataFrame({"_k": of["key"].to_numpy(), "place": to["key"].to_numpy(), "skip": cuts - of["lo"].to_numpy(),
                             "n": ends - cuts, "at": to["used"].to_numpy() + cuts - to["lo"].to_numpy()})

    blocks = rooms.union(moved).withColumn("block", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")))
    # a part that crosses from one block to the next is one part
    parts = (blocks.groupBy("block").applyInPandas(match, "_k long, place long, skip long, n long, at long")
             .groupBy("_k", "place").agg(F.min("skip").alias("skip"), F.sum("n").alias("n"), F.min("at").alias("at")))
    moved = (pieces_.where(f"place >= {keep}").select("_k", "id", "h", "start", "length", "ids_crc32", "doc_tokens").join(parts, "_k")
             .select("id", "h", (F.col("start") + F.col("skip")).alias("start"), F.col("n").alias("length"),
                     F.when(F.col("n") == F.col("length"), F.col("ids_crc32")).alias("ids_crc32"), "doc_tokens",
                     F.col("place").alias("sequence_id"), F.col("at").alias("offset")))
    return pieces_.where(f"place < {keep}").select(
        "id", "h", *COLUMNS[:-2], F.col("place").alias("sequence_id"), "offset").unionByName(moved)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 4096, end_id: int = 2, grain: int = 16) -> DataFrame:
    """Pieces with sequence_id and offset; see the module's docstring."""
    wide = f"least({grain}, shiftleft(1, length(bin((length - 1) div 64)) - 1))"
    cut = stored(pieces(docs, tokenizer, id_col, text_col, capacity, end_id)
                 .withColumns({"size": F.expr(f"cast(least({capacity}, ceil(length / {wide}) * {wide}) as int)"),
                               "_k": F.monotonically_increasing_id()}), "pieces")
    demand = np.zeros(capacity, np.int64)
    for size, n in cut.groupBy("size").count().collect():  # at most capacity rows
        demand[size - 1] = n
    plan = whole_patterns(demand, capacity)
    # places of each class, in order of rank: from, per sequence, first sequence
    places: dict[int, list[tuple[int, int, int]]] = {}
    filled, first = np.zeros(len(demand), np.int64), 0
    for counts, times in plan:
        for k in np.flatnonzero(counts):
            places.setdefault(int(k) + 1, []).append((int(filled[k]), int(counts[k]), first))
            filled[k] += times * counts[k]
        first += times
    table = {size: np.array(rows, np.int64).T for size, rows in places.items()}

    def seat(frames):
        for frame in frames:
            sequence = np.zeros(len(frame), np.int64)
            sizes, ranks = frame["size"].to_numpy(), frame["rank"].to_numpy()
            for size in np.unique(sizes):
                at = sizes == size
                begin, each, base = table[int(size)]
                k = np.searchsorted(begin, ranks[at], side="right") - 1
                sequence[at] = base[k] + (ranks[at] - begin[k]) // each[k]
            yield frame.drop(columns="rank").assign(sequence_id=sequence)

    ranked = positions(cut, ["size"], ["id", "start"], "rank")
    kind = docs.schema[id_col].dataType.simpleString()
    seated = ranked.mapInPandas(seat, f"id {kind}, h long, {PIECE}, size int, _k long, sequence_id long")
    # a sequence holds at most ``capacity`` pieces, so this window is bounded
    before = "sum(length) over (partition by sequence_id order by size desc, id, start, ids_crc32, _k " \
             "rows between unbounded preceding and 1 preceding)"
    seated = stored(seated.withColumn("offset", F.coalesce(F.expr(before), F.lit(0))).drop("size"), "seated")
    done = stored(cut_to_fill(seated, capacity), "filled")
    cuts = checksums(docs, done.where("ids_crc32 is null").drop("ids_crc32"), tokenizer, id_col, text_col, end_id)
    return (done.where("ids_crc32 is not null").unionByName(cuts)
            .select(F.col("id").alias(id_col), *COLUMNS))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op10_packing(spark, sf_dir):
    """All ``documents`` packed into sequences of 4096 tokens."""
    from .common import table
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
