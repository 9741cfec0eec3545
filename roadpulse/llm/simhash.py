"""SimHash near-duplicate groups by multi-index hashing.

Words are the maximal runs of anything but space and U+0009..U+000D, after
lower-casing A-Z.  Each shingle of three words (the whole sequence if there
are fewer) is hashed with XXH64, seed 42; a bit of the fingerprint is 1 if it
is set in over half of the shingles, repeats included.  Fingerprints at most
``max_distance`` bits apart are linked and components are closed over links.

Search: the fingerprint is cut into four segments.  Two fingerprints within
``max_distance`` bits spread their differences over two halves, and within
the closer half over two quarters; so a probe takes every half with a small
Hamming ball around one quarter of the other half (see ``_probes``).  Table
matches share 48 bits up to the flipped ones, which keeps buckets small even
inside a large family of near copies; complete distances are then verified.

Edge cases: null and empty texts and texts without words have fingerprint
zero and link like any other.  A null id stays null in the output and does
not serve as a component id unless the whole component has none.  Repeated
rows keep their own output rows.  An empty table gives an empty result.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, stored

SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-width].tolist()]
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1:] - 1).tolist())],
                      dtype=">u8").view(np.uint8).reshape(-1, 8)
    set_in = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * set_in > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = 3) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long."""
    def batches(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "fp": np.array(
                [fingerprint(t, width) for t in frame["text"]], np.uint64).view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(_arrow(batches), f"id {kind}, fp long"))


def _arrow(step):
    """Run ``step`` on small pandas slices of the Arrow batches; ids keep their type."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                frame = pd.DataFrame({"id": range(part.num_rows), "text": part.column(1).to_pylist()})
                for out in step([frame]):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(out["fp"].to_numpy(), pa.int64())], ["id", "fp"])
    return run


def _half(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * (1 - k)).bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(radius: int, bits: int) -> list[int]:
    """Masks of at most ``radius`` set bits."""
    return [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]


def _probes(max_distance: int) -> list[tuple[int, int, int, int]]:
    """(near half, mask on it, quarter of the far half, mask on it) to look up.

    One half differs in at most d // 2 bits; take the differences of the near
    half as its mask.  The far half then differs in at most the rest, and one
    of its quarters in at most half of that.  Near half 1 need only be tried
    with strictly fewer differing bits than half 0, and quarter 1 likewise.
    """
    found = []
    for near in (0, 1):
        for near_mask in _ball(max_distance // 2 - (near == 1 and max_distance % 2 == 0), 32):
            rest = max_distance - near_mask.bit_count()
            for quarter in (0, 1):
                for far_mask in _ball(rest // 2 - (quarter == 1 and rest % 2 == 0), 16):
                    found.append((near, near_mask, quarter, far_mask))
    return found


def links(prints: DataFrame, max_distance: int = 2) -> DataFrame:
    """(a, b) with a < b: distinct fingerprints ``fp`` at most ``max_distance`` bits apart."""
    fp = F.col("fp")
    quarter = lambda far, q: F.shiftrightunsigned(far, 16 * (1 - q)).bitwiseAND(F.lit(0xFFFF))
    tables = [(near, q) for near in (0, 1) for q in (0, 1)]
    key = lambda near, q: F.xxhash64(F.lit(2 * near + q), _half(fp, near), quarter(_half(fp, 1 - near), q))
    posts = prints.select(fp.alias("b"), F.explode(F.array(*[key(n, q) for n, q in tables])).alias("key"))
    # a mask over the whole fingerprint flips the near half's bits and the far quarter's;
    # of two fingerprints that differ under a mask only the one with its top bit set probes
    flips = {}
    for near, near_mask, q, far_mask in _probes(max_distance):
        whole = (near_mask << 32 * (1 - near)) | (far_mask << (32 * near + 16 * (1 - q)))
        flips.setdefault((near, q), []).append(whole - (1 << 64) if whole >> 63 else whole)
    probes = None
    for (near, q), masks in flips.items():
        top = [0 if m == 0 else (1 << ((m & (2**64 - 1)).bit_length() - 1)) for m in masks]
        top = [t - (1 << 64) if t >> 63 else t for t in top]
        flip = F.explode(F.arrays_zip(F.array(*[F.lit(m).cast("long") for m in masks]).alias("m"),
                                      F.array(*[F.lit(t).cast("long") for t in top]).alias("t"))).alias("f")
        part = (prints.select(fp.alias("a"), flip)
                .where(F.col("a").bitwiseAND(F.col("f.t")) == F.col("f.t"))
                .select("a", F.col("a").bitwiseXOR(F.col("f.m")).alias("fp"))
                .select("a", key(near, q).alias("key")))
        probes = part if probes is None else probes.union(part)
    found = probes.join(posts, "key").where(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(prints: DataFrame, max_distance: int = 2) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint in ``prints`` (id, fp)."""
    firsts = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(firsts.select("fp"), max_distance))
    rooted = stored(firsts.join(roots, firsts["fp"] == roots["node"], "left")
                    .select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return stored(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 3, max_distance: int = 2) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``."""
    prints = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    return (prints.join(groups(prints, max_distance).drop("root"), "fp")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             width: int = 3, max_distance: int = 2) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id, of the group's rows with one id the smallest.

    Of a group without any id the smallest row stays.  An id whose rows differ
    in fingerprint stands for several groups; its rows are told apart by theirs.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    found = groups(prints, max_distance)
    chosen = stored(prints.join(found, "fp").where("id = component_id").select("id", "fp", "root").distinct(), "simhash")
    several = prints.where("id is not null").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    unclear = stored(chosen.join(several, "id", "left_semi"), "simhash")
    clear = chosen.join(unclear.select("id"), "id", "left_anti").select("id").distinct()
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")
    with_id = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), row)
    named = (with_id.join(clear, F.col("_id") == clear["id"]).groupBy("_id").agg(F.min("_row").alias("_row"))
             .select("_row.*"))
    if not unclear.isEmpty():
        told = (with_id.join(unclear, F.col("_id") == unclear["id"])
                .withColumn("_fp", _fingerprint_of(F.col("_row")[text_col], width)).where("_fp = fp")
                .groupBy("root").agg(F.min("_row").alias("_row")))
        named = named.union(told.select("_row.*"))
    without = docs.where(F.col(id_col).isNull())
    nameless = (without.select(row, F.struct(F.col(id_col), F.col(text_col)).alias("_key")).distinct()
                .withColumn("_fp", _fingerprint_of(F.col("_key")[text_col], width))
                .join(found.where("component_id is null"), F.col("_fp") == F.col("fp"))
                .groupBy("root").agg(F.min("_row").alias("_row")))
    return named.union(nameless.select("_row.*"))


def _fingerprint_of(text: Column, width: int) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))
    return run(text)


def op7_simhash_near_dedup(spark, sf_dir):
    """SimHash groups of all ``documents``: three-word shingles, two differing bits."""
    from .common import table
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, max_distance=2)
