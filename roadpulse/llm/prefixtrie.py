"""Prefix trie of conversations, finished in range-partitioned shards around a skeleton.

A turn is its role and text; a conversation's path is the sequence of its
turns' digests (the first 16 bytes of SHA-256, with the length in code points
beside each), so paths in byte order stand in the order of a walk through the
trie.  Splitters sampled from the conversations cut that order into shards of
about ``shard_turns`` turns.  Conversations equal in all turns are split too,
by their ids.

A node lies in more than one shard only if it is a prefix of a splitter's
path.  The trie of all splitter paths, the skeleton, is broadcast.  A shard
walks its sorted paths once with a stack: nodes off the skeleton are complete
there and final; of skeleton nodes it returns partial counts, minima and sums
over what hangs below them off the skeleton, and the sorted ids that end there
in pieces of about ``piece`` characters.  The partials are reduced by node;
sums over skeleton nodes below skeleton nodes are finished on the driver (at
most one node for each splitter and depth), and digests of ids are streamed
over the pieces in order, whatever their number.

A conversation travels as one row of 20 bytes a turn, its texts do not.

Edge cases: turns stand by turn number, null first, then role, then digest;
a null role or text is empty.  Rows with a null conversation id are dropped.
Repeated rows are separate turns.  A conversation without turns belongs to the
root, which is a node wherever there is any conversation; an empty table
gives no rows.  Only the id, turn, role and text columns are read.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WIDTH = 16  # bytes of a turn's digest in a path
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """(conv_id, own): the turns of each conversation in order, as structs of digest and length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    one = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("h"), F.length(text).alias("n"))
    return (rows.where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("conv_id"), one.alias("one"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("own"))
            .select("conv_id", F.transform("own", lambda t: F.struct(F.substring(t["h"], 1, 2 * WIDTH).alias("h"), t["n"].alias("n")))
                    .alias("own")))


def rebuilt(own: DataFrame, base_of, shared, most: int) -> DataFrame:
    """(conv_id, path, lens): each conversation with its first ``shared`` turns taken from ``base_of``'s (at most ``most``)."""
    heads = own.select(F.col("conv_id").alias("base"), F.slice("own", 1, most).alias("head"))
    n = F.size("own")
    joined = (own.withColumns({"base": base_of, "h": shared}).join(heads, "base", "left")
              .withColumn("all", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0)),
                                          F.slice("own", F.col("h") + 1, F.greatest(n - F.col("h"), F.lit(0))))))
    return joined.select("conv_id", F.unhex(F.array_join(F.transform("all", lambda t: t["h"]), "")).alias("path"),
                         F.transform("all", lambda t: t["n"]).alias("lens"))


def sampled_splitters(paths: DataFrame, shards: int, each: int = 16) -> list[tuple[bytes, int]]:
    """At most ``shards - 1`` (path, conv_id) in order, from at most about ``shards * each`` sampled rows."""
    if shards <= 1:
        return []
    n = paths.count()
    rows = paths.select("conv_id", "path", F.size("lens").alias("n")).where(
        F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, shards * each / max(n, 1)) * (1 << 30)))).collect()
    got = sorted((bytes(r["path"]), r["conv_id"], r["n"] + 1) for r in rows)  # shards of equal weight in turns
    total, done, out = sum(x[2] for x in got), 0, []
    for path, conv, weight in got:
        if done * shards // max(total, 1) != (done + weight) * shards // max(total, 1) and done:
            out.append((path, conv))
        done += weight
    return out


def common_turns(a: bytes, b: bytes) -> int:
    """Number of leading turns that two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // WIDTH


def prefix_keys(path: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0, 1, ..., ``depth`` turns of a path."""
    running, out = hashlib.blake2b(digest_size=16), []
    for d in range(depth + 1):
        out.append(running.digest())
        running.update(path[d * WIDTH:(d + 1) * WIDTH])
    return out


def ids_text(ids) -> str:
    return ",".join(map(str, ids))


def walk(paths: list[bytes], ids: list[int], lens: list, left: bytes | None, right: bytes | None, piece: int = 4096):
    """Nodes of one shard's sorted conversations: (final nodes, partial skeleton nodes, pieces of ids).

    ``left`` and ``right`` are the splitter paths at the shard's ends.  A node
    at most as deep as what its path shares with one of them is a skeleton
    node; so is the root.
    """
    col = {k: array("q") for k in ("start", "depth", "parent", "tokens", "stop", "least", "after")}
    stack: list[int] = []
    nodes = 0

    def close(end: int) -> None:
        v = stack.pop()
        col["stop"][v], col["after"][v] = end, nodes
        if stack and col["least"][v] < col["least"][stack[-1]]:
            col["least"][stack[-1]] = col["least"][v]

    def push(i: int, depth: int, tokens: int) -> None:
        nonlocal nodes
        for k, x in (("start", i), ("depth", depth), ("parent", stack[-1] if stack else -1), ("tokens", tokens),
                     ("stop", 0), ("least", ids[i]), ("after", 0)):
            col[k].append(x)
        stack.append(nodes)
        nodes += 1

    ends: dict[int, tuple[int, int]] = {}  # node: its ended conversations are a run, first in its range
    before = None
    for i, path in enumerate(paths):
        if before is None:
            push(i, 0, 0)
            shared = 0
        else:
            shared = common_turns(before, path)
            while len(stack) > shared + 1:
                close(i)
        for d in range(shared, len(path) // WIDTH):
            push(i, d + 1, int(lens[i][d]))
        top = stack[-1]
        if ids[i] < col["least"][top]:
            col["least"][top] = ids[i]
        ends[top] = (ends[top][0] if top in ends else i, i + 1)
        before = path
    while stack:
        close(len(paths))

    a = {k: np.frombuffer(v, np.int64) for k, v in col.items()}
    at = np.arange(nodes)
    n = a["stop"] - a["start"]
    edge = np.zeros(len(paths), np.int64)  # depth of a path's last skeleton node
    for splitter in (left, right):
        if splitter is not None:
            edge = np.maximum(edge, [common_turns(p, splitter) for p in paths])
    skeleton = a["depth"] <= edge[a["start"]]
    childless = a["after"] == at + 1
    inner = np.r_[0, np.cumsum(~skeleton & childless)]
    saved = np.r_[0, np.cumsum(np.where(skeleton, 0, (n - 1) * a["tokens"]))]
    leaves, saved = (x[a["after"]] - x[at] for x in (inner, saved))
    parent = a["parent"]
    children, off = np.bincount(parent[parent >= 0], minlength=nodes), np.zeros(nodes, np.int64)
    hangs = np.flatnonzero((parent >= 0) & ~skeleton)
    hangs = hangs[skeleton[parent[hangs]]]       # tops of the subtrees off the skeleton
    np.add.at(off, parent[hangs], 1)
    for sums in (leaves, saved):
        sums[skeleton] = 0
        np.add.at(sums, parent[hangs], sums[hangs])

    empty = hashlib.sha256(b"").hexdigest()
    digest = {v: hashlib.sha256(ids_text(ids[x:y]).encode()).hexdigest() for v, (x, y) in ends.items() if not skeleton[v]}
    keys: dict[int, bytes] = {}
    for v in np.flatnonzero(skeleton).tolist():  # a skeleton node's key needs its whole path: once for each deepest one
        if v not in keys:
            chain, deep = [v], v
            while deep + 1 < nodes and parent[deep + 1] == deep and skeleton[deep + 1]:
                deep += 1
                chain.append(deep)
            named = prefix_keys(paths[int(a["start"][deep])], int(a["depth"][deep]))
            for u in chain:
                keys[u] = named[int(a["depth"][u])]
    own = np.flatnonzero(~skeleton)
    up = parent[own]
    final = pd.DataFrame({
        "conv_id": a["least"][own], "depth": a["depth"][own], "n_convs": n[own], "n_children": children[own],
        "n_leaves": leaves[own], "saved_tokens": saved[own], "ends_sha256": [digest.get(v, empty) for v in own.tolist()],
        "parent_conv_id": pd.array(np.where(skeleton[up], 0, a["least"][up]), "Int64"),
        "parent_key": [keys.get(u) for u in up.tolist()]})
    final.loc[skeleton[up], "parent_conv_id"] = pd.NA
    s = np.flatnonzero(skeleton)
    partial = pd.DataFrame({
        "key": [keys[v] for v in s.tolist()], "parent_key": [keys.get(int(parent[v])) for v in s.tolist()],
        "conv_id": a["least"][s], "depth": a["depth"][s], "n_convs": n[s], "n_children": off[s], "n_leaves": leaves[s],
        "saved_tokens": saved[s], "tokens": a["tokens"][s]})
    pieces = []
    for v in s.tolist():
        if v in ends:
            x, y = ends[v]
            step = max(1, piece // 12)
            pieces += [(keys[v], ids[i], ids_text(ids[i:min(i + step, y)])) for i in range(x, y, step)]
    return final, partial, pd.DataFrame(pieces, columns=["key", "conv_id", "piece"])


ROW = ("kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
       "saved_tokens long, tokens long, ends_sha256 string, key binary, parent_key binary, piece string")


def end_digests(pieces: DataFrame) -> DataFrame:
    """(key, ends_sha256): the pieces of each node joined in order of their first ids and hashed as a stream."""
    def run(frames):
        now, hashed = None, None
        for frame in frames:
            keys, out = frame["key"].tolist(), []
            for key, text in zip(keys, frame["piece"].tolist()):
                if key == now:
                    hashed.update(b",")
                else:
                    if now is not None:
                        out.append((now, hashed.hexdigest()))
                    now, hashed = key, hashlib.sha256()
                hashed.update(text.encode())
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, hashed.hexdigest())], columns=["key", "ends_sha256"])

    return (pieces.select("key", "conv_id", "piece").repartition("key").sortWithinPartitions("key", "conv_id")
            .mapInPandas(run, "key binary, ends_sha256 string"))


def finished_skeleton(partials: pd.DataFrame) -> pd.DataFrame:
    """Sums of reduced skeleton nodes over the skeleton nodes below them, children before parents."""
    nodes = {bytes(r.key): r._asdict() | {"parent_key": None if r.parent_key is None else bytes(r.parent_key)}
             for r in partials.itertuples(index=False)}
    for r in nodes.values():
        r["own_children"] = 0
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        if r["n_children"] + r["own_children"] == 0:
            r["n_leaves"] = 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["tokens"]
        up = nodes.get(r["parent_key"])
        r["parent_conv_id"] = up["conv_id"] if up else None
        if up:
            up["own_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
    return pd.DataFrame([{**{k: r[k] for k in ("key", "conv_id", "depth", "n_convs", "n_leaves", "saved_tokens")},
                          "n_children": r["n_children"] + r["own_children"], "parent_conv_id": r["parent_conv_id"]}
                         for r in nodes.values()])


def trie(paths: DataFrame, shard_turns: int = 500_000, most_broadcast: int = 200_000) -> DataFrame:
    """All nodes of the trie over ``paths`` (conv_id long, path binary, lens array<int>), stored."""
    spark = paths.sparkSession
    paths = stored(paths, "trie-paths")
    weight = paths.agg(F.sum(F.size("lens") + 1)).first()[0]
    if weight is None:
        return spark.createDataFrame([], f"{NODE}, ends_sha256 string")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(weight) // shard_turns))
    splitters = sampled_splitters(paths, shards)
    skeleton = spark.sparkContext.broadcast(splitters)

    @F.pandas_udf("int")
    def shard_of(path: pd.Series, conv: pd.Series) -> pd.Series:
        known = skeleton.value
        return pd.Series([bisect_right(known, (bytes(p), c)) for p, c in zip(path, conv)], dtype="int32")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        k, known = int(frame["shard"].iloc[0]), skeleton.value
        frame = frame.assign(path=[bytes(p) for p in frame["path"]]).sort_values(["path", "conv_id"])
        final, partial, pieces = walk(frame["path"].tolist(), frame["conv_id"].tolist(), frame["lens"].tolist(),
                                      known[k - 1][0] if k else None, known[k][0] if k < len(known) else None)
        whole = pd.concat([final.assign(kind=0), partial.assign(kind=1), pieces.assign(kind=2)], ignore_index=True)
        names = [x.split()[0] for x in ROW.split(", ")]
        out = whole.reindex(columns=names)
        for c in names:
            if c in ("ends_sha256", "key", "parent_key", "piece"):
                out[c] = out[c].astype(object).where(out[c].notna(), None)
            else:
                out[c] = out[c].astype("Int64")
        return out

    rows = stored(paths.withColumn("shard", shard_of("path", "conv_id")).groupBy("shard").applyInPandas(run, ROW), "trie-nodes")
    reduced = (rows.where("kind = 1").groupBy("key")
               .agg(F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
                    *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
                    F.max("tokens").alias("tokens")).toPandas())
    top = finished_skeleton(reduced)
    schema = f"key binary, {NODE}"
    top = top[[x.split()[0] for x in schema.split(", ")]]
    top = spark.createDataFrame([tuple(None if x is None or x != x else x if isinstance(x, bytes) else int(x) for x in r)
                                 for r in top.itertuples(index=False)], schema)
    ends = end_digests(rows.where("kind = 2"))
    upper = top.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).drop("key")
    names = top.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    names = F.broadcast(names) if len(reduced) <= most_broadcast else names  # one row a skeleton node
    lower = (rows.where("kind = 0").join(names, "parent_key", "left")
             .withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id")))
    columns = [*[x.split()[0] for x in NODE.split(", ")], "ends_sha256"]
    return upper.select(*columns).unionByName(lower.select(*columns))


def op11_prefix_trie(spark, sf_dir):
    """The trie of all ``conversations``, each opening with turns of the first conversation of its hundred."""
    from .common import table
    own = stored(turns(table(spark, sf_dir, "conversations")), "turns")
    c = F.col("conv_id")
    paths = rebuilt(own, c - c % 100, (F.crc32(c.cast("string").cast("binary")) % 6).cast("int"), 5)
    return trie(paths)
