"""Conversations from quoted messages.

A line's quote level is the number of ``>`` signs that lead it (spaces between
them allowed); consecutive lines of one level form a passage.  A message's own
words are its level-0 lines.  Every quoted passage, and every quoted block with
the deeper quotes inside it, is normalised (quote signs off, lower case, white
space to one space) and hashed.

A passage's context is the nearest passage one level deeper right before it,
that one's context in turn, and so on.  Quotes match with their levels counted
one less.  In order of preference, a message replies to

* ``block``: the original whose whole body is one of its quoted blocks;
* ``passage``: the original whose own words are the level-1 words of a block;
* ``part``: the original with a passage or paragraph that is one of its level-1
  passages or paragraphs;
* ``deeper``: the original with such a part quoted at level 2 or deeper, the
  lowest level first (a message between the two is missing).

Within ``passage`` and ``part`` the original that agrees on most levels of
context wins, then the part that the fewest originals hold.  Of several
originals the same by all this the one with the smallest id is taken, and only
if it came earlier (has a smaller id than the reply).  Replies form a forest:
pointers are doubled until every message knows its first message and depth.  A conversation is the tree of one first message, in order
of depth, then id; ``text`` holds the own words without quotes.

Edge cases: null and empty texts have no words and no quotes; they start a
conversation of their own and are nobody's original.  Rows with a null id are
kept as conversations of their own with a null id.  Rows that repeat an id
count as one message, the one with the smallest text.  Quotes that match
nothing leave ``parent_id`` null.  An empty table gives no rows.  Columns other
than id and text are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, stored, table

PARSED = ("id long, own string, n_quotes long, max_level long, offers array<binary>, parts array<binary>, "
          "asks array<struct<rank: int, kind: string, less: int, hash: binary>>")


def level(line: str) -> tuple[int, str]:
    """Quote level of a line, and the line without its quote signs."""
    depth, at = 0, 0
    while True:
        rest = line[at:].lstrip(" \t")
        if not rest.startswith(">"):
            return depth, (line[at:] if depth == 0 else rest)
        depth, at = depth + 1, len(line) - len(rest) + 1


def passages(text: str | None) -> list[tuple[int, str]]:
    """(level, text) of consecutive lines of one level, in order; blank lines do not end a passage."""
    found: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        depth, words = level(line)
        if not words.strip() and depth == 0:
            if found and found[-1][0] == 0:
                found[-1][1].append("")
            continue
        if not found or found[-1][0] != depth:
            found.append((depth, []))
        found[-1][1].append(words)
    return [(depth, "\n".join(lines).strip()) for depth, lines in found]


def _hash(parts: list[tuple[int, str]], base: int) -> str | None:
    """Hash of normalised passages with their levels counted from ``base``; None without words."""
    lines = [f"{depth - base} {' '.join(words.lower().split())}" for depth, words in parts if words.split()]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None


def parse(text: str | None) -> tuple[str, str | None, str | None, str | None, str | None, int, int]:
    """Own words; hashes of the whole body, of the own words, of the first quoted block, of its level-1 passage."""
    parts = passages(text)
    own = [p for p in parts if p[0] == 0]
    block: list[tuple[int, str]] = []
    for p in parts:  # the first run of quoted passages
        if p[0]:
            block.append(p)
        elif block:
            break
    first = [p for p in block if p[0] == 1]
    quoted = [p for p in parts if p[0]]
    return ("\n".join(w for _, w in own), _hash(parts, 0), _hash(own, 0), _hash(block, 1), _hash(first, 1),
            len(quoted), max((d for d, _ in quoted), default=0))


def _chain(tag: str, base: list[tuple[int, str]], parts: list[tuple[int, str]], at: int) -> list[bytes]:
    """Keys of ``base`` alone, with one level of the context that passage ``at`` has, with two, and so on."""
    zero = depth = parts[at][0]
    lines = [" ".join(words.lower().split()) for _, words in base]
    if not any(lines):
        return []
    state = hashlib.sha256("\n".join([tag, *(x for x in lines if x)]).encode())
    keys = [state.digest()[:16]]
    while at and parts[at - 1][0] > zero:
        at -= 1
        level_, words = parts[at]
        if level_ <= depth:
            break
        if level_ == depth + 1:
            depth = level_
            state.update(("\n\n" + " ".join(words.lower().split())).encode())
            keys.append(state.digest()[:16])
    return keys


def _pieces(part: tuple[int, str]) -> list[list[tuple[int, str]]]:
    """A passage, and its paragraphs if it has several."""
    paragraphs, lines = [], []
    for line in [*part[1].split("\n"), ""]:
        if line.strip():
            lines.append(line)
        elif lines:
            paragraphs.append([(part[0], "\n".join(lines))])
            lines = []
    return [[part], *(paragraphs if len(paragraphs) > 1 else [])]


def keys(text: str | None) -> tuple[list[bytes], list[bytes], list[tuple[int, str, int, bytes]]]:
    """What a message offers to be quoted by, as a whole and in parts, and what its quotes ask for: (rank, kind, less, hash).

    ``less`` is minus the levels of context, so that more context sorts first.
    """
    parts = passages(text)
    offers, pieces, asks = set(), set(), set()

    def whole(tag: str, block: list[tuple[int, str]], base: int) -> list[bytes]:
        got = _hash(block, base)
        return [hashlib.sha256(f"{tag}{got}".encode()).digest()[:16]] if got else []

    own = [i for i, p in enumerate(parts) if p[0] == 0]
    offers.update(whole("body", parts, 0))
    if own:
        offers.update(_chain("own", [parts[i] for i in own], parts, own[0]))
    blocks: list[list[int]] = []
    for i, (depth, _) in enumerate(parts):
        if depth and i and parts[i - 1][0]:
            blocks[-1].append(i)
        elif depth:
            blocks.append([i])
        for piece in _pieces(parts[i]):
            if depth > 1:
                asks.update((1 + depth, "deeper", 0, h) for h in _chain("part", piece, parts, i)[:1])
            elif depth:
                asks.update((2, "part", -n, h) for n, h in enumerate(_chain("part", piece, parts, i)))
            else:
                pieces.update(_chain("part", piece, parts, i))
    for block in blocks:
        asks.update((0, "block", 0, h) for h in whole("body", [parts[i] for i in block], 1))
        first = [i for i in block if parts[i][0] == 1]
        if first:
            asks.update((1, "passage", -n, h) for n, h in
                        enumerate(_chain("own", [parts[i] for i in first], parts, first[0])))
    return sorted(offers), sorted(pieces), sorted(asks)


def parse_messages(messages: DataFrame, id_col: str = "message_id", text_col: str = "text") -> DataFrame:
    def run(frames):
        for frame in frames:
            rows = []
            for id_, text in zip(frame["id"], frame["text"]):
                text = text if isinstance(text, str) else None
                own, *_, n_quotes, max_level = parse(text)
                offers, pieces, asks = keys(text)
                rows.append((id_, own, n_quotes, max_level, offers, pieces,
                             [dict(zip(("rank", "kind", "less", "hash"), a)) for a in asks]))
            yield pd.DataFrame(rows, columns=["id", "own", "n_quotes", "max_level", "offers", "parts", "asks"])
    return (messages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .where("id is not null").groupBy("id").agg(F.min("text").alias("text")).mapInPandas(run, PARSED))


def parents(parsed: DataFrame) -> DataFrame:
    """(id, parent, linked_by) of messages whose quotes match an earlier original.

    Parts and deeper levels are asked for only by messages that no whole body or own words gave a
    parent, and of all parts only those that are asked for are counted.
    """
    best = F.min(F.struct("rank", "less", "n", F.col("first").alias("parent"), F.col("kind").alias("linked_by")))
    asked = lambda rows: rows.select("id", F.explode("asks").alias("a")).select("id", "a.*")

    def matched(asks: DataFrame, offers: DataFrame) -> DataFrame:
        # one row per hash, so a text that many messages share joins to one original
        offered = offers.groupBy("hash").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        return (asks.join(offered, "hash").where("first < id").groupBy("id").agg(best.alias("m"))
                .select("id", "m.parent", "m.linked_by"))

    whole = stored(matched(asked(parsed).where("rank < 2"), parsed.select("id", F.explode("offers").alias("hash"))), "links-whole")
    quoting = parsed.where(F.exists("asks", lambda a: a["rank"] >= 2)).select("id", "asks")
    rest = stored(asked(quoting.join(whole.select("id"), "id", "left_anti")).where("rank >= 2"), "asks-deeper")
    if rest.isEmpty():
        return whole
    pieces = (parsed.select("id", F.explode("parts").alias("hash"))
              .join(rest.select("hash").distinct(), "hash", "left_semi"))
    return whole.unionByName(matched(rest, pieces))


def roots(links: DataFrame) -> DataFrame:
    """(id, root, depth) for every message with a parent, by pointer doubling.

    A round asks only for messages that have not reached their first message;
    one at depth d is done after about log2(d) rounds.
    """
    asking = stored(links.select("id", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth")), "pointers")
    done = asking.limit(0)
    while True:
        targets = asking.union(done).select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        joined = stored(asking.join(targets, "at", "left")
                        .select("id", F.coalesce("next", "at").alias("at"),
                                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                                F.col("next").isNotNull().alias("moved")), "pointers")
        done = done.union(joined.where("not moved").drop("moved"))
        asking = joined.where("moved").drop("moved")
        if asking.isEmpty():
            return done.select("id", F.col("at").alias("root"), "depth")


def conversations(messages: DataFrame, id_col: str = "message_id", text_col: str = "text") -> DataFrame:
    """One row per message: conversation_id, place, depth, parent_id, linked_by, quote counts and own text."""
    parsed = stored(parse_messages(messages, id_col, text_col), "messages")
    links = stored(parents(parsed), "links")
    placed = (parsed.select("id", F.col("own").alias("text"), "n_quotes", "max_level")
              .join(links, "id", "left").join(roots(links), "id", "left")
              .select(F.coalesce("root", "id").alias("conversation_id"), F.coalesce("depth", F.lit(0)).alias("depth"),
                      F.col("id").alias(id_col), F.col("parent").alias("parent_id"), "linked_by", "n_quotes",
                      "max_level", "text"))
    placed = positions(placed, ["conversation_id"], ["depth", id_col], "place")
    nameless = messages.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("conversation_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias(id_col), F.lit(None).cast("long").alias("parent_id"),
        F.lit(None).cast("string").alias("linked_by"), F.lit(0).cast("long").alias("n_quotes"),
        F.lit(0).cast("long").alias("max_level"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.lit(0).cast("long").alias("place"))
    return placed.unionByName(nameless)


def quoted_mail(turns: DataFrame) -> DataFrame:
    """Stand-in input: every turn as a message that quotes the turn before it, which quotes the one before."""
    turns = (turns.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn")
             .agg(F.min(F.coalesce("text", F.lit(""))).alias("t0")))
    for back in (1, 2):
        earlier = turns.select("conv_id", (F.col("turn") + back).alias("turn"), F.col("t0").alias(f"t{back}"))
        turns = turns.join(earlier, ["conv_id", "turn"], "left")
    quote = lambda c, signs: F.regexp_replace(c, "(?md)^", signs)
    return turns.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("message_id"),
                        F.concat_ws("\n", quote("t2", ">> "), quote("t1", "> "), "t0").alias("text"))


def op8_quotation_linking(spark, sf_dir):
    """Reply-ordered conversations without quotes from messages made of all ``conversations``."""
    return conversations(quoted_mail(table(spark, sf_dir, "conversations")))
