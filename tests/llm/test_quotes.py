import random
import re

from roadpulse.llm import quotes as qt


def plain(rows):
    """Parents, roots and depths by scanning all pairs of messages."""
    parsed = {k: qt.parse(t) for k, t in rows}
    parent = {}
    for k, (_, _, _, block, passage, _, _) in parsed.items():
        full = [j for j, p in parsed.items() if block and p[1] == block]
        own = [j for j, p in parsed.items() if passage and p[2] == passage]
        for how, found in (("block", full), ("passage", own)):
            if found and min(found) < k:
                parent[k] = (min(found), how)
                break
    out = {}
    for k in parsed:
        depth, at = 0, k
        while at in parent:
            depth, at = depth + 1, parent[at][0]
        out[k] = (at, depth, *parent.get(k, (None, None)), parsed[k][0])
    return out


def columns(df):
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault(r.conversation_id, []).append((r.depth, r.message_id, r.place))
    for c, members in by.items():
        if c is not None:
            assert [p for _, _, p in sorted(members)] == list(range(len(members)))
    return {r.message_id: (r.conversation_id, r.depth, r.parent_id, r.linked_by, r.text) for r in rows}


def test_query_equals_brute_force(spark, sf):
    messages = [(r.message_id, r.text) for r in qt.quoted_mail(spark.read.parquet(f"{sf}/conversations.parquet")).collect()]
    got = columns(qt.op8_quotation_linking(spark, sf))
    assert got == plain(messages)
    assert {how for _, _, _, how, _ in got.values()} == {"block", "passage", None}


def test_odd_rows(spark):
    rows = [(1, "Hello there"), (2, "> hello   THERE\nYes"), (3, ">> Hello there\n> Yes\nNo"), (4, None), (5, ""), (6, "> nobody\nwrote this"),
            (7, "Hello there"), (8, ">Hello there"), (9, "> \n> \nx"), (10, "> Hello there\n\n> Yes\nboth"), (0, "> Hello there\nearly"),
            (11, "> " * 300 + "deep"), (12, "long " * 50000)]
    frame = spark.createDataFrame([(k, t, "p", 1, "d") for k, t in rows] + [(1, "Hello there", "p", 1, "d"), (None, "> Hello there", "p", 1, "d")],
                                  "message_id long, text string, parent string, id long, own string")
    got = qt.conversations(frame)
    assert got.where("message_id is null").count() == 1
    assert columns(got.where("message_id is not null")) == plain(rows)
    assert qt.conversations(frame.limit(0)).count() == 0


def test_levels_and_passages():
    assert qt.level("> > a") == (2, "a") and qt.level("  x") == (0, "  x") and qt.level(">>b") == (2, "b")
    assert qt.passages("a\n> b\n> c\n>> d\n\ne") == [(0, "a"), (1, "b\nc"), (2, "d"), (0, "e")]


def test_long_chain_and_popular_parent(spark):
    chain = [(1, "m1")] + [(k, f"> m{k - 1}\nm{k}") for k in range(2, 41)]
    crowd = [(k, f"> m1\nreply {k}") for k in range(100, 400)]
    got = columns(qt.conversations(spark.createDataFrame(chain + crowd, "message_id long, text string")))
    assert got == plain(chain + crowd)
    assert got[40][:2] == (1, 39)


def test_every_passage_and_context_links(spark):
    rows = [(1, "Shall we meet?"), (2, "> Shall we meet?\nok"), (3, "Is it done?"), (4, "> Is it done?\nok"),
            (5, ">> Is it done?\n> ok\nfine"), (6, ">> Shall we meet?\n> ok\ngood"),
            (7, "First point.\n\nSecond point."), (8, "> Second point.\nagreed"),
            (9, "> unknown\nwhat\n> First point.\nyes"), (10, ">> Second point.\n> lost\nhm"),
            (11, "> agreed\nbut\n> nothing\nmore"), (12, "> ok\nbare"),
            (13, ">>> Is it done?\n>> ok\n> fine\nlast")]
    got = columns(qt.conversations(spark.createDataFrame(rows, "message_id long, text string")))
    assert {k: got[k][2:4] for k in got if got[k][2]} == {
        2: (1, "block"), 4: (3, "block"), 5: (4, "block"), 6: (2, "block"), 8: (7, "part"), 9: (7, "part"),
        10: (7, "deeper"), 11: (8, "passage"), 12: (2, "passage"), 13: (5, "block")}
    # trimmed quotes: no block is a whole body, only the context tells the two texts "ok" apart
    rows = [(1, ">> a\n> b\nok"), (2, ">> c\n> d\nok"), (3, ">> d\n> ok\nx"), (4, ">> b\n> ok\ny")]
    got = columns(qt.conversations(spark.createDataFrame(rows, "message_id long, text string")))
    assert got[3][2:4] == (2, "passage") and got[4][2:4] == (1, "passage")


# --- all pairs of messages with plain strings: no code of the module --------------------------------------------------

def split_levels(text):
    """[(level, [lines])] of consecutive lines of one level."""
    runs = []
    for line in (text or "").split("\n"):
        lead = re.match(r"(?:[ \t]*>)*", line)[0]
        depth = lead.count(">")
        rest = line[len(lead):].lstrip(" \t") if depth else line
        if not depth and not line.strip():
            if runs and runs[-1][0] == 0:
                runs[-1][1].append("")
            continue
        if not runs or runs[-1][0] != depth:
            runs.append((depth, []))
        runs[-1][1].append(rest)
    return runs


def flat(lines):
    return " ".join(" ".join(lines).lower().split())


def context(runs, at):
    """Normalised passages one level deeper each time, going back from run ``at``."""
    out, zero = [], runs[at][0]
    depth = zero
    for d, lines in reversed(runs[:at]):
        if d <= zero or d <= depth:
            break
        if d == depth + 1:
            depth = d
            out.append(flat(lines))
    return out


def paragraphs(lines):
    """A passage, and its paragraphs if it has several."""
    groups = [g for g in re.split(r"\n\s*\n", "\n".join(x if x.strip() else "" for x in lines).strip()) if g.strip()]
    return [flat(lines)] + ([flat(g.split("\n")) for g in groups] if len(groups) > 1 else [])


def shown(runs, base):
    return tuple((d - base, flat(lines)) for d, lines in runs if flat(lines))


def offered(text):
    runs = split_levels(text)
    out = set()
    if shown(runs, 0):
        out.add(("body", shown(runs, 0)))
    own = [k for k, r in enumerate(runs) if r[0] == 0]
    words = tuple(flat(runs[k][1]) for k in own if flat(runs[k][1]))
    if words:
        c = context(runs, own[0])
        out |= {("own", words, tuple(c[:n])) for n in range(len(c) + 1)}
    for k in own:
        c = context(runs, k)
        out |= {("part", p, tuple(c[:n])) for p in paragraphs(runs[k][1]) if p for n in range(len(c) + 1)}
    return out


def wanted(text):
    """(rank, minus levels of context, kind, what is asked for)."""
    runs = split_levels(text)
    out, k = [], 0
    while k < len(runs):
        if not runs[k][0]:
            k += 1
            continue
        end = k
        while end < len(runs) and runs[end][0]:
            end += 1
        if shown(runs[k:end], 1):
            out.append((0, 0, "block", ("body", shown(runs[k:end], 1))))
        first = [i for i in range(k, end) if runs[i][0] == 1]
        words = tuple(flat(runs[i][1]) for i in first if flat(runs[i][1]))
        if words:
            c = context(runs, first[0])
            out += [(1, -n, "passage", ("own", words, tuple(c[:n]))) for n in range(len(c) + 1)]
        for i in range(k, end):
            c, d = context(runs, i), runs[i][0]
            for p in filter(None, paragraphs(runs[i][1])):
                out += [(2, -n, "part", ("part", p, tuple(c[:n]))) for n in range(len(c) + 1)] if d == 1 else \
                       [(1 + d, 0, "deeper", ("part", p, ()))]
        k = end
    return out


def all_pairs(rows):
    offers = {k: offered(t) for k, t in rows}
    out = {}
    for k, text in rows:
        found = []
        for rank, less, kind, key in wanted(text):
            holders = [j for j in offers if key in offers[j]]
            if holders and min(holders) < k:
                found.append((rank, less, len(holders), min(holders), kind))
        if found:
            out[k] = (min(found)[3], min(found)[4])
    return out


def test_random_quotes_equal_all_pairs(spark):
    rng = random.Random(12)
    words = ["yes", "no", "Maybe so", "see you", "a b", "the plan"]
    rows = []
    for k in range(1, 700):
        lines = []
        for _ in range(rng.randint(0, 7)):
            lines.append(rng.choice(["", "> ", "> ", ">> ", "> > ", ">>> "]) + rng.choice(words))
            if rng.random() < 0.25:
                lines.append(rng.choice(["", ">", "  "]))
        if k > 3 and rng.random() < 0.5:  # a real quote of an earlier message, perhaps trimmed
            earlier = rows[rng.randrange(len(rows))][1].split("\n")
            cut = rng.randrange(len(earlier)) if rng.random() < 0.4 else 0
            lines = [("> " if not x.startswith(">") else ">") + x for x in earlier[cut:]] + lines
        if rng.random() < 0.6:
            lines.append(f"{rng.choice(words)} {rng.randrange(90)}")
        rows.append((k, "\n".join(lines)))
    got = columns(qt.conversations(spark.createDataFrame(rows, "message_id long, text string")))
    want = all_pairs(rows)
    assert {k: v[2:4] for k, v in got.items() if v[2] is not None} == want
    assert {how for _, how in want.values()} == {"block", "passage", "part", "deeper"}
