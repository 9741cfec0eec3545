"""Main text of HTML pages by gradient-boosted trees over DOM-node features.

A tolerant parser builds a tree of block elements; inline content between
block boundaries becomes text leaves.  Every node gets features: its kind of
tag, attribute tokens of its own and of its ancestors, depth, subtree density
(characters, words, links and punctuation against tags), its place among its
siblings and their sizes.  Boosted trees give the probability that the node
holds main text.  Hierarchical decoding then takes the most probable labelling
of the tree in which a dropped node has no kept descendant, so ancestor and
descendant choices cannot contradict each other.

The trees are fitted with Spark ML on nodes of at most ``sample`` distinct pages chosen by hash
(at most ``most_nodes`` nodes of a page or layout; pages over ``longest`` characters only if others are too few):
pages with an ``article`` or ``main`` element label themselves, and the texts
of every sampled page are also laid out anew in random page layouts whose
labels are known.

Text: character references decoded, white space (and line-break elements)
inside a block one space, blocks trimmed and joined by one newline in page
order.  Scripts, styles, templates, embedded objects, comments and the head
are never text.

Edge cases: a null or empty page, or one without kept text, gives the empty
text.  Null ids and URLs are kept.  Repeated rows stay.  An empty table gives
no rows.  Very deep nesting is read with a stack, not by recursion.  Columns
other than the id, URL and page are ignored.
"""

from __future__ import annotations

import hashlib
import html
import random
import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, and words that sites commonly use in class, id and role attributes.
RAW = set("script style noscript template svg math iframe object canvas select textarea title head".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table "
            "thead tbody tfoot tr td th caption form fieldset legend figure figcaption blockquote pre address details "
            "summary hgroup center dialog menu button label".split())
ENDS_P = BLOCK - {"html", "body", "button", "label"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "p": {"p"}}
SCOPES = {"ul", "ol", "menu", "dl", "table", "body", "html", "article", "main", "section", "div", "td", "th", "nav",
          "aside", "header", "footer", "form", "blockquote", "figure"}
TAGS = {t: k for k, group in enumerate((
    "nav menu", "header hgroup", "footer address", "aside", "form fieldset legend button label dialog", "article main",
    "section", "div center", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd",
    "table thead tbody tfoot tr td th caption", "blockquote pre", "figure figcaption", "#text")) for t in group.split()}
TOKENS = (
    "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar pagination pager skip",
    "header masthead banner topbar branding logo",
    "footer foot bottom copyright legal colophon contentinfo",
    "sidebar side aside rail widget complementary related recommended more trending popular tags archive",
    "ad ads advert advertisement adsense sponsor sponsored promo promotion outbrain taboola",
    "cookie consent notice alert gdpr modal popup overlay banner warning disclaimer",
    "form search login signup subscribe newsletter subscription share social follow",
    "comment comments reply replies disqus respond discussion reviews",
    "article content main post entry story body text page hentry prose")
GROUP = {}
for _k, _words in enumerate(TOKENS):
    for _w in _words.split():
        GROUP.setdefault(_w, []).append(_k)

IMPLIED = {"nav": 0, "menu": 0, "header": 1, "footer": 2, "aside": 3, "form": 6, "button": 6, "label": 6, "dialog": 5,
           "article": 8, "main": 8}  # groups that an element's name stands for

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|([^<]+|<)", re.S)
_ATTRS = re.compile(r"(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
N_FEATURES = len(set(TAGS.values())) + 2 * len(TOKENS) + 22


class Node:
    __slots__ = ("tag", "parent", "children", "groups", "hidden", "text", "linked", "depth")

    def __init__(self, tag: str, parent: "Node | None", groups=(), hidden: bool = False, text: str = "", linked: int = 0):
        self.tag, self.parent, self.children, self.groups, self.hidden = tag, parent, [], groups, hidden
        self.text, self.linked, self.depth = text, linked, parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


def parse(page: str | None) -> Node:
    """Tree of block elements with text leaves; the root stands for the document.

    Open elements are kept by name, so that no tag walks up the tree in vain,
    and after the page's last ``>`` nothing is read as a tag: the time is linear in the page.
    """
    page = page or ""
    root = Node("html", None)
    open_, named, scopes = [root], {}, [0]  # open elements, their places by tag, places of those that end a search
    inline: list[str] = []
    links, linked, at, last = 0, 0, 0, page.rfind(">")

    def flush():
        nonlocal linked
        if inline:
            text = " ".join(html.unescape("".join(inline)).split())
            if text:
                Node("#text", open_[-1], text=text, linked=min(linked, len(text)))
            inline.clear()
        linked = 0

    def close_to(place: int):
        while len(open_) > place:
            tag = open_.pop().tag
            named[tag].pop()
            if tag in SCOPES:
                scopes.pop()

    while at <= last and (match := _TOKEN.match(page, at)):
        at = match.end()
        text, name = match[7], match[2] or match[5]
        if text is not None:
            inline.append(text)
            linked += len(text) if links else 0
            continue
        if name is None:
            continue
        name, closing, attrs = name.lower(), (match[1] or match[4]) == "/", match[3] or match[6] or ""
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>|\Z", re.I).search(page, at)
                if name == "head":  # an unclosed head ends where the body begins
                    stop = re.compile(r"</head\b[^>]*>|(?=<body\b)|\Z", re.I).search(page, at)
                at = stop.end()
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name == "br":
            inline.append(" ")
            continue
        if name == "hr":
            flush()
            continue
        if name not in BLOCK:
            continue
        flush()
        links = 0
        if closing:
            if named.get(name):
                close_to(named[name][-1])
            continue
        if name in ("html", "body") and name != "body":
            continue
        if name in ENDS_P and open_[-1].tag == "p":
            close_to(len(open_) - 1)
        if name in CLOSED_BY:
            place = max((named[t][-1] for t in CLOSED_BY[name] if named.get(t)), default=0)
            if place and place >= scopes[-1]:
                close_to(place)
        groups = ()
        if attrs:
            groups = {g for _, value in _ATTRS.findall(attrs) for w in _WORDS.findall(value)
                      for g in GROUP.get(w.lower(), ())}
        if name in IMPLIED:
            groups = {*groups, IMPLIED[name]}
        named.setdefault(name, []).append(len(open_))
        if name in SCOPES:
            scopes.append(len(open_))
        open_.append(Node(name, open_[-1], tuple(groups), bool(attrs and _HIDDEN.search(attrs))))
    if at < len(page):  # no tag can end here any more, only comments begin
        rest = page[at:]
        text = rest[:min((k for k in (rest.find("<!"), rest.find("<?")) if k >= 0), default=len(rest))]
        inline.append(text)
        linked += len(text) if links else 0
    flush()
    return root


def nodes(root: Node) -> list[Node]:
    """All nodes, each before its children and in page order."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(reversed(node.children))
    return found


def features(pages: list[list[Node]]) -> np.ndarray:
    """One row of features per node of all ``pages``, in order."""
    order = [node for page in pages for node in page]
    n, place = len(order), {}
    for k, node in enumerate(order):
        place[id(node)] = k
    n_tags, n_groups = len(set(TAGS.values())), len(TOKENS)
    parent, root = [0] * n, [0] * n
    chars, words, links, stops, tags, leaves = ([0] * n for _ in range(6))
    start, rank, same, before, after = ([0] * n for _ in range(5))
    family, mean, against, for_ = [1] * n, [0.0] * n, [0] * n, [0] * n
    above, above_for, above_against = [0] * n, [0] * n, [0] * n  # groups of all ancestors: as bits, and counted
    mark_rows, mark_cols, seen, first = [], [], 0, 0
    for k, node in enumerate(order):
        up = node.parent
        if up is None:
            seen, first = 0, k
            parent[k] = k
        else:
            parent[k] = at = place[id(up)]
            above[k], above_for[k], above_against[k] = above[at], for_[at], against[at]
            for g in up.groups:
                above[k] |= 1 << g
        root[k], start[k] = first, seen
        marks = [TAGS.get(node.tag, TAGS["div"]), *(n_tags + g for g in node.groups)]
        own = node.groups.count(8)
        for_[k], against[k] = above_for[k] + own, above_against[k] + len(node.groups) - own
        mark_rows += [k] * len(marks)
        mark_cols += marks
        if node.tag == "#text":
            text = node.text
            chars[k], links[k], leaves[k], words[k] = len(text), node.linked, 1, text.count(" ") + 1
            stops[k] = sum(map(text.count, ".,;:!?"))
            seen += len(text)
        else:
            tags[k] = 1
    for k in range(n - 1, -1, -1):
        at = parent[k]
        if at != k:
            chars[at] += chars[k]
            words[at] += words[k]
            links[at] += links[k]
            stops[at] += stops[k]
            tags[at] += tags[k]
            leaves[at] += leaves[k]
    for node in order:
        if node.children:
            at = [place[id(c)] for c in node.children]
            kinds: dict[str, int] = {}
            for c in node.children:
                kinds[c.tag] = kinds.get(c.tag, 0) + 1
            size, count = sum(chars[k] for k in at), len(at)
            for i, (k, c) in enumerate(zip(at, node.children)):
                rank[k], family[k], mean[k], same[k] = i, count, size / count, kinds[c.tag]
                if i:
                    before[k] = chars[at[i - 1]]
                    after[at[i - 1]] = chars[k]
    out = np.zeros((n, N_FEATURES), np.float32)
    out[mark_rows, mark_cols] = 1
    out[:, n_tags + n_groups:n_tags + 2 * n_groups] = np.array(above, np.int64)[:, None] >> np.arange(n_groups) & 1
    number = lambda values: np.array(values, float)
    parent, chars, words, links, family = map(np.array, (parent, chars, words, links, family))
    whole, tags, size = np.maximum(1, chars[np.array(root, int)]), number(tags), np.maximum(1, chars)
    out[:, n_tags + 2 * n_groups:] = np.stack([
        number([node.depth for node in order]), number([len(node.children) for node in order]), number(rank),
        rank / family, family, same / family, np.log1p(chars), np.log1p(words), links / size, chars / (tags + 1),
        words / np.maximum(1, leaves), stops / np.maximum(1, words), chars / whole, start / whole, np.log1p(mean),
        np.log1p(before), np.log1p(after), number([node.hidden for node in order]),
        links[parent] / size[parent], chars / size[parent], against, for_], axis=1)
    return out


class Boosted:
    """Arrays of a fitted Spark GBT classifier; probabilities for a matrix of features."""

    def __init__(self, model):
        self.weights = [float(w) for w in model.treeWeights]
        self.trees = [self._arrays(t._java_obj.rootNode()) for t in model.trees]

    @staticmethod
    def _arrays(root):
        feature, threshold, left, right, value, todo = [], [], [], [], [], [(root, None, None)]
        while todo:
            node, side, of = todo.pop()
            k = len(value)
            if side is not None:
                side[of] = k
            value.append(float(node.prediction()))
            inner = node.getClass().getSimpleName() == "InternalNode"
            feature.append(int(node.split().featureIndex()) if inner else 0)
            threshold.append(float(node.split().threshold()) if inner else np.inf)
            left.append(k)
            right.append(k)
            if inner:
                todo += [(node.leftChild(), left, k), (node.rightChild(), right, k)]
        return [np.array(a) for a in (feature, threshold, left, right, value)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for weight, (feature, threshold, left, right, value) in zip(self.weights, self.trees):
            at = np.zeros(len(x), int)
            while True:
                next_ = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
                if (next_ == at).all():
                    break
                at = next_
            total += weight * value[at]
        return total


def decode(order: list[Node], margin: np.ndarray) -> np.ndarray:
    """Most probable labels in which a node is kept only below kept nodes.

    Keeping a node is worth its log odds (twice the margin of the boosted
    trees); below a dropped node all is dropped.  A container is kept only if
    something in it is.
    """
    place = {id(node): k for k, node in enumerate(order)}
    total, best = (2 * margin).tolist(), [-1] * len(order)
    for k in range(len(order) - 1, -1, -1):
        if order[k].tag != "#text":
            gains = [(total[place[id(c)]], -i) for i, c in enumerate(order[k].children)]
            kept = sum(g for g, _ in gains if g > 0)
            if not kept and gains:  # the best child stands in if none gains
                kept, at = max(gains)
                best[k] = -at
            total[k] = total[k] + kept if gains else -np.inf
    keep = np.zeros(len(order), bool)
    for k, node in enumerate(order):
        if node.parent is None:
            keep[k] = total[k] > 0
        elif keep[up := place[id(node.parent)]]:
            keep[k] = total[k] > 0 or (best[up] >= 0 and node.parent.children[best[up]] is node)
    return keep


def main_text(order: list[Node], keep: np.ndarray) -> str:
    return "\n".join(node.text for node, k in zip(order, keep) if k and node.text)


# ---- training pages -------------------------------------------------------------------------------------------------

def labelled(root: Node) -> tuple[list[Node], np.ndarray] | None:
    """Nodes and labels of a page that marks its main text itself with ``article`` or ``main``."""
    order = nodes(root)
    inside, boiler = set(), {"nav", "header", "footer", "aside", "form"}
    for node in order:
        if node.tag in ("article", "main") or (node.parent and id(node.parent) in inside):
            if not (node.tag in boiler or set(node.groups) & set(range(8)) or node.hidden):
                inside.add(id(node))
    label = np.array([id(node) in inside and bool(node.text) for node in order])
    if not label.any():
        return None
    return order, _containers(order, label)


def _containers(order: list[Node], label: np.ndarray) -> np.ndarray:
    place = {id(node): k for k, node in enumerate(order)}
    for k in range(len(order) - 1, 0, -1):
        if label[k]:
            label[place[id(order[k].parent)]] = True
    return label


MARK = "\ue000"  # private-use sign before main texts while a training page is laid out


def layout(texts: list[str], rng: random.Random) -> str:
    """A page in a random layout whose main texts begin with ``MARK``."""
    esc = lambda t: html.escape(t, quote=False)
    long_ = [t for t in texts if len(t) > 60] or texts
    words = " ".join(texts).split() or ["text"]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    some = lambda kind: rng.choice(TOKENS[kind].split()) + rng.choice(["", "-1", "-box", "_inner", " block", "-wrap"])
    attr = lambda kind: rng.choice([f'class="{some(kind)}"', f'id="{some(kind)}"', f'class="x {some(kind)}"'])
    anchors = lambda n: [f'<a href="#">{esc(pick(rng.randint(1, 3)))}</a>' for _ in range(n)]

    def menu():
        items = anchors(rng.randint(3, 9))
        body = f"<ul>{''.join(f'<li>{a}</li>' for a in items)}</ul>" if rng.random() < .7 else " ".join(items)
        return rng.choice([f"<nav>{body}</nav>", f"<div {attr(0)}>{body}</div>", f'<div role="navigation">{body}</div>'])

    def head():
        body = f"<a href='/'>{esc(pick(2))}</a>" + rng.choice(["", f"<p>{esc(pick(6))}</p>", menu()])
        return rng.choice([f"<header>{body}</header>", f"<div {attr(1)}>{body}</div>"])

    def foot():
        body = rng.choice([f"&copy; {esc(pick(3))} &middot; {esc(pick(8))}", f"<p>{esc(pick(9))}</p>" + "".join(anchors(3)),
                           f"<p>&copy; 2024 {esc(pick(2))}. {esc(pick(12))}.</p>"])
        return rng.choice([f"<footer>{body}</footer>", f"<div {attr(2)}>{body}</div>"])

    def side():
        body = rng.choice([f"<h3>{esc(pick(2))}</h3><ul>{''.join(f'<li>{a}</li>' for a in anchors(5))}</ul>",
                           f"<h2>{esc(pick(2))}</h2><p>{esc(rng.choice(texts)[:200])}</p>", f"<p>{esc(pick(25))}</p>"])
        return rng.choice([f"<aside>{body}</aside>", f"<div {attr(3)}>{body}</div>", f"<section {attr(3)}>{body}</section>"])

    def advert():
        body = rng.choice([esc(pick(rng.randint(3, 14))), f"<p>{esc(rng.choice(long_)[:160])}</p>", anchors(1)[0]])
        return f"<div {attr(4)}>{body}</div>"

    def notice():
        body = f"{esc(pick(rng.randint(8, 25)))}. " + rng.choice(["", "<button>OK</button>", anchors(1)[0]])
        return f"<div {attr(5)}>{rng.choice([body, f'<p>{body}</p>'])}</div>"

    def form():
        body = f"<label>{esc(pick(2))}</label><input name=q><button>{esc(pick(1))}</button>" + rng.choice(["", f"<p>{esc(pick(9))}</p>"])
        return rng.choice([f"<form>{body}</form>", f"<div {attr(6)}><form>{body}</form></div>", f"<div {attr(6)}><p>{esc(pick(8))}</p></div>"])

    def comments():
        each = "".join(f"<{t}><b>{esc(pick(1))}</b><p>{esc(rng.choice(long_)[:rng.randint(30, 400)])}</p></{t}>"
                       for t in [rng.choice(["div", "li"])] * rng.randint(1, 5))
        return rng.choice([f"<section {attr(7)}><h2>{esc(pick(1))}</h2>{each}</section>", f"<div {attr(7)}>{each}</div>"])

    def article():
        body = [t for t in texts if t] or ["text"]
        parts = [f"<h1>{MARK}{esc(body[0][:90])}</h1>"] if rng.random() < .8 else []
        for k, t in enumerate(body):
            kind = rng.random()
            t = esc(t)
            if kind < .1:
                parts.append(f"<h2>{MARK}{t[:60]}</h2>")
            if kind < .75:
                parts.append(f"<p>{MARK}{t}</p>")
            elif kind < .8:
                parts.append(f"<ul><li>{MARK}{t[:120]}</li><li>{MARK}{t[120:300] or t}</li></ul>")
            elif kind < .85:
                parts.append(f"<blockquote>{MARK}{t}</blockquote>")
            elif kind < .9:
                parts.append(f"<div>{MARK}{t}</div>")
            else:
                parts.append(f"<p>{MARK}{t[:len(t) // 2]} <a href='#'>{t[len(t) // 2:][:30]}</a> {t[len(t) // 2 + 30:]}</p>")
            if rng.random() < .05:
                parts.append(rng.choice([advert, form, side, notice])())
        body = "".join(parts)
        return rng.choice([f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>",
                           f"<div {attr(8)}>{body}</div>", f"<div {attr(8)}><div>{body}</div></div>", f"<div>{body}</div>",
                           f"<article {attr(8)}>{body}</article>"])

    top = [f() for f in rng.sample([menu, head, advert, notice, form], rng.randint(1, 4))]
    middle = [article()]
    for f in rng.sample([side, advert, side, form], rng.randint(0, 2)):
        middle.insert(rng.randint(0, len(middle)), f())
    end = [f() for f in rng.sample([comments, side, advert, foot, notice, form, menu], rng.randint(1, 4))]
    inner = "".join(middle)
    if rng.random() < .4:
        inner = f"<div {rng.choice(['', 'class=wrapper', 'id=page'])}>{inner}</div>"
    return f"<html><body>{''.join(top)}{inner}{''.join(end)}</body></html>"


def laid_out(texts: list[str], rng: random.Random) -> tuple[list[Node], np.ndarray]:
    order = nodes(parse(layout(texts, rng)))
    label = np.array([node.text.startswith(MARK) for node in order])
    for node in order:
        node.text = node.text.replace(MARK, "").strip()
    return order, _containers(order, label)


def training_nodes(pages: DataFrame, html_col: str, layouts: int, most_nodes: int) -> DataFrame:
    """(x, label) of the nodes of labelled pages and of ``layouts`` new layouts of each page's texts, at most ``most_nodes`` of each."""
    def run(frames):
        for frame in frames:
            for page in frame["page"]:
                root = parse(page)
                texts = [node.text for node in nodes(root) if node.text]
                if not texts:
                    continue
                rng = random.Random(hashlib.sha256(page.encode()).hexdigest())
                made = [labelled(root), *(laid_out(texts, rng) for _ in range(layouts))]
                for order, label in filter(None, made):
                    x = features([order])
                    if len(x) > most_nodes:
                        some = sorted(rng.sample(range(len(x)), most_nodes))
                        x, label = x[some], label[some]
                    yield pd.DataFrame({"x": list(x.astype(float)), "label": label.astype(float)})
    return (pages.select(F.col(html_col).alias("page")).where("page is not null")
            .mapInPandas(run, "x array<double>, label double"))


def sampled(pages: DataFrame, html_col: str, sample: int, longest: int) -> DataFrame:
    """At most ``sample`` distinct pages by hash; pages of more than ``longest`` characters only where others are too few."""
    h = F.xxhash64(html_col)
    some = pages.where(F.length(html_col) > 0)
    hashes = (some.groupBy(h.alias("h")).agg(F.max(F.length(html_col) > longest).alias("long"))
              .orderBy("long", "h").limit(sample).collect())
    return some.where(h.isin([r["h"] for r in hashes])).groupBy(h.alias("h")).agg(F.min(html_col).alias(html_col)).drop("h")


def fit(pages: DataFrame, html_col: str = "html", sample: int = 300, layouts: int = 3, trees: int = 20,
        depth: int = 5, longest: int = 100_000, most_nodes: int = 20_000) -> Boosted | None:
    """Boosted trees from at most ``sample`` distinct pages; None without any text to learn from."""
    from .common import stored
    chosen = stored(sampled(pages, html_col, sample, longest), "sample").repartition(12)
    rows = stored(training_nodes(chosen, html_col, layouts, most_nodes), "nodes").withColumn("features", array_to_vector("x"))
    if rows.select("label").distinct().count() < 2:
        return None
    return Boosted(GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(
        rows.select("features", "label")))


def extract(pages: DataFrame, model: Boosted | None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(id, url, text) for every row of ``pages``."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                trees = [nodes(parse(page)) for page in part.column(2).to_pylist()]
                stops = np.cumsum([len(t) for t in trees])
                margin = model.margin(features(trees)) if model else np.zeros(int(stops[-1]))
                texts = [main_text(t, decode(t, margin[b - len(t):b])) for t, b in zip(trees, stops)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 ["id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return (pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("page"))
            .mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string")
            .withColumnsRenamed({"id": id_col, "url": url_col}))


def op4_html_main_text(spark, sf_dir):
    """Main text of all ``pages``."""
    from .common import table
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
