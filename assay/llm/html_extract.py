"""HTML extraction: a tree-structured graphical model over the DOM.

Every element and text of a page is a node with a hidden label, content or not. A potential connects each node with its parent, by the node's
tag; another weighs what the node shows: class and id words, how much text it holds, how much of that is linked or ends sentences, and the words of a
short heading. Sum-product messages up the tree and down again give exact marginals; texts with a marginal of one half or more are content. All weights
are trained on labelled pages (`html_pages`) by gradient ascent on the likelihood of their labels, whose gradient the same messages give; there
are no others.

Defined results: null or empty html gives the empty text with 0 characters; scripts, styles, comments and markup never are text;
character references are decoded once; text beyond a broken tag is kept; null ids and urls stay null; repeated rows each give their
own row; pages and attributes of any length are read whole, in time linear in their length; extra columns are not read.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table
from .html_pages import labelled_pages

# Kinds of elements in the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())
# elements whose content is dropped once their own end is met; one that something else ends keeps it
HIDDEN = set("noscript template iframe svg select".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - set("body head html dd dt li option optgroup tbody td tfoot th thead title tr legend summary".split())
# an element of the key is ended by a start of those named, within the elements that bound it
ENDED_BY = {
    "li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr tbody tfoot thead", {"table"}), "td": ("td th tr tbody tfoot", {"table"}),
    "th": ("td th tr tbody tfoot", {"table"}), "thead": ("tbody tfoot", {"table"}), "tbody": ("tbody tfoot", {"table"}), "option": ("option optgroup", {"select"}), "head": ("body", {"html"}),
}
BOUNDS_P = {"td", "th", "table", "button"} | HIDDEN
STARTS: dict[str, list[tuple[str, set]]] = {}
for _k, (_by, _in) in ENDED_BY.items():
    for _t in _by.split():
        STARTS.setdefault(_t, []).append((_k, _in | HIDDEN))

# a start or end with short quoted values, by far the most; then _tag_end() looks for the closing quotes; then one whose quotes don't match
_QUICK = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]{0,1000}\"|'[^']{0,1000}'){0,64}+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_MARK = re.compile(r"[<>\"']")
_ATTR = re.compile(r"(?<![\w-])(class|id|role|y)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
TEXT = "#text"


def _tag_end(source: str, at: int, hopeless: set[int]) -> int:
    """Where the > of a tag stands, past all quoted values; -1 if a quote isn't closed or a < comes first.

    hopeless: quotes from which no > is reached. They are passed over at once, so that many broken tags cost no more than the page is long."""
    passed = []
    while m := _MARK.search(source, at):
        c, at = m[0], m.start()
        if c == ">":
            return at
        if c == "<" or at in hopeless or (close := source.find(c, at + 1)) < 0:
            break
        passed.append(at)
        at = close + 1
    hopeless.update(passed)
    return -1


def _markup(source: str, at: int, hopeless: set[int]):
    """(slash, name, attributes, end) of the tag that begins here, or None."""
    m = _QUICK.match(source, at)
    if m:
        return m[1], m[2].lower(), m[3], m.end()
    if not (m := _NAME.match(source, at)):
        return None
    if (end := _tag_end(source, m.end(), hopeless)) >= 0:
        return m[1], m[2].lower(), source[m.end() : end], end + 1
    m = _LOOSE.match(source, at)
    return (m[1], m[2].lower(), m[3], m.end()) if m else None


def parse(source: str) -> tuple[list[str], list[int], list[str]]:
    """Nodes in page order: tags (TEXT for texts), parents, and attributes of elements or source of texts. Node 0 is the page."""
    tag, parent, data = ["#page"], [-1], [""]
    stack, open_ = [0], Counter()
    hopeless: set[int] = set()

    def pop() -> None:
        open_[tag[stack.pop()]] -= 1

    at, n = 0, len(source)
    while at < n:
        if source.startswith("<!--", at):
            if source.startswith((">", "->"), at + 4):
                at = source.index(">", at) + 1
            else:
                end = source.find("-->", at + 4)
                at = end + 3 if end >= 0 else n
            continue
        if source.startswith(("<!", "<?"), at):
            at = source.find(">", at) + 1 or n
            continue
        found = _markup(source, at, hopeless) if source[at] == "<" else None
        if found is None:
            end = source.find("<", at + 1)
            end = end if end >= 0 else n
            tag.append(TEXT)
            parent.append(stack[-1])
            data.append(source[at:end])
            at = end
            continue
        slash, name, attributes, at = found
        if slash:
            if open_[name]:
                while tag[stack[-1]] != name:
                    pop()
                own = stack[-1]
                pop()
                if name in HIDDEN:
                    del tag[own + 1 :], parent[own + 1 :], data[own + 1 :]
            continue
        if name in CLOSES_P and open_["p"]:
            _end(tag, stack, open_, "p", BOUNDS_P)
        for ended, within in STARTS.get(name, ()):
            if open_[ended]:
                _end(tag, stack, open_, ended, within)
        tag.append(name)
        parent.append(stack[-1])
        data.append(attributes)
        if name in RAW and not attributes.endswith("/"):
            at = _raw_end(source, name, at)
        elif name not in VOID and not attributes.endswith("/"):
            stack.append(len(tag) - 1)
            open_[name] += 1
    return tag, parent, data


def _end(tag, stack, open_, name, within) -> None:
    """End the innermost open element of the name, if nothing that bounds it is nearer."""
    for i in range(len(stack) - 1, 0, -1):
        t = tag[stack[i]]
        if t == name:
            while len(stack) > i:
                open_[tag[stack.pop()]] -= 1
            return
        if t in within:
            return


@lru_cache(maxsize=64)
def _closing(name: str):
    return re.compile(rf"</{re.escape(name)}(?:[\s/][^<>]*)?>", re.I)


def _raw_end(source: str, name: str, at: int) -> int:
    m = _closing(name).search(source, at)
    return m.end() if m else len(source)


def _names(attributes: str) -> set[str]:
    return {w for k, v in _ATTR.findall(attributes) if k.lower() != "y" for w in _WORD.findall(v.lower())} if attributes else set()


def _bucket(n: int) -> int:
    return (n > 12) + (n > 40) + (n > 120) + (n > 400)


# elements that part a page; one without any of them is flat
PARTING = set("article aside div footer form header main nav section table".split())
WHOLE = {"html", "body"}  # these hold all of a page, so what they hold tells nothing
HEADINGS = set("h1 h2 h3 h4 h5 h6 legend summary strong label".split())
_STOPS = re.compile(r"[.!?…](?=\s|$)")
_HEAD_WORD = re.compile(r"[^\W\d_]+")


def features(tag: list[str], parent: list[int], data: list[str]) -> list[list[str]]:
    """What each node shows, as names of weights."""
    n = len(tag)
    out: list[list[str]] = [[] for _ in range(n)]
    size, linked, stops = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        up = parent[i]
        in_link[i] = in_link[up] or tag[i] == "a"
        if tag[i] != TEXT:
            if data[i]:
                out[i] = [f"name:{w}" for w in _names(data[i])]
            continue
        text = data[i].strip()
        if not text:
            continue
        k, marks = len(text), len(_STOPS.findall(text))
        size[i], linked[i], stops[i] = k, k if in_link[i] else 0, marks
        out[i] = [f"text:{_bucket(k)}:{in_link[i]:d}", f"stops:{min(marks, 3)}:{_bucket(k)}"]
        if "&copy;" in text or "©" in text or "&#169;" in text:
            out[i].append("copyright")
        if tag[up] in HEADINGS and k <= 40:
            words = _HEAD_WORD.findall(text.lower())
            if len(words) <= 3 and parent[up] >= 0:
                out[parent[up]] += [f"head:{w}" for w in words]
    holds = [False] * n  # block elements that hold text
    for i in range(n - 1, 0, -1):
        up, own = parent[i], size[i]
        if not own:
            continue
        size[up] += own
        linked[up] += linked[i]
        stops[up] += stops[i]
        if tag[i] != TEXT and tag[i] not in WHOLE:
            share = linked[i] * 4 // own
            out[i].append(f"holds:{share}:{min(stops[i], 4)}" if holds[i] else f"size:{_bucket(own)}:{share}:{min(stops[i], 2)}")
        holds[up] = holds[up] or holds[i] or tag[i] in BLOCK
    if not any(t in PARTING for t in tag):
        out[tag.index("body") if "body" in tag else 0].append("flat")
    plain = max(1, size[0] - linked[0])
    for i in range(1, n):
        if size[i] and tag[i] not in WHOLE:
            part = (size[i] - linked[i]) * 100 // plain
            out[i].append(f"part:{(part >= 4) + (part >= 20) + (part >= 50) + (part >= 90)}:{tag[i]}")
    return out


def _softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


class TreeModel:
    """Weights: of what a node shows, and for each tag of content below other than content (apart) and below content (below).

    With label y and parent's label z, a node's potential is exp(y (sum of weights + (below if z else apart)))."""

    def __init__(self, weights: dict[str, float], edges: dict[str, tuple[float, float]]):
        self.weights, self.edges = weights, edges

    @classmethod
    def fitted(cls, pages: list[str], steps: int = 200, rate: float = 0.3, decay: float = 0.02, least: int = 5) -> "TreeModel":
        """The greatest penalised likelihood of labelled pages, by gradient steps over all pages as one forest."""
        tags, parents, ys, shown = [], [], [], []
        for page in pages:
            tag, parent, data = parse(page)
            first = len(tags)
            label = [0] * len(tag)
            for i in range(1, len(tag)):
                own = dict((k.lower(), v.strip("\"'")) for k, v in _ATTR.findall(data[i])) if tag[i] != TEXT else {}
                label[i] = int(own["y"]) if "y" in own else label[parent[i]]
            tags += tag
            parents += [p + first if p >= 0 else -1 for p in parent]
            ys += label
            shown += features(tag, parent, data)
        n, count = len(tags), Counter(f for fs in shown for f in fs)
        names = sorted(f for f, c in count.items() if c >= least)
        number = {f: k for k, f in enumerate(names)}
        cells = [(i, number[f]) for i, fs in enumerate(shown) for f in fs if f in number]
        node, feature = (np.array(x, np.int64) for x in zip(*cells))
        kinds = sorted(set(tags))
        kind = np.array([kinds.index(t) for t in tags])
        up, y = np.array(parents), np.array(ys, float)
        depth = np.zeros(n, np.int64)
        for i in range(n):
            depth[i] = depth[parents[i]] + 1 if parents[i] >= 0 else 0
        # by depth, so that a level of the forest is a slice
        order = np.argsort(depth, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        up, kind, y, node = np.where(up[order] >= 0, place[up[order]], -1), kind[order], y[order], place[node]
        edge = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        levels = [slice(lo, hi) for lo, hi in zip(edge[:-1], edge[1:])]
        roots, inner = levels[0], slice(edge[1], n)
        side = np.arange(edge[1], n), y[up[inner]].astype(int)
        nk, nf = len(kinds), len(names)
        x = np.zeros(nf + 2 * nk + 2)  # weights, apart and below by tag, apart and below of all tags
        first, second = np.zeros_like(x), np.zeros_like(x)
        for step in range(1, steps + 1):
            apart, below = x[nf : nf + nk][kind] + x[-2], x[nf + nk : nf + 2 * nk][kind] + x[-1]
            belief = np.bincount(node, x[feature], n)
            message = np.zeros(n)
            for above, level in reversed(list(zip(levels, levels[1:]))):
                message[level] = np.logaddexp(0, belief[level] + below[level]) - np.logaddexp(0, belief[level] + apart[level])
                belief[above] += np.bincount(up[level] - above.start, message[level], above.stop - above.start)
            both = np.zeros((n, 2))  # probability of content, with a parent that is none and with one that is
            total = belief.copy()
            total[roots] = -40.0  # what a body stands in is no content
            for level in levels[1:]:
                rest = total[up[level]] - message[level]
                q = 1 / (1 + np.exp(-np.clip(rest, -500, 500)))
                one, two = np.exp(np.clip(belief[level] + apart[level], -500, 500)), np.exp(np.clip(belief[level] + below[level], -500, 500))
                z = (1 - q) * (1 + one) + q * (1 + two)
                both[level, 0], both[level, 1] = (1 - q) * one / z, q * two / z
                p = both[level].sum(axis=1)
                total[level] = np.log(np.maximum(p, 1e-300)) - np.log(np.maximum(1 - p, 1e-300))
            error = np.zeros((n, 2))
            error[side] = y[inner]
            error[inner] -= both[inner]
            g = np.zeros_like(x)
            g[:nf] = np.bincount(feature, error.sum(axis=1)[node], nf)
            g[nf : nf + nk], g[nf + nk : nf + 2 * nk] = np.bincount(kind, error[:, 0], nk), np.bincount(kind, error[:, 1], nk)
            g[-2:] = error.sum(axis=0)
            g -= decay * x
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            x = x + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        edges = {t: (float(x[nf + k] + x[-2]), float(x[nf + nk + k] + x[-1])) for k, t in enumerate(kinds)}
        return cls(dict(zip(names, x[:nf].tolist())), edges | {"": (float(x[-2]), float(x[-1]))})

    def potentials(self, tag: list[str], parent: list[int], data: list[str]) -> tuple[list[float], list[tuple[float, float]]]:
        get, other = self.weights.get, self.edges[""]
        return [sum(get(f, 0.0) for f in fs) for fs in features(tag, parent, data)], [self.edges.get(t, other) for t in tag]

    def marginals(self, tag: list[str], parent: list[int], data: list[str]) -> list[float]:
        """The probability of content for every node: exact, by messages up and then down. A page without a body element is one itself."""
        belief, edge = self.potentials(tag, parent, data)
        n = len(tag)
        message = [0.0] * n
        for i in range(n - 1, 0, -1):
            a, b = edge[i]
            o = belief[i]
            message[i] = _softplus(o + b) - _softplus(o + a)
            belief[parent[i]] += message[i]
        belief[0] += -40.0 if "body" in tag else self.edges.get("body", self.edges[""])[0]
        for i in range(1, n):
            # the parent's belief without this child's own message, handed down
            q = _sigmoid(belief[parent[i]] - message[i])
            a, b = edge[i]
            top = max(a, b)
            lift = top + math.log((1 - q) * math.exp(a - top) + q * math.exp(b - top))
            belief[i] += lift
        return [_sigmoid(x) for x in belief]


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    return TreeModel.fitted(labelled_pages())


def main_text(source: str | None, model: TreeModel | None = None) -> str:
    """Blocks of content, in page order, joined by blank lines."""
    if not source:
        return ""
    tag, parent, data = parse(source)
    p = (model or default_model()).marginals(tag, parent, data)
    # the block a text stands in changes with every start and every end of a block element
    n = len(tag)
    block_of, last_child = [0] * n, list(range(n))
    for i in range(n - 1, 0, -1):
        last_child[parent[i]] = max(last_child[parent[i]], last_child[i])
    blocks, current, ends = [], [], Counter()
    for i in range(1, n):
        if ends.pop(i, 0) and current:
            blocks.append(current)
            current = []
        t = tag[i]
        if t == TEXT:
            if p[i] >= 0.5:
                current.append(htmllib.unescape(data[i]))
        elif t == "br":
            current.append(" ")
        elif t in BLOCK:
            if current:
                blocks.append(current)
                current = []
            ends[last_child[i] + 1] += 1
    blocks.append(current)
    return "\n\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""

    model = default_model()  # a few hundred weights, fitted on the driver

    def run(batch):
        texts = [main_text(h, model) for h in batch.column("html").to_pylist()]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
