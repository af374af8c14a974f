"""HTML extraction with a tree-structured graphical model.

A page becomes a tree: block-level elements and runs of text between block boundaries.
Every node has a binary label, main text or not. A node's own evidence is a
log-linear function of its tag, the words of its class, id and role, its length and its share
of link text; the potential of a parent and child pair is the conditional probability of
their labels. Both are trained on labelled pages (html_pages), the evidence by the
likelihood of whole trees. Sum-product messages pass from
the leaves to the root and back, for all pages of a batch at once, level by level, and
leave each node its exact marginal; runs of text that are likelier main text than not
are the result.

Defined results: null and empty html have an empty text; markup that ends early ends at the last
whole tag, unclosed elements end where their parents do; pages are read one by one, so
repeated rows do not matter; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._shared import read_schema, table
from .html_pages import Pages

# Fixed values of HTML: elements by their roles in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe ins label legend li main menu nav noembed noframes noscript ol optgroup option p pre script search "
    "section select style summary svg table tbody td template textarea tfoot th thead title tr ul video audio object canvas xmp".split()
)
#: An opening tag ends an open element of these, up to the nearest of the second list.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "optgroup")),
    "body": (("head",), ("html",)),
}
#: Elements that hold running text; with other elements and runs they are the kinds of a
#: child whose label depends on its parent's in its own way.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr tbody thead pre blockquote figcaption caption".split())
ELEMENT, TEXT_ELEMENT, RUN = 0, 1, 2
#: A paragraph stays open across these.
P_SCOPE = ("td", "th", "button", "caption", "object", "table", "html")
P_KEEPS = frozenset("button label select option optgroup ins svg video audio canvas object".split())

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?|["'=]""")
#: Attributes that are read from pages, and the one that labels training pages.
NAMING, LABEL = frozenset(("class", "id", "role")), "data-y"
_NAME = re.compile(r"[a-z]+")


class Tree:
    """Nodes of many pages: parent, depth, kind, features and text of runs. Labels are read from
    training pages only. Of the words of names those of a vocabulary are kept, if one is given; others
    have no weight."""

    def __init__(self, training: bool = False, vocabulary: frozenset[str] | None = None):
        self.training, self.vocabulary = training, vocabulary
        self.parent, self.depth, self.features, self.text, self.label, self.page, self.kind = [], [], [], [], [], [], []

    def add(self, parent: int, page: int, label: int, kind: int = ELEMENT) -> int:
        self.kind.append(kind)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.page.append(page)
        self.label.append(label)
        self.features.append(None)
        self.text.append(None)
        return len(self.parent) - 1

    def named(self, attrs: str, label: int) -> tuple[list[str], int]:
        """The words of an element's names, and its label."""
        words: list[str] = []
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), next(filter(None, values), "")
            if name in NAMING:
                words += [w for w in _NAME.findall(value.lower()) if self.vocabulary is None or w in self.vocabulary]
            elif name == "hidden" or (name == "aria-hidden" and value != "false"):
                words.append("hidden")
            elif name == LABEL and self.training:
                label = int(value)
        return words, label

    def parse(self, source: str, page: int) -> None:
        root = self.add(-1, page, 0)
        # open elements: (tag, node of the nearest block, inside a link); where each tag is open
        stack: list[tuple[str, int, bool]] = [("", root, False)]
        opened: dict[str, list[int]] = {}
        blocks: list[int] = []
        names: dict[int, tuple[str, list[str]]] = {root: ("", [])}
        chars: dict[int, list[int]] = {root: [0, 0, 0]}  # text, link text, runs
        run: list[str] = []
        size = [0, 0]
        runs: list[tuple[int, int, int]] = []

        def flush() -> None:
            if run:
                text = " ".join("".join(run).split())
                if text:
                    _, above, _ = stack[-1]
                    leaf = self.add(above, page, self.label[above], RUN)
                    self.text[leaf] = text
                    runs.append((leaf, size[0], size[1]))
                run.clear()
            size[0] = size[1] = 0

        def last(tags) -> int:
            return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

        def push(tag: str, above: int, linked: bool) -> None:
            opened.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append((tag, above, linked))

        def close(to: int) -> None:
            if blocks and blocks[-1] >= to:
                flush()
            while len(stack) > to:
                tag, _, _ = stack.pop()
                opened[tag].pop()
                if tag in BLOCK:
                    blocks.pop()

        def say(raw: str) -> None:
            if raw:
                text = html.unescape(raw) if "&" in raw else raw
                run.append(text)
                n = len(text.strip())
                size[0] += n
                if stack[-1][2]:
                    size[1] += n

        at, end, length = 0, 0, len(source)
        while at < length:
            m = _TAG.search(source, at)
            if m is None:
                say(source[at:])
                break
            say(source[at : m.start()])
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                k = last((tag,))
                # the end of an inline element doesn't reach out of its block
                if k and (tag in BLOCK or not blocks or blocks[-1] < k):
                    close(k)
                continue
            if not m[2]:
                continue
            if not m[0].endswith(">"):
                break  # the page ends inside a tag
            tag, attrs = m[2].lower(), m[3]
            if tag in BLOCK and tag not in P_KEEPS:
                flush()
                k = last(("p",))
                if k > last(P_SCOPE):
                    close(k)
            if tag in ENDS:
                ended, stop = ENDS[tag]
                least = last(stop)
                while (k := last(ended)) > least:
                    close(k)
            if tag in VOID:
                if tag == "br":
                    run.append(" ")
                elif tag == "hr":
                    flush()
                continue
            _, above, linked = stack[-1]
            if tag in BLOCK:
                flush()
                words, label = self.named(attrs, self.label[above])
                above = self.add(above, page, label, TEXT_ELEMENT if tag in TEXTUAL else ELEMENT)
                names[above], chars[above] = (tag, words), [0, 0, 0]
            push(tag, above, linked or tag == "a")
            if tag in RAW:
                close_at = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                end = close_at.start() if close_at else length
                say(source[at:end])
                close(len(stack) - 1)
                at = length
                if close_at:
                    gt = source.find(">", end)
                    at = gt + 1 if gt >= 0 else length
        flush()
        for leaf, n, linked_n in runs:
            c = chars[self.parent[leaf]]
            c[0] += n
            c[1] += linked_n
            c[2] += 1
        for node in reversed(names):  # children come after their parents
            if node != root:
                chars[self.parent[node]] = [a + b for a, b in zip(chars[self.parent[node]], chars[node], strict=True)]
        for node, (tag, words) in names.items():
            n, linked_n, many = chars[node]
            self.features[node] = ["text element" if tag in TEXTUAL else "element", f"tag={tag}", *{f"word={w}" for w in words}, *{f"tag={tag} word={w}" for w in words}, f"size={_bucket(n, 10)}", f"links={_share(linked_n, n)}", f"runs={_bucket(many, 4)}", f"tag={tag} links={_share(linked_n, n)}", f"tag={tag} in={names.get(self.parent[node], ('',))[0]}"]
        for leaf, n, linked_n in runs:
            tag, words = names[self.parent[leaf]]
            stop = self.text[leaf][-1] in ".!?"
            self.features[leaf] = ["run", f"of={tag}", *{f"of word={w}" for w in words}, f"run size={_bucket(n, 8)}", f"run links={_share(linked_n, n)}", f"run stop={stop}"]


def _bucket(n: int, most: int) -> int:
    return 0 if n == 0 else min(most, n.bit_length())


def _share(part: int, whole: int) -> int:
    return -1 if not whole else min(4, 5 * part // whole)


class Shape:
    """Parents, kinds and levels of a forest, for message passing."""

    def __init__(self, tree: Tree):
        self.parent, self.kind = np.array(tree.parent, np.int64), np.array(tree.kind, np.int64)
        depth = np.array(tree.depth, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


def sum_product(score: np.ndarray, shape: Shape, pairs: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(main text) of every node: messages from the leaves to the roots, then back.
    score: ln of a node's evidence for main text against the rest."""
    n = len(score)
    parent, up, message, down = shape.parent, np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2))
    up[:, 1] = score
    for nodes in reversed(shape.levels[1:]):
        pair = pairs[shape.kind[nodes]]  # child, parent's label, label
        message[nodes] = np.logaddexp(pair[:, :, 0] + up[nodes, None, 0], pair[:, :, 1] + up[nodes, None, 1])
        np.add.at(up, parent[nodes], message[nodes])
    for level, nodes in enumerate(shape.levels):
        if level == 0:
            down[nodes] = prior
            continue
        above = down[parent[nodes]] + up[parent[nodes]] - message[nodes]
        pair = pairs[shape.kind[nodes]]
        down[nodes] = np.logaddexp(pair[:, 0, :] + above[:, :1], pair[:, 1, :] + above[:, 1:])
    both = up + down
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))


class Model:
    """Evidence weights by feature, the roots' prior, and the pair potentials
    log P(child | parent) by the child's kind."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray, prior: np.ndarray):
        self.weights, self.pairs, self.prior = weights, pairs, prior
        self.vocabulary = frozenset(f.rpartition("word=")[2] for f in weights if "word=" in f)

    def marginals(self, tree: Tree) -> np.ndarray:
        get = self.weights.get
        score = np.array([sum(get(f, 0.0) for f in fs) for fs in tree.features])
        return sum_product(score, Shape(tree), self.pairs, self.prior)


@functools.lru_cache(maxsize=1)
def train(n_pages: int = 1000, seed: int = 5, rounds: int = 150) -> Model:
    """Fit the model to generated labelled pages: pair potentials from counts, evidence by
    the conditional likelihood of whole trees, whose gradient compares the marginals with
    the labels."""
    tree, pages = Tree(training=True), Pages(seed)
    for k in range(n_pages):
        tree.parse(pages.page(), k)
    y, shape = np.array(tree.label, float), Shape(tree)
    pairs = np.zeros((3, 2, 2))
    for kind in (ELEMENT, TEXT_ELEMENT, RUN):
        mine = np.flatnonzero((shape.kind == kind) & (shape.parent >= 0))
        for a in (0, 1):
            for b in (0, 1):
                pairs[kind, a, b] = 1 + np.sum((y[shape.parent[mine]] == a) & (y[mine] == b))
        pairs[kind] /= pairs[kind].sum(axis=1, keepdims=True)
    pairs, prior = np.log(pairs), np.log(np.array([0.99, 0.01]))
    names = {f: i for i, f in enumerate(sorted({f for fs in tree.features for f in fs}))}
    flat = np.array([names[f] for fs in tree.features for f in fs])
    sizes = np.array([len(fs) for fs in tree.features])
    node, begins = np.repeat(np.arange(len(y)), sizes), np.append(0, np.cumsum(sizes)[:-1])
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-6)
    for _ in range(rounds):  # AdaGrad
        p = sum_product(np.add.reduceat(w[flat], begins), shape, pairs, prior)
        grad = np.bincount(flat, (p - y)[node], len(names)) + 0.05 * w
        g2 += grad * grad
        w -= 0.4 * grad / np.sqrt(g2)
    return Model(dict(zip(names, w.tolist(), strict=True)), pairs, prior)


def extract(pages: list[str], model: Model) -> list[str]:
    """The main text of each page, one line a block."""
    tree = Tree(vocabulary=model.vocabulary)
    for k, source in enumerate(pages):
        tree.parse(source, k)
    out: list[list[str]] = [[] for _ in pages]
    for text, p, page in zip(tree.text, model.marginals(tree).tolist(), tree.page, strict=True):
        if text is not None and p > 0.5:
            out[page].append(text)
    return ["\n".join(x) for x in out]


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(train())  # some thousand weights, by the generator's bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = extract([x or "" for x in part.column(2).to_pylist()], model)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, read_schema(("page_id", rows.schema["page_id"].dataType), ("url", rows.schema["url"].dataType), ("text", T.StringType()), ("n_chars", T.LongType())))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
