"""Main text of web pages (operator 3): a tree-structured graphical model over the DOM.

Every block element and every block of text is a node that is content or not.
A node's features give it a unary potential, a parent and its child share a
pairwise one.  Sum-product messages go up and down the tree and give each
block's probability of being content.

Names of elements, classes and ids that pages give to what is not their article
are one feature among others, and so is standing beside the article of a page
that marks one.  Weights are counted on pages that mark their article; a part
inside an article that bears such a name is left out of the counts, as its label
is not known, and the list of names enters by counts given in advance.

A sample whose articles hold only paragraphs would teach that lists, tables and
code are menus.  Elements of running text therefore share one class: what the
sample says for or against one of them is bounded by what a parent tells its
child, so that inside an article each is content unless something else speaks
against it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

# Element names of HTML by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math title textarea object canvas".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: What an opening tag ends when it is open: (what is ended, where the search stops).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Names of elements, classes and ids by which pages mark what is not their article.
APART = set(
    "nav aside footer header form button select option label input dialog menu ad ads advert advertisement adverts banner "
    "sponsor sponsored promo sidebar widget comment comments reply replies discussion disqus cookie cookies consent notice "
    "notices gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended breadcrumb "
    "breadcrumbs pagination pager toolbar navbar navigation topbar copyright legal disclaimer masthead skip search tags response responses".split()
)
#: Elements of running text: whatever a sample's articles hold, any of them may stand in an article.
FLOW = set(
    "p h1 h2 h3 h4 h5 h6 hgroup ul ol dl li dt dd pre blockquote table caption colgroup thead tbody tfoot tr td th figure "
    "figcaption address details summary hr section center".split()
)
PASSAGE = set("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: Bounds of what is learned: for an element of running text, for its text's length and end, for other elements, for a node beside the article.
FLOW_BOUNDS, LOOK_BOUNDS, OTHER_BOUNDS, BESIDE_BOUNDS = (0.0, 1.0), (-1.5, 2.5), (-2.0, 2.0), (-4.0, 0.0)
#: Raw elements that, never closed, end with their own tag and not with the page.
OPEN_ENDED = set("iframe svg math object canvas noscript template".split())
#: Words of a class name that stand beside the one that says what it is, and those before it that make it a property of the page.
BESIDE = set("box block area section container wrapper wrap list item inner outer bar panel row col left right top bottom fixed sticky main page site global".split())
PROPERTY = set("has no with without is not hide show".split())
#: Elements whose names of classes say nothing about a part of the page.
WHOLE = ("html", "body", "article", "main")
#: Counts given in advance: (feature, label) -> number of nodes; and the share of an article's parts that are not content.
GIVEN = {("apart", 0): 1000.0, ("under", 0): 1000.0, ("named", 0): 10.0, ("main", 1): 20.0}
APART_SHARE = 0.05
MAIN = set("article main content post entry story body text".split())
#: Words that say little about a page's own parts.
ROLE_SPLIT = re.compile(r"[^a-z]+")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z](?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^<>]*(?:>|\Z)",
    re.S,
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ROLE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Tree:
    """Nodes of one page: parent, features, and for text blocks their text."""

    __slots__ = ("parent", "features", "text", "tags")

    def __init__(self) -> None:
        self.parent, self.features, self.text, self.tags = [-1], [("tag=#root",)], [None], ["#root"]

    def add(self, parent: int, features: tuple, text: str | None, tag: str) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.tags.append(tag)
        return len(self.parent) - 1


def _names(token: str) -> list[list[str]]:
    """The words of each class, id and role name of a tag."""
    if "=" not in token:
        return []
    values = (g for groups in ROLE.findall(token) for g in groups if g)
    return [words for value in values for name in value.lower().split() if (words := [w for w in ROLE_SPLIT.split(name) if w])]


def _names_apart(words: list[str]) -> bool:
    """Whether a name's main word, its last but for words that stand beside it, is one of APART."""
    own = [w for w in words if w not in BESIDE]
    return bool(own) and words[0] not in PROPERTY and (own[-1] in APART or own[-1].removesuffix("s") in APART)


def _element_features(tag: str, token: str, under: bool, inside: bool) -> tuple:
    names = _names(token)
    found = [f"tag={tag}", *(f"word={w}" for w in sorted({w for words in names for w in words}))]
    if tag in WHOLE:
        found += ["main"] * (tag in ("article", "main"))
    elif tag in PASSAGE and any(map(_names_apart, names)):
        found.append("named")  # a name of one passage says less than that of a part of the page
    elif any(map(_names_apart, names)) or (tag in APART and not (inside and tag == "header")):  # an article's header has its title
        found.append("apart")
    elif any(w in MAIN for words in names for w in words):
        found.append("main")
    if under and tag not in ("article", "main"):
        found.append("under")
    return tuple(found)


def _is_apart(features: tuple) -> bool:
    return "apart" in features or "under" in features


def _block_features(tag: str, text: str, linked: int, under: bool) -> tuple:
    n = len(text)
    share = 2 if 2 * linked >= n else int(linked > 0)
    return ("block", f"in={tag}", f"size={min(n, 4000).bit_length()}", f"linked={share}", f"stop={int(text[-1] in '.!?:;…')}", *["under"] * under)


def parse(page: str) -> Tree:
    """The page's tree; text inside scripts, styles and other raw elements is left out.

    Counters of open elements and the place of the nearest open block stand in
    for searches of the whole stack, so deep nesting takes time in proportion.
    """
    tree = Tree()
    stack: list[tuple[str, int, int]] = [("#root", 0, 0)]  # name, node of the nearest block element, its place in the stack
    is_open: Counter = Counter()
    within: list[bool] = [False]  # of each node: inside a marked article
    pieces: list[str] = []
    linked = [0]

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                node = stack[-1][1]
                tree.add(node, _block_features(tree.tags[node], text, linked[0], _is_apart(tree.features[node])), text, "#text")
                within.append(within[node])
        linked[0] = 0

    def close(k: int) -> None:
        if stack[-1][2] >= k:
            flush()
        for name, _, _ in stack[k:]:
            is_open[name] -= 1
        del stack[k:]

    def words(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if is_open["a"]:
                linked[0] += len(text)

    at, size = 0, len(page)
    while at < size:
        match = TOKEN.search(page, at)
        if not match:
            words(page[at:])
            break
        words(page[at : match.start()])
        token, at = match[0], match.end()
        named = NAME.match(token)
        if not named:
            continue
        tag = named[1].lower()
        if token[1] == "/":
            if is_open[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            if not token.endswith("/>"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else at if tag in OPEN_ENDED else size
            pieces.append(" ")
            continue
        if tag == "br":
            pieces.append("\n")
        if tag in INLINE:
            if tag not in VOID and not token.endswith("/>"):
                stack.append((tag, *stack[-1][1:]))
                is_open[tag] += 1
            continue
        if tag in CLOSES_P:
            if stack[stack[-1][2]][0] == "p":
                close(stack[-1][2])
        elif tag in ENDS:
            ended, stop = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1) if any(is_open[name] for name in ended) else ():
                if stack[k][0] in ended:
                    close(k)
                    break
                if stack[k][0] in stop:
                    break
        flush()
        above = stack[-1][1]
        inside = is_open["article"] > 0 or is_open["main"] > 0
        node = tree.add(above, _element_features(tag, token, _is_apart(tree.features[above]), inside), None, tag)
        within.append(inside or tag in ("article", "main"))
        if tag not in VOID and not token.endswith("/>"):
            stack.append((tag, node, len(stack)))
            is_open[tag] += 1
    flush()
    if any(within):
        tree.features = [f if own or tag in ("#root", "html", "body") else (*f, "beside") for f, own, tag in zip(tree.features, within, tree.tags)]
    return tree


def weak_labels(tree: Tree) -> list[int | None] | None:
    """Labels of a page that marks its article, whether a node is inside it; None for other pages.

    A node inside that bears a name of what is set apart, or stands below one that does, has the label None.
    """
    label, inside = [], []
    marked = False
    for parent, features, tag in zip(tree.parent, tree.features, tree.tags):
        own = tag in ("article", "main") or (parent >= 0 and inside[parent])
        marked |= own
        inside.append(own)
        label.append(None if own and _is_apart(features) else int(own))
    return label if marked else None


class Model:
    """Log-odds of features and the two-by-two table of parents and children."""

    def __init__(self, weights: dict[str, float], pair: np.ndarray, prior: float):
        self.weights, self.pair, self.prior = weights, pair, prior

    @classmethod
    def of_counts(cls, counts: dict[tuple[str, int], float], smooth: float = 1.0) -> Model:
        pair = np.full((2, 2), smooth)
        nodes, seen = np.full(2, smooth), {}
        for (feature, label), n in [*counts.items(), *GIVEN.items()]:
            if feature.startswith("pair="):
                pair[int(feature[5]), label] += n
            elif feature == "node":
                nodes[label] += n
            else:
                seen.setdefault(feature, np.full(2, smooth))[label] += n
        pair[1, 0] += APART_SHARE * pair[1].sum()  # such parts are left out of the counts
        more = {feature: n for (feature, _), n in GIVEN.items()}  # of such nodes and of others, so that it shifts no other feature
        weights = {f: float(np.log(c[1] / (nodes[1] + more.get(f, 0.0))) - np.log(c[0] / (nodes[0] + more.get(f, 0.0)))) for f, c in seen.items()}
        return cls(weights, np.log(pair / pair.sum(axis=1, keepdims=True)), float(np.log(nodes[1] / nodes[0])))

    def odds(self, features: tuple) -> float:
        """Log-odds of one node: names and links as learned, elements, lengths and ends within their bounds."""
        total = look = 0.0
        flow = False
        for f in features:
            w = self.weights.get(f, 0.0)
            kind, _, value = f.partition("=")
            if kind == "tag" or (kind == "in" and value in FLOW):
                flow = value in FLOW
                w = min(max(w, (FLOW_BOUNDS if flow else OTHER_BOUNDS)[0]), (FLOW_BOUNDS if flow else OTHER_BOUNDS)[1]) if value not in WHOLE else w
            elif kind in ("size", "stop"):
                look, w = look + w, 0.0
            elif kind == "beside":
                w = min(max(w, BESIDE_BOUNDS[0]), BESIDE_BOUNDS[1])
            total += w
        return total + (min(max(look, LOOK_BOUNDS[0]), LOOK_BOUNDS[1]) if flow else look)

    def marginals(self, trees: list[Tree]) -> np.ndarray:
        """Probability of content for all nodes of the trees, laid end to end."""
        sizes = [len(t.parent) for t in trees]
        shift = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        parent = np.fromiter((p for t in trees for p in t.parent), np.int64, sum(sizes))
        root = parent < 0
        parent = np.where(root, 0, parent + shift)
        depth = [0] * len(parent)
        for k, (p, r) in enumerate(zip(parent.tolist(), root.tolist())):
            depth[k] = 0 if r else depth[p] + 1
        depth = np.array(depth)
        memo: dict[tuple, float] = {}
        odds = []
        for t in trees:
            for f in t.features:
                v = memo.get(f)
                if v is None:
                    v = memo[f] = self.odds(f)
                odds.append(v)
        belief = np.zeros((len(parent), 2))
        belief[:, 1] = odds
        belief[root, 0] += 2.0  # a page as a whole is not its article
        in_order = np.argsort(depth, kind="stable")
        by_depth = np.split(in_order, np.flatnonzero(np.diff(depth[in_order])) + 1) if len(depth) else []
        up = np.zeros_like(belief)  # messages to the parents
        for rows in reversed(by_depth[1:]):
            b = belief[rows]
            up[rows] = np.logaddexp(b[:, :1] + self.pair[:, 0], b[:, 1:] + self.pair[:, 1])
            np.add.at(belief, parent[rows], up[rows])
        for rows in by_depth[1:]:
            rest = belief[parent[rows]] - up[rows]  # the parent without what this child told it
            rest -= rest.max(axis=1, keepdims=True)
            belief[rows] += np.logaddexp(rest[:, :1] + self.pair[0], rest[:, 1:] + self.pair[1])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


def train(pages: DataFrame, key: str, column: str, sample: int = 600, features: int = 5000) -> Model:
    """Count features and parent-child pairs on the ``sample`` pages whose keys hash lowest.

    Labels come from :func:`weak_labels`; the ``features`` most frequent counts are kept.
    """
    ids = pages.select(F.col(key).alias("k")).orderBy(F.xxhash64("k"), "k").limit(sample).distinct()
    rows = materialize(pages.select(F.col(key).alias("k"), F.col(column).alias("html")).join(F.broadcast(ids), "k").select("html"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()
        for batch in batches:
            for cell in batch.column(0):
                tree = parse(cell.as_py() or "")
                labels = weak_labels(tree)
                if labels is None:
                    continue
                for parent, features, label in zip(tree.parent, tree.features, labels):
                    if label is None:
                        continue
                    got["node", label] += 1
                    if parent >= 0:
                        got[f"pair={labels[parent]}", label] += 1
                    for f in features:
                        got[f, label] += 1
        yield pa.RecordBatch.from_pydict(
            {"feature": pa.array([k[0] for k in got], pa.string()), "label": pa.array([k[1] for k in got], pa.int32()), "n": pa.array(list(got.values()), pa.int64())}
        )

    counted = rows.mapInArrow(count, "feature string, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n"))
    kept = counted.orderBy(F.desc("n"), "feature", "label").limit(features).collect()
    return Model.of_counts({(r.feature, r.label): r.n for r in kept})


PAGES_AT_ONCE = 64


def extract(pages: DataFrame, column: str, model: Model, out: str = "text", threshold: float = 0.5) -> DataFrame:
    """Replace ``column`` by ``out``, the text of all blocks whose marginal exceeds the threshold.

    White space inside a block becomes one space, blocks are joined by a line
    feed.  A null or empty page has the empty text.  Other columns pass through;
    one already named ``out`` is replaced.
    """
    names = [n for n in pages.columns if n not in (column, out)]
    schema = T.StructType([pages.schema[n] for n in names]).add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for a in range(0, batch.num_rows, PAGES_AT_ONCE):
                trees = [parse(cell.as_py() or "") for cell in batch.column(len(names)).slice(a, PAGES_AT_ONCE)]
                content = model.marginals(trees) > threshold
                at = 0
                for tree in trees:
                    flags = content[at : at + len(tree.text)]
                    texts.append("\n".join(t for t, keep in zip(tree.text, flags) if t and keep))
                    at += len(tree.text)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{column}`").alias("__html")).mapInArrow(run, schema)
