"""Main text of web pages.

A page becomes a flat list of text blocks. Each block is described by its word count, link density and container, and by
the word count and link density of the blocks before and after it; a decision tree, trained on the labelled table below,
says which blocks are the article's. Character references are decoded once, white space inside a block becomes one
space, empty blocks go, and the blocks that stay are joined in page order by a line feed. Nothing is capped.

Edge cases: null or empty html gives an empty text; markup that is never closed ends with the page, and so does an open
comment or element whose content is no markup (script, style, noscript, template, textarea, iframe, title); the head ends at the first text or element
that can't stand in it, whether it is closed or not; an open button,
list of options, drawing, formula, object or canvas ends with the element around it, or where an article begins; repeated rows give repeated results; only the three named columns are read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.columnar import map_batches

#: Names of the document language.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|title"
RAW_NAMES = frozenset(RAW.split("|"))
#: Elements with markup inside whose text is never shown as part of an article.
UNSEEN = frozenset("svg object math canvas select option optgroup datalist button".split())
#: Elements without an end tag; start tags that end an open drawing or formula, unless one of the third kind is open in it.
HEAD = frozenset("base basefont bgsound link meta".split())  # what can stand in the head, besides elements whose content is no markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKOUT = frozenset("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INTEGRATION = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
CHROME = frozenset("nav footer aside form menu dialog".split())
CONTENT = frozenset(("article", "main"))
TRACKED = frozenset("article main nav footer header aside form menu dialog div section ul ol dl table figure td blockquote p span li".split()) - {"p", "span", "li"}
#: Words of class, id and role that mark what surrounds an article.
CHROME_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot "
    "masthead comment comments commentlist reply replies respond disqus discussion notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended widget toolbar pagination pager search form contentinfo complementary tags tagcloud copyright legal disclaimer skip".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>%s)(?=[\s/>])(?!\s*/>)(?:[^>"']+|"[^"]*"|'[^']*')*+(?<![\s"']/)>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>"']+|"[^"]*"|'[^']*')*+)>|<[!?/a-z][^>]*>""" % RAW, re.I | re.S)  # noqa: UP031
_NAMED = re.compile(r"""(?<![\w:.-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s/=]|$)(?!\s*=\s*["']?(?:false|until))|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SELF_CLOSED = re.compile(r"""(?:^|[\s"']|\s[^\s=]+)/\Z""")
_PARTS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Labelled blocks: words, link density, the same two of the block before and after, chrome container, content container, heading; then 1 for article text.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "chrome", "content", "heading")
LABELLED = """
1 1.0 0 0.0 1 1.0 1 0 0 0
1 1.0 1 1.0 1 1.0 1 0 0 0
3 1.0 2 1.0 4 1.0 1 0 0 0
6 0.0 1 1.0 9 0.0 1 0 0 0
7 0.0 3 1.0 60 0.0 1 0 0 0
40 0.0 2 1.0 80 0.0 1 0 0 0
120 0.0 90 0.0 40 0.0 1 0 0 0
25 0.1 30 0.0 0 0.0 1 0 0 0
9 0.0 50 0.0 0 0.0 1 0 0 0
4 0.0 12 0.0 3 0.0 1 0 1 0
30 0.0 70 0.0 20 0.0 1 1 0 0
8 0.5 90 0.0 12 0.0 1 1 0 0
3 0.0 60 0.0 18 0.0 1 1 1 0
55 0.0 20 0.0 10 0.0 1 1 0 0
6 1.0 110 0.0 6 1.0 1 1 0 0
9 0.0 7 0.0 80 0.0 0 1 1 1
2 0.0 1 1.0 30 0.0 0 1 1 1
12 0.0 5 0.0 2 0.0 0 1 1 1
5 1.0 6 1.0 60 0.0 0 1 1 1
80 0.0 9 0.0 95 0.0 0 1 0 1
95 0.02 80 0.0 60 0.0 0 1 0 1
60 0.1 40 0.0 0 0.0 0 1 0 1
1 0.0 50 0.0 1 0.0 0 1 0 1
2 0.0 70 0.0 20 0.0 0 1 0 1
3 0.0 2 0.0 9 0.0 0 1 0 1
1 0.0 9 0.0 8 0.0 0 1 0 1
5 0.2 30 0.0 40 0.0 0 1 0 1
20 0.4 30 0.0 40 0.1 0 1 0 1
14 0.5 90 0.0 70 0.0 0 1 0 1
4 1.0 60 0.0 55 0.0 0 1 0 1
2 1.0 45 0.0 30 0.0 0 1 0 1
300 0.0 0 0.0 0 0.0 0 1 0 1
8 0.0 0 0.0 0 0.0 0 1 0 1
60 0.0 50 0.0 1 1.0 0 1 0 1
8 0.0 30 0.0 2 1.0 0 1 0 1
4 1.0 20 0.0 5 1.0 0 1 0 1
9 0.6 3 1.0 4 1.0 0 1 0 1
6 0.0 2 1.0 3 1.0 0 1 1 1
70 0.0 0 0.0 90 0.0 0 0 0 1
90 0.05 70 0.0 60 0.0 0 0 0 1
60 0.0 90 0.05 0 0.0 0 0 0 1
35 0.1 60 0.0 50 0.0 0 0 0 1
20 0.0 40 0.0 30 0.0 0 0 0 1
18 0.0 12 0.0 60 0.0 0 0 0 1
12 0.0 60 0.0 70 0.0 0 0 0 1
7 0.0 40 0.0 80 0.0 0 0 0 1
3 0.0 90 0.0 50 0.0 0 0 0 1
8 0.0 2 1.0 60 0.0 0 0 1 1
6 0.0 50 0.0 70 0.0 0 0 1 1
4 0.0 0 0.0 45 0.0 0 0 1 1
150 0.1 1 1.0 3 0.0 0 0 0 1
25 0.0 3 0.0 2 0.0 0 0 0 1
200 0.0 0 0.0 0 0.0 0 0 0 1
120 0.0 80 0.0 1 1.0 0 0 0 1
45 0.05 60 0.0 3 1.0 0 0 0 1
5 1.0 4 1.0 3 1.0 0 0 0 0
9 0.9 3 1.0 60 0.0 0 0 0 0
2 1.0 0 0.0 1 1.0 0 0 0 0
12 0.8 40 0.0 5 1.0 0 0 0 0
30 0.7 12 0.6 9 0.9 0 0 0 0
22 0.6 5 1.0 80 0.0 0 0 0 0
3 0.0 2 1.0 4 1.0 0 0 0 0
4 0.0 3 0.0 5 0.0 0 0 0 0
8 0.0 6 0.0 0 0.0 0 0 0 0
6 0.0 0 0.0 2 0.5 0 0 0 0
5 0.2 70 0.0 4 1.0 0 0 0 0
7 0.0 60 0.0 3 0.0 0 0 0 0
2 0.0 50 0.0 0 0.0 0 0 0 0
3 0.0 1 1.0 2 1.0 0 0 1 0
2 0.0 60 0.0 4 1.0 0 0 1 0
"""


@dataclass(frozen=True)
class Node:
    """feature and cut lead to the sides (at most the cut: left); a leaf has a label only."""

    label: int
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _impurity(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return len(y) * 2 * p * (1 - p)


def train(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Node:
    """A binary decision tree by Gini impurity; ties go to the earlier feature, then the smaller cut."""
    label = int(2 * y.sum() >= len(y))
    if depth == 0 or y.min() == y.max():
        return Node(label)
    best = (_impurity(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            best = min(best, (_impurity(y[low]) + _impurity(y[~low]), f, float(cut)), key=lambda b: b[0])
    if best[1] < 0:
        return Node(label)
    low = x[:, best[1]] <= best[2]
    return Node(label, best[1], best[2], train(x[low], y[low], depth - 1), train(x[~low], y[~low], depth - 1))


def labelled() -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().split("\n")])
    return rows[:, :-1], rows[:, -1].astype(int)


@lru_cache(maxsize=1)
def tree() -> Node:
    return train(*labelled())


def classify(node: Node, features: tuple) -> int:
    while node.left is not None:
        node = node.left if features[node.feature] <= node.cut else node.right
    return node.label


@dataclass
class Block:
    text: str
    words: int
    links: float
    chrome: bool
    content: bool
    heading: bool


def _marked(rest: str) -> bool:
    if "=" not in rest and "hidden" not in rest:
        return False
    if _HIDDEN.search(rest):
        return True
    return any(not CHROME_WORDS.isdisjoint(_PARTS.findall(_CAMEL.sub(" ", v).lower())) for v in _NAMED.findall(rest))


def _unseen_start(unseen: list[str], name: str) -> bool:
    """Enter a start tag into the open elements from the first unseen one on; False if it ends them all and is seen itself."""
    outer = next((k for k in range(len(unseen) - 1, -1, -1) if unseen[k] in ("svg", "math")), -1)
    inner = any(x in INTEGRATION for x in unseen[outer + 1 :])
    if name in CONTENT and not inner:
        unseen.clear()
    elif outer >= 0 and name in BREAKOUT and not inner:
        del unseen[outer:]
    elif name in ("button", "select") and name in unseen:
        del unseen[unseen.index(name) :]
    elif name in ("option", "optgroup"):
        while unseen and unseen[-1] in ("option", name):
            unseen.pop()
    if not unseen and name not in UNSEEN:
        return False
    if name not in VOID:
        unseen.append(name)
    return True


def blocks(page: str) -> list[Block]:
    """The page's text blocks that aren't empty, in page order."""
    out: list[Block] = []
    # Name, inside chrome (2: by an element's name, 1: by a marking only), inside content. A wrapper's marking doesn't reach into an article.
    stack: list[tuple[str, int, bool]] = []
    marked: list[str] = []  # open block elements outside the stack that are marked as chrome themselves
    parts: list[tuple[str, bool]] = []
    unseen: list[str] = []  # open elements from the first unseen one on
    loose: Counter[str] = Counter()  # open block elements outside the stack
    in_link, heading, in_head, at = 0, False, False, 0

    def flush() -> None:
        if parts:
            words = " ".join(references.unescape("".join(t for t, _ in parts)).split())
            if words:
                n = words.count(" ") + 1
                linked = len(references.unescape(" ".join(t for t, link in parts if link)).split())
                _, chrome, content = stack[-1] if stack else ("", 0, False)
                out.append(Block(words, n, min(1.0, linked / n), chrome > 0 or bool(marked), content, heading))
            parts.clear()

    for m in _TAG.finditer(page):
        if in_head and not page[at : m.start()].isspace() and m.start() > at:
            in_head = False  # text can't stand in the head: the body has begun
        if m.start() > at and not in_head and not unseen:
            parts.append((page[at : m.start()], in_link > 0))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, closing = name.lower(), bool(m["close"])
        if name in RAW_NAMES:  # self-closed, or a stray end
            continue
        if in_head and not closing and name not in HEAD and name != "html":
            in_head = False
        if name in ("head", "body", "html"):
            unseen.clear()
        elif unseen and closing and name in unseen:
            while unseen.pop() != name:
                pass
            continue
        elif unseen and closing:
            in_link = 0 if name == "a" else in_link
            if not (any(x[0] == name for x in stack) or loose[name]) or name == "p":
                continue
            unseen.clear()  # the end of what they lie in ends them
        elif unseen or name in UNSEEN:
            if closing or _SELF_CLOSED.search(m["rest"]) or _unseen_start(unseen, name):
                continue
        if name in ("head", "body", "html"):
            flush()
            in_head = name == "head" and not closing
        elif name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append((" ", False))
        elif name not in INLINE:
            flush()
            in_link = 0
            heading = not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()
            if name in TRACKED:
                marked.clear()
                if closing:
                    if any(x[0] == name for x in stack):
                        while stack.pop()[0] != name:
                            pass
                else:
                    _, chrome, content = stack[-1] if stack else ("", 0, False)
                    if name in CONTENT:
                        chrome = 2 if chrome == 2 else 0
                    elif name in CHROME or (name == "header" and not content):
                        chrome = 2
                    elif _marked(m["rest"]):
                        chrome = max(chrome, 1)
                    stack.append((name, chrome, content or name in CONTENT))
            elif closing:
                loose[name] -= loose[name] > 0
                marked = [x for x in marked if x != name]
            else:
                loose[name] += name not in VOID
                marked = [x for x in marked if x != name] + [name] * _marked(m["rest"])
    if at < len(page) and not (in_head and page[at:].isspace()) and not unseen:
        parts.append((page[at:], in_link > 0))
    flush()
    return out


def main_text(page: str) -> str:
    found, node = blocks(page), tree()
    kept = []
    for i, b in enumerate(found):
        before = found[i - 1] if i else None
        after = found[i + 1] if i + 1 < len(found) else None
        features = (b.words, b.links, before.words if before else 0, before.links if before else 0.0, after.words if after else 0, after.links if after else 0.0, b.chrome, b.content, b.heading)
        if classify(node, features):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars for each row."""

    def kernel(batch):
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield {id_col: batch.column(0), url_col: batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars bigint"
    return map_batches(pages.select(id_col, url_col, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html")), kernel, schema)
