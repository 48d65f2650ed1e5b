"""HTML into nodes, node features and a flow of text pieces, in one pass over the markup."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[A-Za-z][^>]*(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are no markup, or are never shown as text of the page.
RAW = {x: re.compile(f"</{x}(?=[\\s/>])[^>]*>?", re.I) for x in "script style title textarea iframe noembed noframes template noscript".split()}
HIDDEN = frozenset(["head", *RAW])
BLOCK = frozenset(
    "address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot"
    " th thead title tr ul video audio".split()
)
CLOSES_P = BLOCK - frozenset("br button option select td th tr tbody thead tfoot li dd dt body html title video audio legend".split())
#: A start tag ends an open element of its own group that lies above the group's container.
GROUPS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

TAG_GROUPS = (
    "article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "nav menu", "header", "footer", "aside",
    "form button input select label fieldset option", "ul ol dl", "li dt dd", "a", "b i em strong span u small code mark sub sup",
    "table tbody thead tr td th", "blockquote pre figure figcaption", "body html",
)
GROUP_OF = {t: k for k, g in enumerate(TAG_GROUPS) for t in g.split()}
N_GROUPS = len(TAG_GROUPS) + 1
#: What words in class, id, role and aria-label hint at.
HINTS = (
    "article content main post entry story text prose body markdown document",
    "nav navigation menu navbar breadcrumb breadcrumbs pager pagination tabs toc",
    "header masthead topbar banner branding logo",
    "footer copyright colophon bottom contentinfo",
    "sidebar aside side rail widget widgets related recommended complementary more trending",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion commercial",
    "comment comments commentlist discussion reply replies disqus respond responses reader",
    "notice cookie cookies consent alert warning gdpr popup modal overlay message toast announcement",
    "form search login signup subscribe newsletter share sharing social follow rating button toolbar",
)
HINT_OF = {w: k for k, g in enumerate(HINTS) for w in g.split()}
N_HINTS = len(HINTS)
#: Bits of a node: its hints, then what its tag itself says.
TAG_BIT = {t: 1 << (N_HINTS + k) for k, g in enumerate(("article main", "nav menu", "header", "footer", "aside", "form button select")) for t in g.split()}
N_BITS = N_HINTS + 6


@dataclass
class Tree:
    group: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    text: list[int] = field(default_factory=list)  # characters of its own
    links: list[int] = field(default_factory=list)  # of these, in links
    paras: list[int] = field(default_factory=list)
    #: (node, text) in page order; node -1 ends a block.
    flow: list[tuple[int, str]] = field(default_factory=list)


def _bits(name: str, attrs: str) -> int:
    bits = TAG_BIT.get(name, 0)
    if "=" in attrs:
        for key, a, b, c in ATTR.findall(attrs):
            if key.lower() in ("class", "id", "role", "aria-label", "itemprop"):
                for w in WORD.findall(a or b or c):
                    if (k := HINT_OF.get(w.lower())) is not None:
                        bits |= 1 << k
    return bits


def parse(html: str, seen: Callable[[str, str], object] | None = None) -> Tree:
    """The page's elements in page order; node 0 is the page itself. seen gets the name and attributes of each."""
    t = Tree([N_GROUPS - 1], [-1], [0], [0], [0], [0], [0], [0])
    stack, names = [0], [""]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of a name stand
    at, inside_link, hidden = 0, 0, 0

    def close(upto: int) -> None:
        nonlocal inside_link, hidden
        while len(stack) > upto:
            stack.pop()
            gone = names.pop()
            places[gone].pop()
            inside_link -= gone == "a"
            hidden -= gone in HIDDEN
            if gone in BLOCK:
                t.flow.append((-1, ""))

    def put(s: str) -> None:
        if s and not hidden:
            v = stack[-1]
            t.flow.append((v, s))
            n = len(s.strip())
            t.text[v] += n
            if inside_link:
                t.links[v] += n

    for m in iter(lambda: TOKEN.search(html, at), None):
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if places.get(name):
                close(places[name][-1])
            continue
        if name in CLOSES_P and places.get("p"):
            close(places["p"][-1])
        elif name in GROUPS:
            last, walls = (max((places[x][-1] for x in some if places.get(x)), default=0) for some in GROUPS[name])
            if last > walls:
                close(last)
        elif name == "body" and places.get("head"):
            close(places["head"][0])
        if name in BLOCK:
            t.flow.append((-1, ""))
        if name in VOID:
            continue
        if name in RAW:
            over = RAW[name].search(html, at)
            at = over.end() if over else len(html)
            continue
        if seen:
            seen(name, m["attrs"])
        v, up = len(t.parent), stack[-1]
        t.group.append(GROUP_OF.get(name, N_GROUPS - 1))
        t.parent.append(up)
        t.depth.append(t.depth[up] + 1)
        t.above.append(t.above[up] | t.own[up])
        t.own.append(_bits(name, m["attrs"]))
        t.text.append(0)
        t.links.append(0)
        t.paras.append(int(name == "p"))
        if not m["attrs"].endswith("/"):
            stack.append(v)
            places[name].append(len(names))
            names.append(name)
            inside_link += name == "a"
            hidden += name in HIDDEN
    put(html[at:])
    return t


def node_features(trees: list[Tree]) -> np.ndarray:
    """A row for every node of all trees."""
    blocks = []
    for t in trees:
        n = len(t.parent)
        text, links, paras, below, kids, size = t.text[:], t.links[:], t.paras[:], [0] * n, [0] * n, [1] * n
        rank, same = [0] * n, {}
        for v in range(1, n):
            p = t.parent[v]
            rank[v] = kids[p]
            kids[p] += 1
            same[p, t.group[v]] = same.get((p, t.group[v]), 0) + 1
        for v in range(n - 1, 0, -1):
            p = t.parent[v]
            text[p] += text[v]
            links[p] += links[v]
            paras[p] += paras[v]
            size[p] += size[v]
            below[p] |= below[v] | t.own[v]
        parent = np.array(t.parent)
        parent[0] = 0
        sub, own, link = np.array(text, float), np.array(t.text, float), np.array(links, float)
        siblings = np.array(kids)[parent]
        cols = [
            np.array(t.depth), np.log1p(own), np.log1p(sub), link / np.maximum(sub, 1), sub / np.maximum(np.array(size), 1), np.array(kids), siblings,
            np.array(rank) / np.maximum(siblings, 1), np.array([same.get((t.parent[v], t.group[v]), 0) for v in range(n)]), np.array(paras),
            sub / max(sub[0], 1), sub / np.maximum(sub[parent], 1), np.log1p(sub[parent] / np.maximum(siblings, 1)), np.log1p(np.array(size)),
        ]
        shift = np.arange(N_BITS)
        bits = [(np.array(x)[:, None] >> shift) & 1 for x in (t.own, t.above, below)]
        blocks.append(np.hstack([np.array(cols).T, np.eye(N_GROUPS)[t.group], np.eye(N_GROUPS)[np.array(t.group)[parent]], *bits]))
    return np.vstack(blocks).astype(np.float32)
