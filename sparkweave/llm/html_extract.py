"""Main text of web pages by gradient-boosted trees over DOM nodes (operator 2).

Every element is a row of features: tag, attribute tokens of itself, of what stands above and below it,
subtree text and link density, depth, and sibling statistics. Boosted trees give the chance that it belongs
to the main text. Hierarchical decoding then labels a whole page at once: a node is out (and all below it),
content (what lies below is content, or out), or on the way to content (itself out); the cheapest labelling
under these rules is taken, so an ancestor and a descendant never contradict each other.

The trees are fitted on generated pages of many layouts whose right labels are known by construction; the
number of pages is a parameter, so the fit does not depend on the table.

Cases: a null or empty page gives an empty text; broken markup is closed as browsers do; very long pages are
read whole, in linear time; repeated rows repeat their result; an empty table gives no rows; columns beside
page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import random
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm.common import rows_in_arrow, texts
from sparkweave.llm.html_tree import Tree, node_features, parse

TRAIN_PAGES, TREES, DEPTH, BINS = 900, 60, 4, 24
#: Pages beside these whose text stands in sections.
SECTIONED = 500
SWITCH = 1.0
#: Nodes that are scored at once.
MOST_NODES = 100_000


# ---- generated pages

def training_page(rng: random.Random, sectioned: bool = False) -> str:
    """A page of a random layout, or of one whose text stands in several sections or cards; what is main text stands in elements with the attribute data-main, what is not, but stands inside, has data-out."""

    def words(least: int, most: int) -> str:
        n = rng.randint(least, most)
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n)).capitalize() + rng.choice([".", ".", "!", ""])

    def links(n: int, wrap: str = "li") -> str:
        return "".join(f"<{wrap}><a href='/x'>{words(1, 4)}</a></{wrap}>" for _ in range(n))

    def named(tag: str, options: str, inside: str, extra: str = "") -> str:
        name = rng.choice(options.split())
        attr = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{rng.choice(["box", "wrap", "c1", "row"])} {name}"', f' class="{name}-{rng.choice(["inner", "block", "area", "1"])}"'])
        return f"<{tag}{attr}{extra}>{inside}</{tag}>"

    def some(p: float, make) -> str:
        return make() if rng.random() < p else ""

    def ad(extra: str = "") -> str:
        return named(rng.choice(["div", "div", "aside", "section"]), "ad ads advert advertisement sponsored promo ad-slot", rng.choice([words(2, 25), f"<p>{words(3, 25)}</p>", f"<a href='x'>{words(2, 8)}</a>"]), extra)

    def comments(extra: str = "") -> str:
        each = "".join(f"<{k} class='comment'><p>{words(2, 50)}</p></{k}>" for k in [rng.choice(["li", "div"])] for _ in range(rng.randint(1, 6)))
        return named(rng.choice(["section", "div", "ol", "ul"]), "comments comment-list discussion replies responses comments", some(0.6, lambda: f"<h3>{words(1, 3)}</h3>") + each, extra)

    def sidebar(extra: str = "") -> str:
        inside = rng.choice([f"<h3>{words(1, 3)}</h3><ul>{links(rng.randint(2, 8))}</ul>", f"<p>{words(5, 40)}</p>", f"<h4>{words(1, 3)}</h4><p>{words(5, 30)}</p>"])
        return rng.choice([f"<aside{extra}>{inside}</aside>", named("div", "sidebar side widget related recommended", inside, extra)])

    def form(extra: str = "") -> str:
        inside = f"<label>{words(1, 4)}</label><input name=q><button>{words(1, 2)}</button>"
        return rng.choice([f"<form{extra}>{inside}</form>", named("div", "newsletter subscribe search share social", rng.choice([f"<p>{words(3, 15)}</p><form>{inside}</form>", f"<ul>{links(3)}</ul>"]), extra)])

    def notice(extra: str = "") -> str:
        return named(rng.choice(["div", "section"]), "cookie-notice notice alert warning consent-popup announcement", f"<p>{words(4, 30)}</p>" + some(0.4, lambda: f"<button>{words(1, 2)}</button>"), extra)

    def menu(extra: str = "") -> str:
        inside = f"<ul>{links(rng.randint(2, 9))}</ul>" if rng.random() < 0.8 else links(rng.randint(2, 7), "span")
        return rng.choice([f"<nav{extra}>{inside}</nav>", named("div", "nav menu navbar breadcrumb", inside, extra), named("ul", "menu nav", links(5), extra)])

    def paragraph() -> str:
        inside = words(*rng.choice([(1, 2), (2, 12), (5, 60), (20, 120)]))
        kind = rng.random()
        if kind < 0.15:
            return f"<p><b>{inside}<br>"
        if kind < 0.25:
            return f"<p>{inside} <a href='/y'>{words(1, 4)}</a> <em>{words(1, 3)}</em> {words(1, 9)}</p>"
        if kind < 0.3:
            return f"<p>{inside}"
        if kind < 0.34:
            return f"<ul>{''.join(f'<li>{words(1, 15)}</li>' for _ in range(rng.randint(1, 5)))}</ul>"
        if kind < 0.37:
            return f"<blockquote><p>{inside}</p></blockquote>"
        if kind < 0.4:
            return f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"
        if kind < 0.43:
            return f"<pre>{inside}</pre>"
        if kind < 0.5:
            return f"<h{rng.randint(2, 4)}>{words(1, 8)}</h{rng.randint(2, 4)}>"
        if kind < 0.55:
            return f"<div>{inside}</div>"
        if kind < 0.58:
            return f"<figure><img src=x><figcaption>{words(2, 20)}</figcaption></figure>"
        return f"<p>{inside}</p>"

    out = " data-out"
    if sectioned:
        tag, title = rng.choice(["section", "section", "div", "div", "article"]), lambda: f"<h{rng.randint(2, 3)}>{words(1, 8)}</h{rng.randint(2, 3)}>"
        box = rng.choice(["", "", "", " class=card", " class=block", " class=item", f" class={rng.choice('abcxyz')}{rng.randint(1, 99)}"])
        most, titled, body = rng.choice([1, 1, 2, 4]), rng.choice([0, 0, 0.5, 1]), some(0.4, lambda: f"<h1>{words(1, 12)}</h1>")
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
            plain_ones = "".join(f"<p>{words(3, 60)}</p>" if rng.random() < 0.7 else paragraph() for _ in range(rng.randint(1, most)))
            body += f"<{tag}{box}>{some(titled, title)}{plain_ones}</{tag}>" + some(0.05, lambda: ad(out))
        name = lambda: rng.choice(["", "", f" class={rng.choice('abcxyz')}{rng.randint(1, 99)}", " class=row", " class=grid", " class=container", " id=root", " id=app", " class=layout", " class=wrap"])
        holder = rng.choice(["div", "div", "div", "main"])
        body = f"<{holder}{name()} data-main>{body}</{holder}>"
        sides = lambda: some(0.35, sidebar), lambda: some(0.2, ad), lambda: some(0.3, comments), lambda: some(0.15, form)
        body = some(0.3, menu) + some(0.15, notice) + body + "".join(make() for make in sides)
        top = some(0.45, lambda: rng.choice([f"<header>{words(1, 5)}</header>", f"<header>{words(1, 5)}{menu()}</header>", f"<header><h1>{words(1, 4)}</h1></header>"])) + some(0.6, menu)
        foot = some(0.8, lambda: rng.choice([f"<footer>{words(2, 20)}</footer>", f"<footer><p>{words(2, 20)}</p></footer>"]))
        within = rng.random() < 0.5  # the rest stands inside the boxes, or around them
        body = top + body + foot if within else body
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            body = f"<div{name()}>{body}</div>"
        return f"<html><head><title>{words(1, 8)}</title></head><body>{body if within else top + body + foot}</body></html>"
    inside = some(0.65, lambda: rng.choice([f"<h1>{words(1, 12)}</h1>", f"<h1>{words(1, 12)}</h1>", f"<header><h1>{words(1, 12)}</h1></header>"]))
    for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 15])):
        inside += paragraph() + some(0.06, lambda: rng.choice([ad, form, sidebar, notice])(out))
    inside += some(0.12, lambda: comments(out)) + some(0.08, lambda: f"<footer{out}>{words(2, 15)}</footer>") + some(0.08, lambda: form(out)) + some(0.05, lambda: menu(out))
    start, plain = rng.random(), f"{rng.choice('abcxyz')}{rng.randint(1, 99)}"
    if start < 0.22:  # straight in the body, or in a box without a telling name, with the rest around it
        rest = lambda extra: some(0.7, lambda: menu(extra)) + some(0.3, lambda: ad(extra)) + some(0.2, lambda: notice(extra))
        foot = lambda extra: some(0.8, lambda: f"<footer{extra}>{rng.choice([words(2, 20), f'<p>{words(2, 20)}</p>'])}</footer>")
        top = lambda extra: some(0.4, lambda: f"<header{extra}>{words(1, 5)}</header>")
        if start < 0.08:
            return f"<html><head><title>{words(1, 8)}</title></head><body data-main>{top(out)}{rest(out)}{inside}{some(0.3, lambda: comments(out))}{foot(out)}</body></html>"
        return f"<html><head><title>{words(1, 8)}</title></head><body>{top('')}{rest('')}<div class={plain} data-main>{inside}</div>{some(0.3, comments)}{some(0.3, sidebar)}{foot('')}</body></html>"
    if start < 0.28:  # a table of layout
        cells = [f"<td valign=top>{rng.choice([menu, sidebar])()}</td>", f"<td data-main>{inside}</td>"]
        rng.shuffle(cells)
        return f"<html><head><title>{words(1, 8)}</title></head><body>{some(0.5, menu)}<table width='100%'><tr>{''.join(cells)}</tr></table>{some(0.6, lambda: f'<footer>{words(2, 20)}</footer>')}</body></html>"
    if start < 0.33:  # several articles
        inside = "</article><article data-main>".join([inside, *(f"<h2>{words(1, 8)}</h2>" + "".join(paragraph() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))])
        return f"<html><head><title>{words(1, 8)}</title></head><body>{some(0.6, menu)}<main><article data-main>{inside}</article></main>{some(0.4, sidebar)}{some(0.7, lambda: f'<footer>{words(2, 20)}</footer>')}</body></html>"
    main = rng.choice([
        lambda: f"<article data-main>{inside}</article>", lambda: f"<article data-main>{inside}</article>", lambda: f"<article data-main>{inside}</article>",
        lambda: f"<main><article data-main>{inside}</article></main>", lambda: f"<main data-main>{inside}</main>",
        lambda: named("div", "content post entry-content article-body post-content story main", inside, " data-main"),
        lambda: named("section", "content article story entry", inside, " data-main"),
        lambda: f"<div class='{rng.choice(['c1', 'box', 'col'])}' data-main>{inside}</div>",
    ])()
    before = some(0.5, lambda: rng.choice([f"<header>{words(1, 5)}{some(0.5, menu)}</header>", named("div", "header masthead topbar banner", f"<p>{words(1, 6)}</p>")])) + some(0.7, menu)
    between = [some(0.35, ad), some(0.2, notice), some(0.2, form)]
    after = [some(0.3, comments), some(0.35, sidebar), some(0.15, ad), some(0.1, form)]
    rng.shuffle(between)
    rng.shuffle(after)
    foot = some(0.8, lambda: rng.choice([f"<footer>{words(2, 20)}</footer>", f"<footer><p>{words(2, 20)}</p>{some(0.4, menu)}</footer>", named("div", "footer copyright bottom", f"<p>{words(2, 15)}</p>")]))
    body = before + "".join(between) + main + "".join(after)
    if rng.random() < 0.3:
        body = f"<div class='{rng.choice(['wrapper', 'container', 'page', 'row'])}'>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{}}</style></head><body>{body}{foot}" + some(0.85, lambda: "</body></html>")


def training_labels(page: str) -> tuple[Tree, np.ndarray]:
    """The page's nodes and which of them are main text; the marks don't stay in the tree."""
    marks: list[int] = []
    t = parse(page, lambda name, attrs: marks.append(1 if "data-main" in attrs else -1 if "data-out" in attrs else 0))
    label = np.zeros(len(t.parent), bool)
    for v in range(1, len(label)):
        label[v] = marks[v - 1] > 0 or marks[v - 1] == 0 and label[t.parent[v]]
    return t, label


# ---- boosted trees

@dataclass
class Forest:
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def chance(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            score += leaf[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, rate: float = 0.3, ridge: float = 1.0) -> Forest:
    """Second-order boosting of full trees with histograms over quantile bins."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(d) * BINS
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features, values, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    score = np.zeros(n)
    for k in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            where = ((at - first)[:, None] * (d * BINS) + flat).ravel()
            gs = np.bincount(where, np.repeat(g, d), wide * d * BINS).reshape(wide, d, BINS).cumsum(2)
            hs = np.bincount(where, np.repeat(h, d), wide * d * BINS).reshape(wide, d, BINS).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            for v in range(wide):
                j, b = divmod(int(gain[v].argmax()), BINS)
                features[k, first + v] = j
                if gain[v, j, b] > 1e-6 and b < len(cuts[j]):
                    values[k, first + v] = cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), features[k, at]] > values[k, at])
        own = at - inner
        leaf[k] = -rate * np.bincount(own, g, leaves) / (np.bincount(own, h, leaves) + ridge)
        score += leaf[k][own]
    return Forest(features, values, leaf)


@cache
def page_forest(pages: int = TRAIN_PAGES, seed: int = 11) -> Forest:
    rng = random.Random(seed)
    made = [training_labels(training_page(rng)) for _ in range(pages)] + [training_labels(training_page(rng, True)) for _ in range(SECTIONED)]
    return fit_forest(node_features([t for t, _ in made]), np.concatenate([y for _, y in made]).astype(float))


# ---- decoding and text

def decode(tree: Tree, chance: np.ndarray) -> list[bool]:
    """Which nodes are main text, by the cheapest labelling without contradictions."""
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    yes, no = (-np.log(p)).tolist(), (-np.log(1 - p)).tolist()
    n = len(yes)
    yes[0] = 1e9  # the page itself
    out, content, way = no[:], yes[:], no[:]
    for v in range(n - 1, 0, -1):
        u = tree.parent[v]
        out[u] += out[v]
        content[u] += min(content[v], out[v] + SWITCH)
        way[u] += min(out[v], way[v], content[v] + SWITCH)
    state = [0] * n  # 0 on the way, 1 content, 2 out
    for v in range(1, n):
        above = state[tree.parent[v]]
        if above == 2:
            state[v] = 2
        elif above == 1:
            state[v] = 1 if content[v] <= out[v] + SWITCH else 2
        else:
            least = min(out[v], way[v], content[v] + SWITCH)
            state[v] = 2 if out[v] == least else 1 if content[v] + SWITCH == least else 0
    return [s == 1 for s in state]


def page_text(tree: Tree, main: list[bool]) -> str:
    blocks: list[str] = []
    parts: list[str] = []

    def end() -> None:
        if parts:
            s = "".join(parts)
            s = " ".join((entities.unescape(s) if "&" in s else s).split())
            if s:
                blocks.append(s)
            parts.clear()

    for v, s in tree.flow:
        if v < 0:
            end()
        elif main[v]:
            parts.append(s)
    end()
    return "\n".join(blocks)


def main_texts(pages: list[str], forest: Forest) -> list[str]:
    found: list[str] = []
    at = 0
    while at < len(pages):
        trees, nodes = [], 0
        while at < len(pages) and nodes < MOST_NODES:
            trees.append(parse(pages[at]))
            nodes += len(trees[-1].parent)
            at += 1
        chance, start = forest.chance(node_features(trees)), 0
        for t in trees:
            end = start + len(t.parent)
            found.append(page_text(t, decode(t, chance[start:end])))
            start = end
    return found


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    forest = page_forest()

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            found = main_texts(texts(batch, "html"), forest)
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": [len(x) for x in found]}

        return run

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows_in_arrow(pages.select("page_id", "url", "html"), make, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
