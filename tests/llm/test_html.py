import random

import numpy as np
import pytest

from sparkweave.llm import html_extract as x
from sparkweave.llm.html_tree import node_features, parse


def text(page):
    return x.main_texts([page], x.page_forest())[0]


def page(inside, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>{before}<article>{inside}</article>{after}<footer>&copy; Site</footer></body></html>"


def test_article_without_the_rest():
    got = text(page("<h1>A  title\nhere</h1><p>First &amp; second.</p><p><b>Third line<br><p>Fourth", '<div class="ad">Buy now, it is cheap.</div>', '<section id="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this at all.</p></div></section>'))
    assert got == "A title here\nFirst & second.\nThird line\nFourth"


def test_other_layouts():
    body = "".join(f"<p>{'some words of the text ' * 8}</p>" for _ in range(4))
    got = text(f"<html><body><div class='header'>Site</div><div class='menu'><a href=x>one</a><a href=y>two</a></div><div class='post-content'>{body}</div><div class='sidebar'><h3>Related</h3><ul><li><a href=z>more</a></li></ul></div><form><label>Search</label><input></form></body></html>")
    assert got.split("\n") == [("some words of the text " * 8).strip()] * 4


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "no markup"), (4, "u", "<" * 20000), (5, "u", deep), (6, None, page("<p>x</p>")), (6, None, page("<p>x</p>")), (7, "u", "<!-- never closed"), (8, "u", "<p class='a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text", "1 AS n_chars")
    got = x.extract_main_text(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] == 6} == {"x"} and all(r["text"] == "" for r in got if r["page_id"] in (1, 2))
    assert x.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("sectioned", [False, True])
def test_held_out_generated_pages(sectioned):
    rng, forest = random.Random(77), x.page_forest()
    made = [x.training_labels(x.training_page(rng, sectioned)) for _ in range(120)]
    right = 0
    for tree, label in made:
        got = x.page_text(tree, x.decode(tree, forest.chance(node_features([tree]))))
        right += got == x.page_text(tree, label.tolist())
    assert right >= 0.85 * len(made)


def test_decoding_has_no_contradictions():
    rng = np.random.default_rng(3)
    tree = parse(page("<div><p>a</p><div><p>b</p></div></div>"))
    for _ in range(50):
        main = x.decode(tree, rng.random(len(tree.parent)))
        state = {v: main[v] for v in range(len(main))}
        for v in range(1, len(main)):  # below an out node that ends a content part nothing is content
            u = tree.parent[v]
            above = [state[u]]
            while u > 0:
                u = tree.parent[u]
                above.append(state[u])
            if state[v] and not above[0] and any(above):
                pytest.fail("content below a node that was taken out of content")


def test_pages_of_the_test_tables():
    import html
    import re

    import duckdb

    rows = duckdb.execute("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    for (h,), got in zip(rows, x.main_texts([r[0] for r in rows], x.page_forest()), strict=True):
        inside = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)[^>]*>", "\n", re.search(r"<article>(.*)</article>", h, re.S)[1]))
        assert got == "\n".join(s for s in (" ".join(html.unescape(b).split()) for b in inside.split("\n")) if s)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n)).capitalize() + "."


@pytest.mark.parametrize("tag", ["section", "div", "div class=card", "article"])
def test_section_wise_layouts_lose_no_paragraph(tag):
    """Every paragraph in a section of its own, in one or several boxes, with and without a sidebar and a header."""
    nav, foot = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News item</a></li></ul></nav>", "<footer>Copyright this site</footer>"
    for wraps in (1, 3):
        for side in ("", "<aside><h3>Related</h3><ul><li><a href=z>more of it</a></li></ul></aside>"):
            for head in ("", "<header>My site</header>"):
                rng, lost, n = random.Random(5), 0, 0
                for _ in range(30):
                    ps = [prose(rng, rng.randint(3, 60)) for _ in range(rng.randint(2, 9))]
                    body = "".join(f"<{tag}><p>{p}</p></{tag.split()[0]}>" for p in ps)
                    for _ in range(wraps):
                        body = f"<div>{body}</div>"
                    got = text(f"<html><body>{head}{nav}{body}{side}{foot}</body></html>").split("\n")
                    assert set(got) <= {*ps, ""}
                    lost, n = lost + sum(p not in got for p in ps), n + len(ps)
                assert lost <= n / 100


@pytest.mark.parametrize("kind", ["body", "box", "table", "articles"])
def test_plain_layouts_lose_no_paragraph(kind):
    rng = random.Random(5)
    for _ in range(60):
        ps = [prose(rng, rng.randint(3, 60)) for _ in range(rng.randint(2, 9))]
        body, nav, foot = "".join(f"<p>{p}</p>" for p in ps), "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News item</a></li></ul></nav>", "<footer>Copyright this site</footer>"
        got = text({"body": f"<html><body>{nav}{body}{foot}</body></html>", "box": f"<html><body>{nav}<div class=a1>{body}</div>{foot}</body></html>",
                    "table": f"<html><body><table><tr><td>{nav}</td><td>{body}</td></tr></table>{foot}</body></html>", "articles": f"<html><body>{nav}<main><article>{body}</article><article>{body}</article></main>{foot}</body></html>"}[kind])
        assert got.split("\n") == ps * (2 if kind == "articles" else 1)


def test_decoding_is_the_cheapest_of_all_labellings():
    from itertools import product

    rng = np.random.default_rng(9)
    for page in ("<div><p>a</p><div><p>b</p></div></div>", "<p>a</p><ul><li>b</li><li>c</li></ul>", "<div><div><div>x</div></div></div><p>y</p>"):
        tree = parse(page)
        n = len(tree.parent)
        for _ in range(30):
            p = np.clip(rng.random(n), 1e-4, 1 - 1e-4)
            best, least = set(), 1e18
            for states in product((0, 1, 2), repeat=n - 1):  # on the way, content, out
                s = (0, *states)
                # The page is on the way; below out all is out, below content all is content or out.
                if all((above != 2 or s[v] == 2) and (above != 1 or s[v] != 0) for v in range(1, n) for above in [s[tree.parent[v]]]):
                    cost = sum(-np.log(p[v]) if s[v] == 1 else -np.log(1 - p[v]) for v in range(1, n)) + x.SWITCH * sum((s[v] == 1) != (s[tree.parent[v]] == 1) and s[v] != 0 and (s[v] == 1 or s[tree.parent[v]] == 1) for v in range(1, n))
                    if cost < least - 1e-9:
                        least, best = cost, set()
                    if cost < least + 1e-9:
                        best.add(tuple(y == 1 for y in s))
            assert tuple(x.decode(tree, p)) in best


def test_markup_is_read_in_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        parse("<div>" * n + "x" + "</div>" * n)
        return time.perf_counter() - began

    took(1000)
    assert min(took(80_000) for _ in range(3)) < 4 * min(took(40_000) for _ in range(3))
