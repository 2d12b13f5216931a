import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from textquarry.llm import embedding, html_wrappers
from textquarry.llm.graph import components


def brute(rows):
    fine = {i: np.array(v, float) for i, (label, v) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: set() for i in range(len(rows))}
    for a, x in fine.items():
        for b, y in fine.items():
            if a < b and rows[a][0] == rows[b][0] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for i in range(len(rows)):
        if i not in comp:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in comp:
                    comp[j] = i
                    todo += links[j]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in range(len(rows))}


def vectors(n, dim=24, groups=12):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(groups, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(groups)] + rng.normal(size=dim) * rng.choice([0.05, 0.1, 0.14]) if rng.random() < 0.7 else rng.normal(size=dim)
        rows.append((int(rng.integers(2)), [float(np.float32(x)) for x in v]))
    rows += [rows[3], rows[3], (None, rows[3][1]), (1, None), (1, []), (1, [0.0] * dim), (1, [float("nan")] * dim), (1, [None, *rows[3][1][1:]]), (0, [1.0, 0.0]), (0, [2.0, 0.0]), (0, [float("inf"), 1.0])]
    return rows


@pytest.mark.parametrize("cap", [2048, 64])
def test_links_by_brute_force(spark, cap):
    rows = vectors(500)
    df = spark.createDataFrame([(i, v, label, "x") for i, (label, v) in enumerate(rows)], "vec_id long, embedding array<float>, label int, kept string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding.near_duplicates(df, cap).collect()}
    expected = brute(rows)
    n = sum(e[0] for e in expected.values())
    assert n > 500
    found = sum(min(got[i][0], expected[i][0]) for i in got)
    assert all(got[i][0] <= expected[i][0] for i in got)
    assert found >= 0.99 * n
    if cap > 500:
        assert got == expected
    assert embedding.near_duplicates(df.limit(0)).collect() == []


def test_search_recall_of_queries_against_all():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    x = np.repeat(centres, 30, axis=0) + 0.08 * rng.normal(size=(1800, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    adj, medoids = embedding.flat_graph(x, embedding.DEGREE, embedding.POOL)
    asked = np.arange(0, 1800, 50)
    found = embedding.range_search(x, adj, medoids, x[asked], np.full(len(asked), -1), 0.98, embedding.BEAM)
    truth = x[asked] @ x.T >= 0.98
    assert (found & truth).sum() >= 0.9 * truth.sum()
    assert not (found & ~(x[asked] @ x.T >= 0.98 - 1e-5)).any()


def test_a_cell_counts_weights():
    v = np.array([1.0, 0.0])
    t = pd.DataFrame({"node": [1, 2], "weight": [3, 1], "vector": [v, v * 2 + [0, 0.01]], "asks": False, "label": 1, "dim": 2})
    out = embedding.cell(pd.concat([t, t.assign(asks=True)]))
    linked = out[out.linked > 0].set_index("node")["linked"].to_dict()
    assert linked == {1: 1, 2: 3}


def test_no_link_of_low_rank_vectors_is_lost(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(1500, 4))
    rank = np.concatenate([base, base + 0.17 * rng.normal(size=base.shape)]) @ np.linalg.qr(rng.normal(size=(384, 4)))[0].T
    x = rank / np.linalg.norm(rank, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding.near_duplicates(df, 256).collect()}
    assert sum(got[i] for i in got) >= 0.9999 * links.sum()


@pytest.mark.parametrize("numbers", [embedding.PIVOT_NUMBERS, 0])
def test_partitions_lose_no_link(spark, numbers, monkeypatch):
    """Pivots with the tasks or joined to groups; cuts of cuts; every pair in range meets in the partition that either is at home in."""
    monkeypatch.setattr(embedding, "PIVOT_NUMBERS", numbers)
    monkeypatch.setattr(embedding, "FANOUT", 4)
    rng = np.random.default_rng(5)
    centres = 3 * rng.normal(size=(40, 16))
    x = centres[rng.integers(40, size=1200)] + 0.08 * rng.normal(size=(1200, 16))
    rows = [(i, v.tolist(), i % 2, 1, 16) for i, v in enumerate(x)]
    nodes = spark.createDataFrame(rows, "node long, vector array<double>, label int, weight long, dim int")
    parts = embedding._parted(nodes, 64).collect()
    home, where = {}, {}
    for r in parts:
        where.setdefault(r["node"], set()).add(r["part"])
        if r["home"]:
            assert r["node"] not in home
            home[r["node"]] = r["part"]
    assert len(home) == 1200 and len(set(home.values())) > 8
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for a, b in np.argwhere(unit @ unit.T >= 0.98):
        if a % 2 == b % 2:
            assert home[int(a)] in where[int(b)]


def test_recall_is_returned(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(100, 8)), 3, axis=0) + 0.02 * rng.normal(size=(300, 8))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(300, None, 1)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(embedding.RECALL <= r["recall"] <= 1 if r["vec_id"] < 300 else r["recall"] is None for r in got)


def test_a_cell_that_stays_below_recall_is_compared_whole(monkeypatch):
    rng = np.random.default_rng(12)
    v = list(rng.normal(size=(300, 3)))
    t = pd.DataFrame({"node": range(300), "weight": 1, "vector": v, "asks": False, "label": "a", "dim": 3})
    monkeypatch.setattr(embedding, "range_search", lambda x, adj, starts, q, own, limit, beam: np.zeros((len(q), len(x)), bool))
    out = embedding.cell(pd.concat([t, t.assign(asks=True)]))
    x = np.stack(v) / np.linalg.norm(v, axis=1, keepdims=True)
    assert out["linked"].sum() == (x @ x.T >= 0.98).sum() - 300


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 580)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = {}
    for i in sorted(near):
        todo = [i] if i not in expected else []
        while todo:
            j = todo.pop()
            if j not in expected:
                expected[j] = i
                todo += near[j]
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><script>var t="</p>";</script></head><body class="home has-sidebar">
<header><h1>Site</h1></header><nav><ul>{nav}</ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<div class="layout"><main><article id="post-{i}"><h1>Head {i}</h1>{body}<p class="x">Follow us</p></article>
<section class="comments"><h2>Comments</h2><article><p>First!</p></article></section></main>
<aside><p>Aside {i}</p></aside></div><div class="ad">Buy {i}</div><form><label>Mail</label><input></form><footer>&copy; Site {i}</footer></body></html>"""


def pages(n):
    out = []
    for i in range(n):
        body = "".join(f"<p>Para {i} {k}\n  &amp; <b>bold</b>er &lt;tag&gt;</p>" + ("<ul><li>one</li><li>two</li></ul>" if (i + k) % 3 == 0 else "") for k in range(1 + i % 4))
        nav = "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(3 + i % 3))
        out.append((i, f"http://h.example/{i}", PAGE.replace("{nav}", nav).replace("{body}", body).replace("{i}", str(i))))
    return out


def expected(i):
    return " ".join([f"Head {i}"] + [f"Para {i} {k} & bolder <tag>" + (" one two" if (i + k) % 3 == 0 else "") for k in range(1 + i % 4)])


def test_articles_of_known_text(spark):
    rows = pages(40) + [(40, None, None), (41, "", ""), (42, "http://o.example/x?y", "<p>Only <i>text</i>"), (43, "http://o.example/", "<a <b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_wrappers.extract(df).collect()}
    assert len(got) == len(rows)
    for i in range(40):
        assert got[i]["text"] == expected(i)
        assert got[i]["n_chars"] == len(expected(i))
    assert got[40]["text"] == got[41]["text"] == got[43]["text"] == ""
    assert got[42]["text"] == "Only text"
    assert html_wrappers.extract(df.limit(0)).collect() == []


def test_wrappers_are_union_free():
    w = None
    for _, _, page in pages(12):
        own = html_wrappers.pattern(html_wrappers.parse(page))
        w = own if w is None else html_wrappers.aligned(w, own)
    text = html_wrappers.expression(w)
    assert "(<li><a>#</a></li>)+" in text and "|" not in text
    again = html_wrappers.aligned(w, html_wrappers.pattern(html_wrappers.parse(pages(12)[5][2])))
    assert html_wrappers.expression(again) == text


def test_parser_takes_anything():
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<div", "<", ">", "<!--", "-->", "<script>", "</script>", "text", "&am", "&amp;", '"', "'", "<a href='x", "<li>", "<table><tr><td>", "</", "\x00", "<b/>"]
    for _ in range(300):
        html_wrappers.parse("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
    deep = html_wrappers.parse("<div>" * 5000 + "end")
    assert html_wrappers.Extractor(html_wrappers.pattern(deep), 1).text(deep) == "end"
    html_wrappers.parse("<a " * 20_000)


def texts_of(pages):
    """The pages' texts by the wrapper of all of them."""
    trees = [html_wrappers.parse(page) for page in pages]
    w = html_wrappers.pattern(trees[0])
    for tree in trees[1:]:
        w = html_wrappers.aligned(w, html_wrappers.pattern(tree))
    return [html_wrappers.Extractor(w, len(pages)).text(tree) for tree in trees]


@pytest.mark.parametrize("n", [2, 4, 5, 9])
def test_text_that_one_page_has_is_kept(n):
    page = lambda i, more="": f"<article><h1>Head {i}</h1><p>Para {i}</p><h2>Summary</h2><p>Same words</p><h3>Sub {i}</h3>{more}<div class='x'>Follow us</div></article>"
    more = "<blockquote class='q'>Lone quote</blockquote><h2>Surplus</h2><div class='y'><p>Short</p><div class='z'>Lone box</div></div>"
    got = texts_of([page(i, more if i == 0 else "") for i in range(n)])
    same = lambda i: f"Head {i} Para {i} Summary Same words Sub {i}"
    assert got == [same(0) + " Lone quote Surplus Short Lone box"] + [same(i) for i in range(1, n)]


def test_pages_that_mark_their_text_otherwise_are_not_empty():
    nav, foot = "<nav>Menu</nav>", "<footer>Foot</footer>"
    bodies = ["<article><p>By article</p></article>", "<main><p>By main</p></main>", "<div class='content'><p>By name</p></div><p>beside</p>", "<p>By nothing</p>", "<article><nav>Only menu</nav></article><main>Main</main>"]
    assert texts_of([nav + b + foot for b in bodies]) == ["By article", "By main", "By name", "By nothing", "Main"]


def test_parts_of_the_article_are_not_dropped_by_single_words():
    kept = "<h2 id='side-effects'>A</h2><section id='discussion'>B {i}</section><h2 id='related-work'>C</h2><p class='more'>D {i}</p><h3 id='search-results'>E</h3><section id='legal-analysis'>F {i}</section><ul><li><a>Source G</a></li></ul>"
    gone = "<div class='related-posts'>no</div><div id='comments'>no</div><section class='comments'>no</section><div role='navigation'>no</div><ul class='my-menu'><li><a>no</a></li></ul><aside>no</aside>"
    assert texts_of([f"<article><h1>Head {i}</h1>{kept}{gone}</article>".replace("{i}", str(i)) for i in range(3)]) == [f"Head {i} A B {i} C D {i} E F {i} Source G" for i in range(3)]


@pytest.mark.parametrize("n", [10, 140, 160, 400])
def test_end_tags_of_deep_elements_close_no_ancestor(n):
    page = f"<div class='layout'><article><p>First</p>{'<div>' * n}<ul><li><p>in<ul><li>a<li>b</ul></ul>{'</div>' * n}<p>Last</p></article></div><p>beside</p>"
    assert " ".join(texts_of([page])[0].split()) in ("First in a b Last", "First inab Last")


def test_elements_below_the_greatest_depth_are_no_text_if_they_are_no_article():
    page = "<article><p>First</p>" + "<div>" * 400 + "<nav>MENU <nav>inner</nav> more</nav><p>kept</p><div class='share'>SHARE<div>too</div></div><p>also</p>" + "</div>" * 400 + "<p>Last</p></article><p>beside</p>"
    assert texts_of([page]) == ["First kept also Last"]


def test_wrappers_find_articles_that_nothing_names():
    """Elements without telling names: what differs from page to page, and where, is all there is to go by. A page by itself doesn't tell."""
    rng = random.Random(13)
    words = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(n))
    terms, made = words(120), []
    for i in range(30):
        paras, items = [words(rng.randint(15, 60)) for _ in range(rng.randint(3, 6))], [words(4), words(3)] if i % 4 == 0 else []
        head, ad = words(5), f"<div class='c7'>{words(8)}</div>" if i % 3 else ""
        inner = f"<h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in paras) + ("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>" if items else "")
        page = (
            f"<body><div><ul><li><a href=/>{words(2)}</a><li><a href=/x>{words(2)}</a></ul></div><p>Welcome to our site, it is the best of all sites</p>{ad}"
            f"<div class='c1'><div class='c2'>{inner}</div></div><div class='c9'><p>{terms}</p></div><div>{words(6)}</div></body>"
        )
        made.append((page, " ".join([head, *paras, *items])))
    assert texts_of([page for page, _ in made]) == [t for _, t in made]
    assert sum(texts_of([page]) == [t] for page, t in made) < 0.7 * len(made)


def test_pages_without_telling_names_need_their_host():
    """The given pages with all names made dumb give the same texts by their hosts' wrappers, more than each by itself."""
    import pyarrow.parquet as pq

    def dumb(page):
        page = re.sub(r"((?:class|id|role)\s*=\s*)(\"[^\"]*\"|'[^']*')", lambda m: m[1] + f'"c{sum(map(ord, m[2])) % 997}"', page)
        return re.sub(r"(</?)(article|main|nav|aside|footer|header|section)\b", r"\1div", page)

    by_host = {}
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        host = re.match(html_wrappers.HOST, r["url"] or "")
        by_host.setdefault(host[1] if host else "", []).append(r["html"] or "")
    same = alone = total = 0
    for pages_ in by_host.values():
        if len(pages_) > 1:
            known, hosts = texts_of(pages_), texts_of([dumb(p) for p in pages_])
            same += sum(a == b for a, b in zip(known, hosts, strict=True))
            alone += sum(a == texts_of([dumb(p)])[0] for a, p in zip(known, pages_, strict=True))
            total += len(pages_)
    assert same >= 0.98 * total > alone


def naive_alignment(x, y):
    """The longest common subsequence, by recursion."""
    if not x or not y:
        return 0
    return naive_alignment(x[1:], y[1:]) + 1 if x[0] == y[0] else max(naive_alignment(x[1:], y), naive_alignment(x, y[1:]))


def test_alignment_by_brute_force():
    rng = random.Random(17)
    for _ in range(200):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        pairs = html_wrappers._pairs(x, y)
        assert [i for i, _ in pairs if i is not None] == list(range(len(x))) and [j for _, j in pairs if j is not None] == list(range(len(y)))
        both = [(i, j) for i, j in pairs if i is not None and j is not None]
        assert all(x[i] == y[j] for i, j in both) and len(both) == naive_alignment(x, y)


def test_slots_options_and_repeats():
    def wrapper(*pages_):
        w = None
        for p in pages_:
            own = html_wrappers.pattern(html_wrappers.parse(p))
            w = own if w is None else html_wrappers.aligned(w, own)
        return html_wrappers.expression(w)

    assert wrapper("<b>one</b>", "<b>two</b>") == "<b>#</b>"
    assert wrapper("<b>one</b>", "<b>one</b>") == "<b>one</b>"
    assert wrapper("<b>x</b><i>y</i>", "<b>x</b>") == "<b>x</b>(<i>y</i>)?"
    assert wrapper("<p>a<p>b<p>c", "<p>d") == "(<p>#</p>)+"
    assert wrapper("<p>a<p>b", "<i>x</i>") in ("(<p>#</p>)*(<i>x</i>)?", "(<i>x</i>)?(<p>#</p>)*")
