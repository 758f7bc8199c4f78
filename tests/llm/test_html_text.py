import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

from keyspan.llm import html_text as H
from tests.llm.helpers import prose


def text(page):
    """What a page says outside elements that are noise by meaning."""
    tree = H.read_page(page)
    return "\n".join(t for node, t in tree.blocks if tree.trusts[node] != H.NOISE)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- a <p>comment</p> --><div class="ad">buy</div>
    <div id="cookie-notice">cookies</div><article><h1>Title &amp; more</h1><p><b>First   para
    graph.<br><p>Second<i>ary</i> &eacute;&#233;&nbsp;x</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><blockquote>q</blockquote>
    <section class="comments"><p>reader</p></section><form><input value="v">label</form></article><aside>side</aside><footer>&copy;</footer></body></html>"""
    assert text(page) == "Title & more\nFirst para graph.\nSecondary éé x\none\ntwo\nc1\nc2\nq"


def test_odd_pages():
    assert text("") == "" and text("plain text & more") == "plain text & more"
    assert text("<p>a<p>b</div></p>c<b>d") == "a\nb\ncd"
    assert text("<article><p>cut <a href='unfinished") == "cut"
    assert text("<p>1 < 2 &a &am &amp 3</p>") == "1 < 2 &a &am & 3"
    assert text("<div hidden>x</div><div style='display: none'>y</div><div role=navigation>z</div><p class=lead>k</p>") == "k"
    assert text("<div class='page with-sidebar'><p>x</p></div><div class='left-sidebar'>y</div>") == "x"
    assert text("<article><header><h1>kept</h1></header></article>") == "kept"
    assert text("<div>" * 3000 + "deep") == "deep"
    assert text("<p>" * 5000 + "x" + "<b><i>" * 5000 + "y") == "xy" and max(map(len, H.read_page("<div><p>a</p>" * 3000).paths())) < 8 * H.LEVELS
    assert len(text("<p>" + "word " * 200_000)) == 999_999


def pages(spark):
    rows = []
    for i in range(30):
        rows.append((i, f"http://a.test/{i}", f"<body><div class='top'><span>Our site</span></div><div class='story'><p>story number {i} says {i * i}</p></div><div class='base'>All rights</div></body>"))
    rows += [(100, "http://b.test/1", "<body><div class='top'>only page</div></body>"), (101, None, "<p>no host</p>"), (102, "http://a.test/x", None), (103, "http://a.test/y", ""), (0, "http://a.test/0", rows[0][2])]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, noise string")


def test_the_tree_drops_what_repeats(spark):
    df = pages(spark)
    got = {}
    for r in H.extract(spark, df).collect():
        got.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    assert sum(map(len, got.values())) == df.count() and len(got[0]) == 2
    assert all(got[i][0] == (f"story number {i} says {i * i}", len(f"story number {i} says {i * i}")) for i in range(30))
    assert got[100][0][0] == "only page" and got[101][0][0] == "no host" and got[102] == got[103] == [("", 0)]
    assert H.extract(spark, df.limit(0)).count() == 0


class Outline(HTMLParser):
    """Places, texts and kinds of children of a well-formed page, by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.places, self.said, self.looks = [("", 4)], {"": 4}, [], []
        self.children = [[]]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        path, trust = self.stack[-1]
        if trust:
            noise = tag in ("nav", "footer", "aside") or attrs.get("class") in ("ad", "comments", "sidebar")
            name = f"{tag}!" if noise else tag + "".join("." + re.sub("[0-9]+", "0", attrs[k]) for k in ("id", "class") if k in attrs)
            path, trust = f"{path}/{name}", 0 if noise else 24 if tag == "article" else trust
            if self.children[-1][-1:] != [name]:
                self.children[-1].append(name)
        self.stack.append((path, trust))
        self.children.append([])
        self.places[path] = trust

    def handle_endtag(self, tag):
        path, _ = self.stack.pop()
        children = self.children.pop()
        if path != self.stack[-1][0]:
            self.looks.append((path, " ".join(children)))

    def handle_data(self, data):
        if data.split():
            self.said.append((self.stack[-1][0], " ".join(data.split())))


def by_brute_force(rows, least):
    """{host: {path: importance}}, [text of each row]."""
    hosts = {}
    for url, page in rows:
        hosts.setdefault(url.split("/")[2], set()).add(page)
    trees = {}
    for host, pages in hosts.items():
        outlines = [Outline(p) for p in pages]
        for path in {x for o in outlines for x in o.places}:
            m = sum(path in o.places for o in outlines)
            trust = max(o.places.get(path, 0) for o in outlines)
            tells = 0.0
            for kind in ("looks", "said"):
                n = Counter(v for o in outlines for p, v in set(getattr(o, kind)) if p == path)
                total = sum(n.values())
                if total > 1:
                    tells = max(tells, -sum(c / total * math.log(c / total) for c in n.values()) / math.log(max(total, m)))
            trees.setdefault(host, {})[path] = (m * tells + trust) / (m + trust) if trust else 0.0
    return trees, ["\n".join(t for p, t in Outline(page).said if trees[url.split("/")[2]][p] >= least) for url, page in rows]


def test_extraction_against_a_brute_force_tree(spark):
    rng = random.Random(5)
    rows = []
    for i in range(260):
        host = "hot" if i < 130 else f"h{i % 7}"
        aside = f"<aside><p>{prose(rng, 3)}</p></aside>" * rng.randint(0, 1)
        share = "<div class='x'>Read more of our stories</div>" * rng.randint(0, 1) + "<p class='tail'>Thank you for reading</p>"
        body = "".join(f"<p>{prose(rng, rng.randint(1, 9))}</p>" for _ in range(rng.randint(1, 4)))
        rows.append((f"http://{host}.test/{i}", f"<html><body><div class='top{i}'>Our site</div><nav><ul><li>{prose(rng, 1)}</li><li>b</li></ul></nav><div class='ad'>{prose(rng, 4)}</div><article><h1>{prose(rng, 2)}</h1>{body}{share}</article>{aside}<div><p>same</p>tail {i}</div><div class='comments'><p>{prose(rng, 4)}</p></div><footer>{i}</footer></body></html>"))
    rows += rows[:5]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    trees, texts = by_brute_force(rows, H.LEAST_IMPORTANCE)
    assert {r["page_id"]: r["text"] for r in H.extract(spark, df).collect()} == dict(enumerate(texts))
    # the tree decides within the article too, and all of it is the tree's doing
    assert not any("Thank you" in t or "Our site" in t for t in texts[:130]) and any("Thank you" in t for t in texts[130:])
    off = [r["text"] for r in H.extract(spark, df, least=0.0).orderBy("page_id").collect()]
    assert all(a != b and "Our site" in b for a, b in zip(texts, off, strict=True))
    of_host = {}
    for url, page in rows:
        tree = H.read_page(page)
        of_host.setdefault(url.split("/")[2], {}).update(zip(tree.ids, tree.paths(), strict=True))
    got = {(r["host"], of_host[r["host"]][r["node"]]): r["importance"] for r in H.style_tree(H.parse_pages(df)).collect()}
    expected = {(host, path): v for host, tree in trees.items() for path, v in tree.items()}
    assert set(got) == set(expected) and all(abs(got[k] - expected[k]) < 1e-9 for k in expected)


def test_long_blocks_that_start_alike_differ(spark):
    same = "word " * 1000
    rows = [(i, "http://a.test/", f"<body><div class='story'>{same} {i:03}</div></body>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{same}{i:03}" for i in range(20)}


def test_copies_of_a_page_are_one_page_of_the_tree(spark):
    one = "<body><div class='top'>Our site</div><div class='story'><p>the same long story</p></div></body>"
    rows = [(i, "http://a.test/", one) for i in range(90)]
    rows += [(100 + i, "http://a.test/", f"<body><div class='top'>Our site</div><div class='story'><p>story {i}</p></div></body>") for i in range(10)]
    rows += [(200 + i, "http://b.test/", one) for i in range(8)]
    rows += [(300 + i, "http://a.test/", f"<body><div class='top'>Our site</div><div class='story'><p>tale {i}</p></div></body>") for i in range(10)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "the same long story" for i in range(90)) and all(got[100 + i] == f"story {i}" for i in range(10))
    assert all(got[200 + i] == "Our site\nthe same long story" for i in range(8)) and len(got) == 118
