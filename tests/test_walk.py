"""Links, parents and cards of pages against a small tree built tag by tag."""

import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions import walk as W
from newsloom.operators import links as L

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TOKEN = re.compile(r"<(/?)([a-z0-9]+)((?:\s+[a-z]+=\"[^\"]*\")*)\s*(/?)>")
DATE = re.compile(r"\d{2}\.\d{2}\.\d{4}")


class Node:
    def __init__(self, name, attributes, parent, start):
        self.name, self.attributes, self.parent, self.start, self.end = name, attributes, parent, start, None
        self.classes = attributes.get("class", "").split()

    def around(self, inclusive=True):
        node = self if inclusive else self.parent
        while node is not None:
            yield node
            node = node.parent


def tree(page):
    """All elements in order; an element ends where its tag or one around it is closed."""
    nodes, stack = [], []
    for m in TOKEN.finditer(page):
        closing, name, attributes, single = m.groups()
        if closing:
            if any(n.name == name for n in stack):
                while True:
                    last = stack.pop()
                    last.end = m.start()
                    if last.name == name:
                        break
            continue
        node = Node(name, dict(re.findall(r'([a-z]+)="([^"]*)"', attributes)), stack[-1] if stack else None, m.end())
        nodes.append(node)
        if single or name in H.VOID:
            node.end = m.end()
        else:
            stack.append(node)
    for node in stack:
        node.end = len(page)
    return nodes


def listed(page):
    nodes, found = tree(page), {}
    for link in nodes:
        if link.name == "a" and "article-links" in link.classes:
            card = next((n for n in link.around() if "card" in n.classes), None)
            info = next((n for n in nodes if card and "card-info" in n.classes and card in n.around(False)), None)
            date = DATE.search(re.sub(r"<[^>]*>", "\n", page[info.start:info.end])) if info else None
            found.setdefault(link.attributes["href"], date.group() if date else "")
    return found


def made(rng):
    """A page of nested, unclosed, wrongly closed and void elements."""
    parts, number = [], 0
    for _ in range(rng.randrange(5, 60)):
        kind = rng.random()
        name = rng.choice(["div", "span", "li", "p", "section", "a", "br", "b"])
        cls = rng.choice(["", "card", "x card", "card-info", "card card-info", "cards", "teaser", "card-title"])
        if kind < 0.45:
            extra = ""
            if name == "a":
                number += 1
                extra, cls = f' href="/news/{number}"', rng.choice(["article-links", "article-links card", "other", "card"])
            parts.append(f'<{name}{extra} class="{cls}"{rng.choice(["", "", "", " /"])}>')
        elif kind < 0.8:
            parts.append(f"</{rng.choice(['div', 'span', 'li', 'p', 'section', 'a', 'b'])}>")
        else:
            parts.append(rng.choice(["text ", f"0{rng.randrange(1, 9)}.01.2024 ", "<h2>t</h2>", "<!-- 09.09.1999 -->"]))
    return "".join(parts)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(8)
    return {f"https://x.example.com/{i}": made(rng) for i in range(400)}


@pytest.mark.parametrize("block", [1, 7, W.BLOCK])
def test_nearest_cards(spark, pages, monkeypatch, block):
    monkeypatch.setattr(W, "BLOCK", block)
    frame = spark.createDataFrame(list(pages.items()), "url string, html string")
    got = {}
    for r in L.card_links(frame).collect():
        got.setdefault(r.source_url, {})[r.article_url.removeprefix(r.source_url)] = r.listing_date
    assert got == {url: found for url, page in pages.items() if (found := listed(page.replace("<!-- 09.09.1999 -->", "")))}


def test_parents_of_all_links(spark, pages):
    frame = spark.createDataFrame(list(pages.items()), "url string, html string")
    got = {(r.source_url, r.href): (r.pos, r.parent_class) for r in L.anchors(frame, holders=F.lit(True)).collect()}
    want = {}
    for url, page in pages.items():
        for pos, n in enumerate(n for n in tree(page) if n.name == "a"):
            want[url, n.attributes["href"]] = (pos, n.parent.attributes.get("class", "") if n.parent else "")
    assert got == want


def test_a_stray_quote_shifts_no_parent(spark):
    good = '<div class="x"><a href="/one">1</a></div><div class="teaser"><a href="/two">2</a></div>'
    stray = """<div class="teaser"><a href='/bad>b</a></div>"""
    for page in (good, stray + good):
        frame = spark.createDataFrame([("https://x.example.com/", page)], "url string, html string")
        assert [r.article_url for r in L.static_links(frame).collect()] == ["https://x.example.com/two"]
        assert [(r.pos, r.href) for r in L.anchors(frame).orderBy("pos").collect()] == [(0, "/one"), (1, "/two")]


def test_headings_belong_to_their_link(spark):
    page = '<h2>a</h2><a href="/1"><b><h3>x</h3></b></a><a href="/2">y</a><h2>z</h2><a href="/3"><a href="/4"><h2>w</h2></a>'
    frame = spark.createDataFrame([("https://x.example.com/", page)], "url string, html string")
    assert [r.href for r in L.anchors(frame).filter("has_heading").orderBy("pos").collect()] == ["/1", "/4"]


def test_fifty_thousand_links_in_a_default_heap():
    """In a session of its own, without any setting for memory."""
    code = """
import time
from newsloom.session import build_session
from newsloom.operators import links as L
spark = build_session("local[2]", {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
page = '<div class="teaser card">' + "".join(f'<a class="article-links" href="/news/{i}">x</a>' for i in range(50_000)) + "</div>"
frame = spark.createDataFrame([("https://x.example.com/", page)], "url string, html string")
print("links", L.static_links(frame).count(), L.rendered_links(frame).count(), L.card_links(frame).count())
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert "links 50000 50000 50000" in run.stdout, run.stderr[-2000:]
