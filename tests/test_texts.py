"""Shared passages against a plain search, main text against another parser."""

import random
import re
from html.parser import HTMLParser

import pytest

from marlstone.operators.pages import AROUND, BLOCKS, HIDDEN, blocks, main_text, main_texts
from marlstone.operators.passages import shared_passages

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_passages(docs, items, n):
    out = []
    for d, t in set(docs):
        a = WORD.findall((t or "").lower())
        found = set()
        for item, text in items:
            b = WORD.findall((text or "").lower())
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] != b[j] or i and j and a[i - 1] == b[j - 1]:
                        continue
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                        k += 1
                    if k >= n:
                        found.add((d, item, i, j, k))
        out += found
    return sorted(out, key=str)


def test_passages_equal_a_plain_search(spark):
    rng = random.Random(4)
    words = ["w1", "w2", "w3", "É", "A1"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, text(rng.randint(0, 14))) for i in range(15)] + [(99, None), (98, ""), (97, "never seen words at all here"), (1, "w1 w2 w3 w1 w2 w3")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)]
    docs += [(100 + i, f"{text(3)}, {items[i][1].upper()}! {text(3)} {items[i][1]}") for i in range(10)]
    docs += [(3, docs[3][1]), (3, docs[4][1]), (None, docs[100 - 40][1]), (200, None), (201, ""), (202, f"{text(3)} " * 2000 + items[2][1])]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, words string, `a.b` int").repartition(4)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id int, text string, doc_start string")
    got = sorted((tuple(r) for r in shared_passages(d, b, "doc_id", "item_id", words=4).collect()), key=str)
    assert got == plain_passages(docs, items, 4) and len(got) > 50


def test_passages_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    find = lambda d, b: [tuple(r) for r in shared_passages(d, b, "doc_id", "item_id", words=3).collect()]
    assert find(d, b) == [(1, 1, 1, 0, 3)] and find(d.limit(0), b) == [] and find(d, b.limit(0)) == []


class Plain(HTMLParser):
    """Blocks by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.links, self.in_link, self.open = [], "", "", False, []

    def cut(self):
        text = " ".join(self.text.split())
        if text:
            self.out.append((text, " ".join(self.links.split()) != ""))
        self.text = self.links = ""

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in AROUND or tag in HIDDEN or tag == "title":
            self.cut()
        if tag == "a":
            self.in_link = True
        if tag in AROUND or tag in HIDDEN:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in AROUND or tag in HIDDEN or tag == "title":
            self.cut()
        if tag == "a":
            self.in_link = False
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.open:
            self.text += data
            self.links += data if self.in_link else ""


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_blocks_of_all_pages_equal_another_parser(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "html").collect()
    assert len(pages) > 20
    for r in pages:
        parser = Plain()
        parser.feed(r.html or "")
        parser.close()
        parser.cut()
        assert [(t, linked > 0) for t, linked in blocks(r.html or "")] == parser.out, r.page_id


LONG = "one two three four five six seven eight"


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        (LONG, LONG),
        ("too short", ""),
        (f"<p>{LONG}<p>nine and ten more words", f"{LONG}\nnine and ten more words"),  # half as long, beside a good block
        (f"<p>{LONG}<p>x<p>a b c d e", LONG),
        (f"<div><a href='/a>b'>{LONG}</a></div><div>{LONG}</div>", LONG),  # a list of links is none
        (f"<script>if (a</p>b) '{LONG}'</SCRIPT><p>{LONG}", LONG),
        (f"<script>{LONG} never closed", ""),
        (f"<nav><ul><li>{LONG}</ul><footer>x</nav>{LONG}", LONG),  # closing nav closes what is open inside
        (f"</nav></div></p>{LONG} <b>bold</i> &amp; &lt;end&gt;", f"{LONG} bold & <end>"),
        (f"{LONG} 1 < 2 and <3 <!-- <p>hidden --><!DOCTYPE x> end", f"{LONG} 1 < 2 and <3 end"),
        (f"{LONG} <!-- never closed", LONG),
        (f"{LONG} <a title=\"x>y\" unclosed", f'{LONG} <a title="x>y" unclosed'),
        (f"<nav/>{LONG}<br/>{LONG}", f"{LONG}\n{LONG}"),
        (f"<title>{LONG} <b></title>x", ""),
    ],
)
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_long_pages_and_odd_rows(spark):
    long = f"<p>{LONG}</p>" * 50_000 + "<" * 20_000 + "<div " * 20_000
    rows = [(1, long, "x"), (1, None, "x"), (None, f"<p>{LONG}", "x"), (2, "", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, main_text string")
    got = [(r.page_id, len(r.main_text)) for r in main_texts(df, "page_id", "html").collect()]
    assert sorted(got[1:], key=str) == [(1, 0), (2, 0), (None, len(LONG))] and got[0][0] == 1 and got[0][1] >= 50_000 * len(LONG)
    assert main_texts(df.limit(0), "page_id", "html").count() == 0
