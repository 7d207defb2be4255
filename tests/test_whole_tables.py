"""Queries without SQL, held to Python over whole tables."""

import re
from html.parser import HTMLParser

import duckdb

from tidewire.operators import similar
from tidewire.plans import catalog


def test_repeats_collapse_as_in_python(spark, tiny):
    got = {r.id: r.title for r in catalog.queries()["str05_collapse_repeats"](spark, tiny).collect()}
    rows = duckdb.sql(f"select doc_id, substr(split_part(text, chr(10), 1), 1, 500) from '{tiny}/documents.parquet'").fetchall()
    assert got == {i: re.sub(r"^(.+?)( \1)+$", r"\1", t) for i, t in rows}


class Blocks(HTMLParser):
    """Texts of paragraphs, items and headings, with the roots that they stand in; nothing of scripts, forms and chrome."""

    def __init__(self):
        super().__init__()
        self.blocks, self.roots, self.hidden, self.open = [], [], 0, None

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in similar_drop
        if tag in ("article", "main"):
            self.roots.append(tag)
        if tag in ("p", "li", "h2", "h3"):
            self.flush()
            self.open = ""

    def handle_endtag(self, tag):
        if tag in similar_drop:
            self.hidden = max(0, self.hidden - 1)
        if tag in ("p", "li", "h2", "h3", "article", "main", "body"):
            self.flush()
        if tag in self.roots:
            self.roots.remove(tag)

    def handle_data(self, data):
        if self.open is not None and not self.hidden:
            self.open += data

    def flush(self):
        if self.open is not None and len(" ".join(self.open.split())) >= 60:
            self.blocks.append((" ".join(self.open.split()), set(self.roots)))
        self.open = None


similar_drop = {"script", "style", "noscript", "svg", "form", "iframe", "nav", "header", "footer", "aside", "button"}


def body_of(html):
    parser = Blocks()
    parser.feed(html or "")
    parser.flush()
    good = [(t, roots) for t, roots in parser.blocks if not re.search(similar.JUNK, t, re.I)]
    for root in ("article", "main"):
        if any(root in roots for _, roots in good):
            return "\n".join(t for t, roots in good if root in roots)[:12000]
    return "\n".join(t for t, _ in good)[:12000]


def test_pages_and_stubs(spark, tiny):
    """Bodies of all pages, and the short documents that get them."""
    html = dict(duckdb.sql(f"select page_id, html from '{tiny}/pages.parquet'").fetchall())
    got = {r.page_id: r.body for r in catalog.queries()["htm01_extract"](spark, tiny).collect()}
    bodies = {i: body_of(h) for i, h in html.items()}
    assert got == bodies and sum(len(b) > 100 for b in bodies.values()) > len(bodies) / 2
    want = {}
    for i, text in duckdb.sql(f"select doc_id, text from '{tiny}/documents.parquet'").fetchall():
        stub = len(text) < 600
        gains = stub and len(bodies.get(i, "")) > len(text)
        want[i] = (len(bodies[i]) if gains else len(text), gains if stub else None, i % 5 != 0 and not gains)
    assert {r.id: (r.chars, r.enriched, r.translated) for r in catalog.queries()["enr01_enrich"](spark, tiny).collect()} == want
    assert any(e for _, e, _ in want.values())


def test_summaries_that_are_cut_anew_end_well(spark, tiny):
    docs = dict(duckdb.sql(f"select doc_id, text from '{tiny}/documents.parquet'").fetchall())
    got = catalog.queries()["flt10_cut_summaries"](spark, tiny).collect()
    assert got and all(r.id % 3 and len(r.summary) <= 161 and " ".join(docs[r.id].split()).find(r.summary.rstrip("…").strip()[:40]) >= 0 for r in got)


def test_pages_go_through_row_by_row(spark):
    """Workers hold few pages at a time: no batch of Arrow or pandas, whose size follows from the pages'."""
    from tidewire.operators import similar

    html = "<article><p>" + "word " * 40 + "</p></article>"
    pages = spark.createDataFrame([(i, "u", html if i else None) for i in range(250)], "page_id long, url string, html string")
    got = similar.strip_pages(pages)
    plan = got._jdf.queryExecution().toString()  # noqa: SLF001
    assert "BatchEvalPython" in plan and "MapIn" not in plan
    assert {(r.page_id, r.url, r.body) for r in got.collect()} == {(i, "u", ("word " * 40).strip() if i else "") for i in range(250)}


def test_pages_are_read_to_their_end(spark):
    """Long pages have all their paragraphs; text that ends near an ampersand and without a closing tag isn't lost."""
    texts = [f"paragraph {i} of a very long page, " + "word " * 20 + f"end {i}" for i in range(400)]
    last = "a page that breaks off in the middle of a paragraph about research & development"
    rows = [(1, "u", "<article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article>"), (2, "u", f"<p>{texts[0]}</p><p>{last}")]
    got = {r.page_id: r.body for r in similar.strip_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "\n".join(texts), 2: f"{texts[0]}\n{last}"} and len(got[1]) > 50_000
