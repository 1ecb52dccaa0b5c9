"""Main text of whole pages against an article read by the standard library's parser, and markup that must not cost text."""

from html.parser import HTMLParser

import pytest

from corpusmill.llm import html_extract, queries

SF = "/root/testdata/sf0.01"
BLOCKS = {"h1", "h2", "h3", "p", "li", "ul", "ol", "div", "blockquote", "td", "tr", "table", "section", "article"}


class Article(HTMLParser):
    """Blocks of the page's <article>; <br> is a blank."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks, self.held = 0, [], []

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.blocks += [text] if text else []
        self.held = []

    def handle_starttag(self, tag, attrs):
        if self.inside and tag in BLOCKS:
            self.flush()
        self.inside += tag == "article"
        if tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if self.inside and tag in BLOCKS:
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.held.append(data)


def brute(page):
    reader = Article()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return "\n\n".join(reader.blocks)


@pytest.fixture(scope="module")
def field():
    return html_extract.train()


def test_query_on_all_pages(spark):
    got = {r.page_id: r for r in queries.queries()["op6_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        want = brute(p.html)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


def page(body):
    return f"<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>one</a></li><li><a href='/b'>two</a></li></ul></nav><article><h1>Some title of it</h1><p>First words that open the article in full.</p>{body}<p>Last words that end the article in full.</p></article><footer>&copy; somebody.example.org and more</footer></body></html>"


@pytest.mark.parametrize("body, want", [
    ("<p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of them.</p>", "Where x=2 holds for all of them."),
    ("<noscript><p>Read this part without any scripts at all.</p></noscript>", "Read this part without any scripts at all."),
    ("<p>Seen in <object data='x'>the old picture</object> of the town.</p>", "Seen in the old picture of the town."),
    ("<p>Drawn <svg viewBox='0 0 1 1'><text>by hand</text></svg> in the end.</p>", "Drawn by hand in the end."),
    ("<p>A figure <svg><path d='M0'> that nobody closed at the time.</p>", "A figure that nobody closed at the time."),
    ("<p>A formula <math><mi>y</mi> that nobody closed at the time.</p>", "A formula y that nobody closed at the time."),
    ("<p>The <my-word>own</my-word> element of the house, twice.</p>", "The own element of the house, twice."),
    ("<!--><p>Shown after a comment that was empty from the start.</p>", "Shown after a comment that was empty from the start."),
    ("<!-- a --!><p>Shown after a comment with a strange end to it.</p>", "Shown after a comment with a strange end to it."),
    ("<p>Before the code<script>if (a < b) { document.write('<p>no</p>') }</script> and after it.</p>", "Before the code and after it."),
    ("<p>Tom &amp; Jerry &lt;b&gt; &#233;t&eacute; &nbsp; and so on.</p>", "Tom & Jerry <b> été and so on."),
])
def test_article_text_stays(field, body, want):
    assert html_extract.main_blocks(page(body), field) == ["Some title of it", "First words that open the article in full.", want, "Last words that end the article in full."]


def test_unclosed_code_lasts_to_the_end(field):
    for body in ("<script>var a;", "<style>p {", "<!-- never closed"):
        assert html_extract.main_blocks(page(body), field) == ["Some title of it", "First words that open the article in full."]


def test_long_pages_and_clashing_columns(spark, field):
    long = "".join(f"<p>Paragraph {i} of the very long article goes on and on here.</p>" for i in range(30_000))
    rows = [(1, "u", page(long), "a", 1), (1, "u", page(long), "b", 2), (None, None, None, "c", None), (2, "w", "", "d", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(html_extract.extract(pages, field).collect(), key=lambda r: str(r.page_id))
    assert [r.page_id for r in got] == [1, 1, 2, None] and got[0] == got[1] and got[0].text.count("\n\n") == 30_002
    assert [(r.text, r.n_chars) for r in got[2:]] == [("", 0)] * 2 and html_extract.extract(pages.where("false"), field).count() == 0


@pytest.mark.parametrize("name, page, blocks", [
    ("tags that never end", "<a " * 350_000, 1), ("quotes that never end", '<a "' * 250_000, 1), ("quotes of both kinds", "<a \"'>" * 170_000 + "<b '", 1), ("nested elements", "<div>x" * 170_000, 170_000),
    ("nested and closed", "<div>x" * 80_000 + "</div>" * 80_000 + "tail", 80_001), ("plain divs", "<div>word word.</div>" * 50_000, 50_000), ("items over open buttons", "<li><ul>" + "<button>" * 60_000 + "<li>x" * 60_000, 60_000),
    ("comments", "<!--" * 250_000, 0), ("declarations", "<!x " * 250_000, 1), ("ends without a start", "<div>" * 100_000 + "</p>" * 100_000, 0), ("open scripts", "<script>" * 125_000, 0), ("an end at last", "<a " * 300_000 + ">y", 1),
])
def test_a_megabyte_of_odd_markup_takes_seconds(field, name, page, blocks):
    import time

    began = time.process_time()
    html_extract.main_blocks(page, field)
    assert time.process_time() - began < 20 and len(html_extract.leaf_blocks(page)) == blocks


def test_depth_is_bounded_and_ends_stay_paired():
    deep = "<div>" * 2000 + "in" + "</div>" * 1999 + "still<aside>side</aside></div>out"
    found = html_extract.leaf_blocks(deep)
    assert [b.text for b in found] == ["in", "still", "side", "out"]
    assert found[1].path.tags == {"div"} and found[2].path.tags == {"div", "aside"} and found[3].path.tag == ""


def test_text_without_a_shell(field):
    page = "<html><body><ul id=nav><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul>{}<div class=footer>Copyright 2024 example.org</div></body></html>"
    one, two = "Some prose without any hint of a class, long enough to be a paragraph of text.", "More prose follows it, and it ends here."
    for body in (f"<div><p>{one}</p><div>{two}</div></div>", f"<div>{one}</div><div>{two}</div>", f"<h1>{one}</h1><p>{two}</p>", f"<div><div>{one}</div><div>{two}</div></div>"):
        assert html_extract.main_blocks(page.format(body), field) == [one, two]


def test_written_pages_of_another_seed(field):
    import numpy as np

    rng, wrong, all_ = np.random.default_rng(99), 0, 0
    for _ in range(200):
        page, labels = html_extract.written_page(rng)
        blocks = html_extract.leaf_blocks(page)
        got = field.decode([html_extract.features(b, blocks[k - 1] if k else None) for k, b in enumerate(blocks)])
        wrong, all_ = wrong + sum(a != b for a, b in zip(got, labels)), all_ + len(labels)
    assert wrong < 0.005 * all_
