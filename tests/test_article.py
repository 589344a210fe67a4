"""Articles, fetched pages and functions in SQL."""

import re
from html import unescape

from pyspark.sql import functions as F

from lorebase.functions import session
from lorebase.sources import article, fetch

BLOG = """<html lang="en"><head><title>Site | T</title><meta name="author" content="Ann Lee"><meta property="og:title" content="On Stars"><meta name="description" content="d">
<style>p{}</style></head><body><div id="top-nav"><a href="/">Home</a> <a href="/a">About the site and many other things that one may read here</a></div>
<h1>On Stars</h1><time datetime="2024-05-06">May</time>
<p>Stars are large balls of gas that shine by fusion in their cores &amp; cool slowly.</p><p>Short one.</p>
<p>They live for long, some for billions of years, and end in <a href="x">several</a> ways that we know well.</p>
<table><tr><th>Name</th><th>Mass</th></tr><tr><td>Sun</td><td>1.0</td></tr></table>
<pre>a = 1
  b = 2</pre>
<p>The last paragraph of this text says goodbye to all of its patient readers today.</p>
<div class="comments"><p>First comment that is long enough to be taken for a paragraph of the text itself.</p></div>
<ul><li><a href="1">Another long title of some other article on this very same site here</a></li></ul>
<footer>Copyright of the people who wrote all of this over the years, and of no others.</footer></body></html>"""


def test_the_article_alone():
    a = article.article_of(BLOG)
    assert a["title"] == "On Stars" and a["author"] == "Ann Lee" and a["date"] == "2024-05-06" and a["language"] == "en" and a["description"] == "d"
    assert a["text"].startswith("# On Stars") and "fusion in their cores & cool" in a["text"] and "Short one." in a["text"]
    assert "Name | Mass\nSun | 1.0" in a["text"] and "```\na = 1\n  b = 2\n```" in a["text"] and a["text"].endswith("patient readers today.")
    for gone in ("Home", "comment", "Another", "Copyright", "p{}"):
        assert gone not in a["text"]
    assert article.article_of("")["text"] == "" and article.article_of("<p>a<p>b")["title"] is None


def test_articles_of_a_whole_table(spark):
    """Each page's own paragraphs and none of its navigation, advertisement and footer."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    plain = lambda x: re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", " ", x))).strip()
    got = {r["page_id"]: r for r in article.articles(pages).collect()}
    assert got.keys() == html.keys()
    for i, h in html.items():
        text = re.sub(r"\s+", " ", got[i]["text"])
        inner = re.search(r"<article>(.*)</article>", h, re.S)[1]
        for p in re.findall(r"<p>([^<]+)</p>", inner):
            assert plain(p) in text
        assert "©" not in text and not re.search(r"var t=|p\{margin", text)
        ad = plain(re.search(r'<div class="ad">(.*?)</div>', h, re.S)[1])
        assert ad not in text or ad in plain(inner)
        assert re.sub(r"\W", "", text.lstrip("# ")) == re.sub(r"\W", "", plain(inner)), i


def test_fallback_and_nulls(spark):
    rows = [(1, "https://www.a.org/x", None), (2, None, "<title>T</title><p>tiny</p>"), (3, "u", "<<<&#0; not & closed <b")]
    got = {r["page_id"]: (r["domain"], r["title"], r["text"]) for r in article.articles(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[1] == ("a.org", "", "") and got[2][1:] == ("T", "T tiny") and got[3][2]


def test_fetching_by_host(spark, tmp_path):
    log = str(tmp_path / "log")

    def get(url):
        with open(log, "a") as f:
            f.write(f"get {url}\n")
        if "bad" in url or "once" in url and open(log).read().count(url) == 1:
            raise OSError("refused")
        return (b"%PDF-1.7", "application/pdf") if "pdf" in url else (b"<p>\xff ok", "text/html")

    def wait(seconds):
        with open(log, "a") as f:
            f.write(f"wait {seconds}\n")

    urls = spark.createDataFrame([(u,) for u in ("http://a.org/1", "http://a.org/2", "http://a.org/2", "http://a.org/once", "http://a.org/bad", "http://a.org/p.pdf", None)], "url string")
    got = {r["url"][13:]: (r["status"], r["html"], r["tries"]) for r in fetch.fetched(urls, get, delay=1.0, tries=3, wait=wait).collect()}
    assert got == {"1": ("ok", "<p>� ok", 1), "2": ("ok", "<p>� ok", 1), "once": ("ok", "<p>� ok", 2), "bad": ("OSError: refused", None, 3), "p.pdf": ("pdf", None, 1)}
    said = open(log).read().split("\n")[:-1]
    assert said[0].startswith("get") and all(a.startswith("wait") or b.startswith("wait") for a, b in zip(said, said[1:], strict=False)) and "wait 4.0" in said


def test_functions_in_sql(spark):
    assert session.register(spark) == ["lore_tokens", "lore_wikilinks", "lore_chunks", "lore_slug"]
    spark.createDataFrame([(1, "Déjà vu, [[A b#s|l]] [[C]]"), (2, ""), (3, None), (4, "a b c d e")], "id int, t string").createOrReplaceTempView("lore_test")
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT id, term FROM lore_test, LATERAL lore_tokens(t) WHERE id = 1 ORDER BY place LIMIT 3") == [(1, "deja"), (1, "vu"), (1, "a")]
    assert rows("SELECT w.* FROM lore_test, LATERAL lore_wikilinks(t) w ORDER BY place") == [(1, "A b", "s", "l"), (2, "C", None, None)]
    assert rows("SELECT id, c.place, c.chunk FROM lore_test, LATERAL lore_chunks(t, 3, 1) c WHERE id > 1 ORDER BY 1, 2") == [(4, 1, "a b c"), (4, 2, "c d e")]
    assert rows("SELECT lore_slug(' A  b_C! ')") == [("a-b-c",)]


def test_pages_are_read_few_at_a_time():
    """Of a large batch a task holds few pages as texts."""
    import pyarrow as pa

    given = pa.RecordBatch.from_pydict({"page_id": list(range(950)), "url": ["u"] * 950, "html": ["<p>one two</p>"] * 950, "plain": ["one two"] * 950})
    got = list(article._articles_of(iter([given])))
    assert [i for b in got for i in b.column("page_id").to_pylist()] == list(range(950)) and max(b.num_rows for b in got) <= article.PAGES < 950


def test_a_long_page_without_an_article_keeps_its_whole_text(spark):
    """The text that stands in for an article has no limit."""
    words = [f"w{k}" for k in range(30_000)]
    html = "".join(f'<p><a href="/{w}">{w}</a></p>' for w in words)
    got = article.articles(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")).first()
    assert got["text"] == " ".join(words) and len(got["text"]) > 50_000
