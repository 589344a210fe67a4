"""SRC-07: the article of a page, without what stands around it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx

# Elements that end a block, those that are never article text, and words of
# classes and ids that say the same of an element.
BLOCKS = {"p", "div", "section", "article", "main", "body", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "dt", "dd", "figure", "figcaption", "br", "hr", "html", "head", "title", "header", "footer", "nav", "aside", "form"}
NEVER = {"script", "style", "noscript", "template", "nav", "footer", "aside", "form", "iframe", "svg", "button", "select", "textarea", "head"}
AROUND = re.compile(r"(^|[^a-z])(comments?|sidebar|menu|nav|navbar|breadcrumbs?|footer|ads?|advert(isement)?|promo|share|social|related|cookie|newsletter|disqus)([^a-z]|$)")
VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Words of a block that carries itself, the links' part above which it is a list of links.
WORDS, LINKS = 10, 0.33
#: Pages that a task has as Python's texts at once.
PAGES = 100
SCHEMA = "title string, text string, author string, date string, language string, description string"


class _Page(HTMLParser):
    """Blocks of a page: [kind, text parts, linked characters, inside an article]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.open: list[tuple[str, bool]] = []
        self.meta: dict[str, str] = {}
        self.skip = self.links = self.cells = self.inside = 0
        self.heading, self.title, self.in_title, self.raw = "", "", False, 0

    def _new(self, kind: str = "p") -> None:
        self.blocks.append([kind, [], 0, self.inside > 0])

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html" and a.get("lang"):
            self.meta.setdefault("language", a["lang"])
        if tag == "meta" and (name := (a.get("name") or a.get("property") or "").lower()):
            self.meta.setdefault(name, a.get("content", ""))
        if tag == "time" and a.get("datetime"):
            self.meta.setdefault("time", a["datetime"])
        self.in_title = tag == "title" or self.in_title
        if tag in BLOCKS and not self.cells:
            self._new(tag)
        if tag == "tr":
            self._new(tag)
            self.cells += 1
        elif tag in ("td", "th") and self.blocks and self.blocks[-1][1]:
            self.blocks[-1][1].append(" | ")
        if tag in VOID:
            return
        away = tag in NEVER or tag not in ("body", "html", "article", "main") and bool(AROUND.search(f"{a.get('class', '')} {a.get('id', '')}".lower()))
        self.open.append((tag, away))
        self.skip += away
        self.links += tag == "a"
        self.inside += tag in ("article", "main")
        self.raw += tag == "pre"

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"
        if not any(t == tag for t, _ in self.open):
            return
        while True:  # what was left open inside ends with it
            t, away = self.open.pop()
            self.skip -= away
            self.links -= t == "a"
            self.inside -= t in ("article", "main")
            self.cells -= t == "tr" and self.cells > 0
            self.raw -= t == "pre"
            if t == tag:
                break
        if tag in BLOCKS and not self.cells:
            self._new()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if self.skip or not data:
            return
        if not self.blocks:
            self._new()
        text = data if self.raw else re.sub(r"\s+", " ", data)
        self.blocks[-1][1].append(text)
        if self.links:
            self.blocks[-1][2] += len(text.strip())


def article_of(html: str) -> dict[str, str | None]:
    """Title, text, author, date, language and description of one page.

    Blocks within ``article`` or ``main`` are the article, if there are any; else those of many words and few links, and short ones between two of
    these (after Kohlschütter's text density). Navigation, comments and forms go,
    table rows stay, headings and list entries are marked as in Markdown.
    """
    page = _Page()
    page.feed(html)
    page.close()
    rows = []
    for kind, parts, linked, inside in page.blocks:
        text = "".join(parts).strip("\n") if kind == "pre" else "".join(parts).strip()
        if text.strip():
            rows.append((kind, text, linked / len(text) > LINKS, len(text.split()), inside))
    good = [n >= WORDS and not links for _, _, links, n, _ in rows]
    if any(inside and not links for *_, links, _, inside in rows):
        keep = [inside and (g or not links) for (_, _, links, _, inside), g in zip(rows, good, strict=True)]
    else:
        keep = []
        for k, (kind, _, links, _, _) in enumerate(rows):
            before, after = k > 0 and good[k - 1], k + 1 < len(rows) and good[k + 1]
            keep.append(good[k] or not links and (before and after or kind in ("h1", "h2", "h3", "h4", "h5", "h6") and any(good[k + 1 : k + 4]) or kind in ("tr", "li", "pre") and (before or after or k > 0 and keep[k - 1])))
    mark = {**{f"h{k}": "#" * k + " " for k in range(1, 7)}, "li": "- ", "blockquote": "> "}
    lines, last = [], None
    for (kind, text, *_), k in zip(rows, keep, strict=True):
        if k:
            lines.append(("\n" if kind == last and kind in ("li", "tr") else "\n\n") * bool(lines) + (f"```\n{text}\n```" if kind == "pre" else mark.get(kind, "") + text))
            last = kind
    m = page.meta
    first = lambda *names: next((m[n].strip() for n in names if m.get(n, "").strip()), None)
    head = next((text for kind, text, *_ in rows if kind == "h1"), None)
    return {
        "title": first("og:title") or re.sub(r"\s+", " ", page.title).strip() or head, "text": "".join(lines), "author": first("author", "article:author"),
        "date": first("article:published_time", "date", "dc.date", "time"), "language": first("language", "og:locale"), "description": first("description", "og:description"),
    }


def _articles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for b in (whole.slice(at, PAGES) for whole in batches for at in range(0, whole.num_rows, PAGES)):
        found = [article_of(h or "") for h in b.column("html").to_pylist()]
        cols = [pa.array([f[n] for f in found], pa.string()) for n in names]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("plain"), *cols], ["page_id", "url", "plain", *names])


def articles(pages: DataFrame) -> DataFrame:
    """SRC-07/08: page_id, url, domain, title, text, author, date, language and
    description of fetched pages (page_id, url, html). A null page has an empty text;
    a page in which no article is found has its whole text, as far as it is no markup."""
    kind = dict(pages.dtypes)["page_id"]
    given = pages.select("page_id", "url", "html", tx.html_text(F.col("html"), limit=None).alias("plain"))
    out = given.mapInArrow(_articles_of, f"page_id {kind}, url string, plain string, {SCHEMA}")
    text = F.when(F.coalesce("text", F.lit("")) == "", F.coalesce("plain", F.lit(""))).otherwise(F.col("text"))
    return out.select("page_id", "url", tx.url_domain(F.col("url")).alias("domain"), F.coalesce("title", F.lit("")).alias("title"), text.alias("text"), "author", "date", "language", "description")
