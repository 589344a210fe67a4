"""Bookmark files as rows: (title, url, folder_path, added_at, domain)."""

from __future__ import annotations

import json
import plistlib
import sqlite3
import tempfile
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as tx

RAW = "title string, url string, folder_path string, stamp string, clock string"


class _Netscape(HTMLParser):
    """SRC-01: folders are H3 headings, each closed by its list's end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.folders: list[str | None] = []
        self.heading: str | None = None
        self.link: dict | None = None
        self.words: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("h3", "a"):
            self._close()
            self.words = []
            self.link = dict(attrs) if tag == "a" else None
        elif tag == "dl":
            self._close()
            self.folders.append(self.heading)
            self.heading = None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h3", "a"):
            self._close()
        elif tag == "dl" and self.folders:
            self._close()
            self.folders.pop()

    def handle_data(self, data: str) -> None:
        if self.words is not None:
            self.words.append(data)

    def _close(self) -> None:
        if self.words is None:
            return
        words, self.words = " ".join("".join(self.words).split()), None
        if self.link is None:
            self.heading = words
        elif url := self.link.get("href"):
            self.rows.append((words or url, url, " / ".join(f for f in self.folders if f), self.link.get("add_date"), "unix"))
        self.link = None


def netscape(data: bytes) -> Iterator[tuple]:
    p = _Netscape()
    p.feed(data.decode("utf-8", "replace"))
    p.close()
    yield from p.rows


def chromium(data: bytes) -> Iterator[tuple]:
    """SRC-02: the tree of three roots; times in microseconds since 1601."""
    roots = json.loads(data).get("roots", {})
    todo = [(roots[r], ()) for r in ("bookmark_bar", "other", "synced") if isinstance(roots.get(r), dict)][::-1]
    while todo:
        node, path = todo.pop()
        if node.get("type") == "url" and node.get("url"):
            yield node.get("name") or node["url"], node["url"], " / ".join(path), node.get("date_added"), "chrome"
        name = node.get("name")
        todo += [(c, (*path, name) if name else path) for c in reversed(node.get("children", []))]


def safari(data: bytes) -> Iterator[tuple]:
    """SRC-03: nested Children; labels of the system are no folders, no dates."""
    todo = [(plistlib.loads(data), ())]
    while todo:
        node, path = todo.pop()
        if url := node.get("URLString"):
            yield node.get("URIDictionary", {}).get("title") or url, url, " / ".join(path), None, "none"
        name = node.get("Title")
        inner = (*path, name) if name and not name.startswith("com.apple.") else path
        todo += [(c, inner) for c in reversed(node.get("Children", []))]


def firefox(data: bytes) -> Iterator[tuple]:
    """SRC-04: bookmarks joined with places, the chain of parents as the path."""
    with tempfile.NamedTemporaryFile(suffix=".sqlite") as f:  # a worker's own copy, read and gone
        f.write(data)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro&immutable=1", uri=True)
        try:
            folders = {i: (parent, title) for i, parent, title in db.execute("SELECT id, parent, title FROM moz_bookmarks WHERE type = 2")}
            for title, parent, added, url in db.execute("SELECT b.title, b.parent, b.dateAdded, p.url FROM moz_bookmarks b JOIN moz_places p ON p.id = b.fk WHERE b.type = 1 ORDER BY b.id"):
                path, seen = [], set()
                while parent in folders and parent not in seen:
                    seen.add(parent)
                    parent, name = folders[parent]
                    if name:
                        path.append(name)
                yield title or url, url, " / ".join(reversed(path)), added and str(added), "firefox"
        finally:
            db.close()


FORMATS = {"netscape": netscape, "chromium": chromium, "safari": safari, "firefox": firefox}


def _typed(raw: DataFrame) -> DataFrame:
    added = F.when(F.col("clock") == "unix", tx.unix_seconds(F.col("stamp"))).when(F.col("clock") == "chrome", tx.chrome_micros(F.col("stamp"))).when(F.col("clock") == "firefox", tx.unix_micros(F.col("stamp")))
    return raw.select("title", "url", "folder_path", added.alias("added_at"), tx.url_domain(F.col("url")).alias("domain"))


def read_bookmarks(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """The bookmarks in every file under ``path``; a file that cannot be parsed has none."""
    parse = FORMATS[fmt]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for data in pdf["content"]:
                try:
                    rows += list(parse(bytes(data)))
                except (ValueError, KeyError, sqlite3.DatabaseError, plistlib.InvalidFileException):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])

    return _typed(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RAW))


# What stands before and after the entries of a file.
FRAMES = {
    "netscape": ("<!DOCTYPE NETSCAPE-Bookmark-file-1>\n<DL><p>\n", "</DL><p>\n"),
    "chromium": ('{"roots": {"bookmark_bar": {"type": "folder", "name": "", "children": [{"type": "folder", "children": []}', "]}}}\n"),
}


def file_rows(marks: DataFrame, fmt: str) -> DataFrame:
    """(file_path, place, body): the files of ``marks`` (file_path, place from 0, title,
    url, folder, added in seconds) as rows for ``vault.write_files``, ordered by place;
    a row for each bookmark, in its folder. Titles and folders may be null."""
    if fmt == "netscape":

        def escaped(c: str):
            x = F.coalesce(c, F.lit(""))
            for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
                x = F.replace(x, F.lit(k), F.lit(v))
            return x

        link = F.concat(F.lit('<DT><A HREF="'), escaped("url"), F.lit('" ADD_DATE="'), F.coalesce(F.col("added").cast("string"), F.lit("")), F.lit('">'), escaped("title"), F.lit("</A>\n"))
        body = F.concat(F.lit("<DT><H3>"), escaped("folder"), F.lit("</H3>\n<DL><p>\n"), link, F.lit("</DL><p>\n"))
    else:
        stamp = ((F.col("added") + F.lit(11644473600)) * 1000000).cast("string")
        link = F.struct(F.lit("url").alias("type"), F.col("title").alias("name"), "url", stamp.alias("date_added"))
        body = F.concat(F.lit(",\n"), F.to_json(F.struct(F.lit("folder").alias("type"), F.col("folder").alias("name"), F.array(link).alias("children"))))
    each = marks.groupBy("file_path").agg(F.max("place").alias("last"))
    first, last = FRAMES[fmt]
    ends = each.select("file_path", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("place"), F.lit(first).alias("body")), F.struct((F.col("last") + 1).cast("long").alias("place"), F.lit(last).alias("body")))).alias("x"))
    return marks.select("file_path", F.col("place").cast("long").alias("place"), body.alias("body")).unionByName(ends.select("file_path", "x.*"))


class _Place(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.fmt = options["path"], options.get("kind", "firefox")

    def partitions(self):
        return [_Place(p) for p in self.path.split(",")]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from FORMATS[self.fmt](f.read())


class BookmarkSource(DataSource):
    """spark.read.format("bookmarks").option("kind", ...).load(path) for a
    browser's own files, which lie on the machine that reads them."""

    @classmethod
    def name(cls) -> str:
        return "bookmarks"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
