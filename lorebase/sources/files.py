"""Files and web pages as source rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from .article import articles

# What a folder scan takes and what it passes over.
SUFFIXES = ("pdf", "txt", "md", "markdown")
SKIPPED_FOLDERS = ("normalized", "wiki", "outputs", "maintenance", "cache", "raw")
SKIPPED_FILES = ("config.yaml", "index.md", "log.md", "graph.json", "GRAPH_REPORT.md")


def scan_folder(spark: SparkSession, path: str, skip_files: tuple[str, ...] = SKIPPED_FILES) -> DataFrame:
    """SRC-12, SNK-02: (path, relative, modified, size, sha256, content) of documents
    at any depth; folders are judged by their names below ``path`` only."""
    pattern = "*.{" + ",".join(SUFFIXES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    below = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    top = "/" + path.split("://", 1)[-1].removeprefix("file:").strip("/")
    relative = F.substring(below, len(top) + 2, 1 << 30)
    parts = F.split(relative, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    # An engine keeps its own folder hidden, by a leading dot.
    bad = F.exists(folders, lambda f: F.startswith(f, F.lit("."))) | F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS])) | F.get(parts, F.size(parts) - 1).isin(*skip_files)
    return files.where(~F.coalesce(bad, F.lit(False))).select("path", relative.alias("relative"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def text_documents(files: DataFrame) -> DataFrame:
    """SRC-11: text and Markdown files as sources of high trust."""
    t = files.where(F.regexp_like("relative", F.lit(r"\.(txt|md|markdown)$"))).withColumn("text", F.col("content").cast("string"))
    title = F.regexp_replace(F.regexp_extract("relative", "([^/]+)$", 1), r"\.[^.]+$", "")
    return t.select(F.sha2("relative", 256).alias("id"), title.alias("title"), "text", F.col("sha256").alias("checksum"), F.lit("high").alias("trust_level"), F.lit("approved").alias("status"))


def pdf_documents(files: DataFrame) -> DataFrame:
    """SRC-09: PDF text by page, where the optional library is there; else a stub
    that says so."""

    def run(batches):
        import io

        import pandas as pd

        for pdf in batches:
            out = []
            for relative, content in zip(pdf["relative"], pdf["content"], strict=True):
                try:
                    import pypdf

                    r = pypdf.PdfReader(io.BytesIO(bytes(content)))
                    pages = [(k, (p.extract_text() or "").strip()) for k, p in enumerate(r.pages, 1)]
                    info = r.metadata or {}
                    out.append((relative, str(info.get("/Title") or ""), str(info.get("/Author") or ""), str(info.get("/CreationDate") or ""), "\n\n".join(f"## Page {k}\n\n{t}" for k, t in pages if t), len(pages)))
                except ImportError:
                    out.append((relative, "", "", "", "[PDF text needs the pypdf library]", 0))
            yield pd.DataFrame(out, columns=["relative", "title", "author", "date", "text", "page_count"])

    found = files.where("relative LIKE '%.pdf'").select("relative", "content").mapInPandas(run, "relative string, title string, author string, date string, text string, page_count int")
    return found.withColumn("date", tx.pdf_date(F.col("date")))


def pdf_sources(files: DataFrame) -> DataFrame:
    """ING-02: PDFs as source rows like those of ``text_documents``; one whose text
    cannot be read keeps its stub and waits for review."""
    t = pdf_documents(files).join(files.select("relative", F.col("sha256").alias("checksum")), "relative")
    name = F.regexp_extract("relative", "([^/]+)$", 1)
    ok = F.col("page_count") > 0
    return t.select(F.sha2("relative", 256).alias("id"), F.coalesce(F.nullif("title", F.lit("")), name).alias("title"), "text", "checksum", F.lit("high").alias("trust_level"), F.when(ok, "approved").otherwise("needs_review").alias("status"))


def article_sources(pages: DataFrame, domains: list[str]) -> DataFrame:
    """ING-03: fetched pages as source rows, approved where the domain is trusted."""
    a = articles(pages)
    good = tx.trusted(F.col("domain"), F.lit(""), domains, [])
    return a.select(F.sha2("url", 256).alias("id"), F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "text", F.sha2("text", 256).alias("checksum"), "url", F.when(good, "high").otherwise("unknown").alias("trust_level"), F.when(good, "approved").otherwise("needs_review").alias("status"))


def source_text(sources: DataFrame, texts: DataFrame, raws: DataFrame, limit: int | None = 12_000) -> DataFrame:
    """SRC-13: each source's stored text, else its sibling's, else its raw file's, else ''."""
    j = sources.join(texts.select(F.col("id").alias("_t"), F.col("text").alias("_text")), F.col("id") == F.col("_t"), "left").join(raws.select(F.col("path").alias("raw_path"), F.col("text").alias("_raw")), "raw_path", "left")
    text = F.coalesce("text", "_text", "_raw", F.lit(""))
    return j.withColumn("text", F.substring(text, 1, limit) if limit else text).drop("_t", "_text", "_raw")
