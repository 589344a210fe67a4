"""SRC-06: pages fetched by a function of the caller's, host by host."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx

PAGE = "url string, status string, content_type string, html string, tries int"


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[bytes, str]], delay: float = 1.0, tries: int = 3, hosts: int = 64, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """url, status, content_type, html and tries of each distinct address of ``urls`` (url).

    ``fetch`` gives an address's bytes and content type or raises; it runs in the
    tasks. One task has all addresses of a host, so that at most one of them is asked
    for at a time, ``delay`` seconds after the last; a failure is tried again after a
    wait that doubles. ``status`` is ok, pdf (refused: PDFs are files, not pages), or
    the last error. Bytes that are not UTF-8 become replacement characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: str | None = None
        for b in batches:
            for url, host in zip(b.column("url").to_pylist(), b.column("host").to_pylist(), strict=True):
                row = {"url": url, "status": None, "content_type": None, "html": None, "tries": 0}
                for k in range(tries):
                    if host == last:
                        wait(delay * 2**k)
                    last, row["tries"] = host, k + 1
                    try:
                        content, kind = fetch(url)
                    except Exception as e:  # whatever the caller's function raises is this address's status
                        row["status"] = f"{type(e).__name__}: {e}"
                        continue
                    pdf = content[:5] == b"%PDF-" or "pdf" in kind.lower()
                    row |= {"status": "pdf" if pdf else "ok", "content_type": kind, "html": None if pdf else content.decode("utf-8", "replace")}
                    break
                yield pa.RecordBatch.from_pylist([row], pa.schema([("url", pa.string()), ("status", pa.string()), ("content_type", pa.string()), ("html", pa.string()), ("tries", pa.int32())]))

    one = urls.select("url").where("url IS NOT NULL").distinct().withColumn("host", tx.url_domain(F.col("url")))
    return one.repartition(hosts, "host").sortWithinPartitions("host", "url").mapInArrow(run, PAGE)
