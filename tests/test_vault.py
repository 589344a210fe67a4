"""Files of a project: all or none, checked by digest."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lorebase.sources import bookmarks, vault


def files(top):
    return {os.path.relpath(os.path.join(d, f), top): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(top) for f in fs}


def rows(spark, *given, schema="file_path string, body string"):
    return spark.createDataFrame(list(given), schema).repartition(4)


def test_files_are_written_and_those_that_are_right_stay(spark, tmp_path):
    top = str(tmp_path / "v")
    vault.write_files(rows(spark, ("wiki/a.md", "one é"), ("wiki/b/c.md", ""), ("d.md", None)), top)
    assert files(top) == {"wiki/a.md": "one é", "wiki/b/c.md": "", "d.md": ""}
    os.utime(f"{top}/wiki/a.md", (1, 1))
    vault.write_files(rows(spark, ("wiki/a.md", "one é"), ("d.md", "two")), f"file://{top}")
    assert files(top)["d.md"] == "two" and os.stat(f"{top}/wiki/a.md").st_mtime == 1
    got = {r["file_path"]: r["sha256"] for r in vault.digests(spark, top).collect()}
    assert got == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in files(top).items() if t}


def test_rows_of_a_path_are_one_file_in_order(spark, tmp_path):
    df = spark.range(500).select(F.when(F.col("id") % 2 == 0, "log.md").otherwise("other.md").alias("file_path"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("body"), "id").repartition(7)
    vault.write_files(df, str(tmp_path), F.desc("id"))
    assert files(tmp_path) == {"log.md": "".join(f"{k}\n" for k in range(498, -1, -2)), "other.md": "".join(f"{k}\n" for k in range(499, 0, -2))}


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    top = str(tmp_path / "v")
    vault.write_files(rows(spark, ("kept.md", "old")), top)
    bad = [(f"n{k}.md", "new") for k in range(20)] + [("kept.md", "new"), ("../out.md", "x")]
    with pytest.raises(Exception, match="outside the vault"):
        vault.write_files(rows(spark, *bad), top)
    assert files(top) == {"kept.md": "old"} and not os.path.exists(f"{top}/.staging") and not (tmp_path / "out.md").exists()


def test_a_file_that_someone_changed_is_a_conflict(spark, tmp_path):
    top, sha = str(tmp_path / "v"), lambda t: hashlib.sha256(t.encode()).hexdigest()
    schema = "file_path string, body string, expected_sha256 string"
    vault.write_files(rows(spark, ("a.md", "1", ""), ("b.md", "1", None), schema=schema), top)
    vault.write_files(rows(spark, ("a.md", "2", sha("1")), schema=schema), top)
    with pytest.raises(Exception, match="ConflictError"):
        vault.write_files(rows(spark, ("a.md", "3", sha("1")), ("b.md", "3", None), schema=schema), top)
    assert files(top) == {"a.md": "2", "b.md": "1"}


def test_bookmark_files_are_read_as_they_were_written(spark, tmp_path):
    marks = [("a.txt", 0, 'R&D <b> "x"', "http://x?a=1&b=2", "One & two", 1700000000), ("a.txt", 1, None, "http://y", None, None), ("b.txt", 0, "é", "http://z", "F", 1)]
    df = spark.createDataFrame(marks, "file_path string, place int, title string, url string, folder string, added long")
    for kind in ("netscape", "chromium"):
        top = str(tmp_path / kind)
        vault.write_files(bookmarks.file_rows(df, kind), top, "place")
        got = bookmarks.read_bookmarks(spark, top, kind).select("title", "url", "folder_path", F.unix_timestamp("added_at").alias("t"))
        assert sorted(map(tuple, got.collect())) == sorted((t or u, u, f or "", a) for _, _, t, u, f, a in marks)
        assert bookmarks.file_rows(df.limit(0), kind).count() == 0
