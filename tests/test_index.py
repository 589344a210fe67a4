"""The stored search index against the scan."""

import glob
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lorebase.operators import index, search

QUERIES = ["a b", "b OR c d NOT zz", "ab* c", "c NOT a*", "", "hot"]


def texts(seed, n):
    r = random.Random(seed)
    words = ["a", "b", "c", "d", "ab", "abc", "rare", "zz"]
    return [(f"u{seed}-{i}", r.choice("pq"), r.choice(["Á title", ""]), " ".join(r.choices(words, [9, 6, 4, 3, 2, 2, 0.1, 0.05], k=r.randrange(0, 30))) + " hot") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "unit_id string, unit_type string, title string, body string").repartition(3)


def scan(rows, query, unit_type=None):
    """BM25 over the rows, read one by one."""
    every, without = search.match(query)
    words = {r[0]: re.findall(r"[^\W_]+", f"{r[2] or ''} {r[3] or ''}".lower().replace("á", "a")) for r in rows}
    n, avg = len(rows), sum(map(len, words.values())) / max(1, len(rows))
    tf = lambda w, t: sum(x.startswith(t[:-1]) if t.endswith("*") else x == t for x in w)
    out = []
    for u, kind, *_ in rows:
        w = words[u]
        if not every or unit_type and kind != unit_type or any(tf(w, t) for t in without) or not all(any(tf(w, t) for t in x) for x in every):
            continue
        score = 0.0
        for t in (t for x in every for t in x):
            d = sum(tf(v, t) > 0 for v in words.values())
            idf = math.log((n - d + 0.5) / (d + 0.5))
            score += (idf if idf > 0 else 1e-6) * tf(w, t) * 2.2 / (tf(w, t) + 1.2 * (0.25 + 0.75 * len(w) / avg))
        out.append((-round(score, 9), u))
    return sorted(out)


def same(spark, i, rows, queries=QUERIES, limits=(None, 3), kind=None):
    for q in queries:
        want = scan(rows, q, kind)
        for limit in limits:
            got = sorted((-round(r["score"], 9), r["unit_id"]) for r in i.bm25(q, [kind] if kind else None, limit).collect())
            assert got[:limit] == want[:limit] and (limit or got == want), (q, kind, limit)


def files(i):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{i.path.removeprefix('file://')}/*/blocks/**/*.parquet", recursive=True)}


@pytest.fixture
def small(monkeypatch):
    for name, value in (("WINDOW", 8), ("SHARD", 2), ("HOT", 40), ("BUCKET", 300), ("FIRST", 2)):
        monkeypatch.setattr(index, name, value)


def test_index_equals_the_scan_through_updates_and_merges(spark, tmp_path, small):
    rows = texts(1, 150)
    i = index.Index.build(frame(spark, rows), f"file://{tmp_path}/i")
    assert i.segments[0][1] > 3
    same(spark, i, rows)
    same(spark, i, rows, ["a b", "ab* c"], (2,), "p")
    assert [r["unit_id"] for r in search.bm25(frame(spark, rows), "a b").orderBy(F.desc("score"), "unit_id").limit(5).collect()] == [u for _, u in scan(rows, "a b")][:5]
    before = files(i)
    changed = [(rows[5][0], "q", "", "rare rare a"), ("new", "p", "a", "zz"), (rows[6][0], "p", None, None)]
    i.update(frame(spark, changed), spark.createDataFrame([(rows[7][0],), ("absent",)], "unit_id string"))
    after = files(i)
    assert before.items() <= after.items() and len(after) > len(before)  # no bucket was rewritten
    now = [r for k, r in enumerate(rows) if k not in (5, 6, 7)] + changed
    same(spark, i, now, ["a*", "rare b"], (3,))
    i.update(None, spark.createDataFrame([("new",)], "unit_id string"))
    now = [r for r in now if r[0] != "new"]
    again = index.Index.open(spark, i.path)
    assert again.segments == i.segments and len(i.segments) == 3
    same(spark, again, now, ["rare"], (2,))
    i.merge()
    assert len(i.segments) == 1 and not before.keys() & files(i).keys()
    same(spark, index.Index.open(spark, i.path), now, ["a b"], (2,), "q")


def test_windows_that_cannot_reach_the_best_are_not_read(spark, tmp_path, small, monkeypatch):
    rows = [(f"u{k:03}", "p", "", "x " * (30 if k % 50 == 0 else 1) + "y " * 40) for k in range(400)]
    i = index.Index.build(frame(spark, rows).orderBy("unit_id").coalesce(1), f"file://{tmp_path}/i")
    read, own = [], index.Index._postings

    def counted(self, blocks, terms):
        read.append(blocks.count())
        return own(self, blocks, terms)

    monkeypatch.setattr(index.Index, "_postings", counted)
    got = i.bm25("x", limit=2).orderBy(F.desc("score"), "unit_id").limit(2).collect()
    assert {r["unit_id"] for r in got} == {"u000", "u050"} and i._blocks(["x"]).count() >= 50
    assert read[0] == 2 and read[1] <= 8


def test_an_index_of_nothing(spark, tmp_path):
    i = index.Index.build(frame(spark, []), f"file://{tmp_path}/i")
    assert i.bm25("a").count() == 0 == i.bm25("a*", limit=2).count()
    i.update(frame(spark, texts(2, 3)))
    assert i.bm25("hot").count() == 3


def test_words_are_counted_few_units_at_a_time():
    import pyarrow as pa

    units = pa.RecordBatch.from_pydict({"ord": list(range(900)), "dl": [3] * 900, "words": [["a", "b", f"w{k}"] if k % 9 else ["a", "a", "a"] for k in range(900)]})
    got = list(index._postings_of(iter([units])))
    rows = sorted((x["ord"], x["term"], x["tf"]) for b in got for x in b.to_pylist())
    assert rows == sorted([(k, t, 1) for k in range(900) if k % 9 for t in ("a", "b", f"w{k}")] + [(k, "a", 3) for k in range(0, 900, 9)])
    assert max(len(set(b.column("ord").to_pylist())) for b in got) <= index.UNITS < 900
