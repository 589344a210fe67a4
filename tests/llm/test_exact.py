"""The extendible-hash index and its groups against brute force."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lorebase.llm import exact


def brute(rows):
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[t or ""].append(i)
    keep = {t: max((i for i in x if i is not None), default=None) for t, x in ids.items()}
    return sorted(((i, keep[t or ""], len(ids[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


def corpus(seed=1, n=400):
    r = random.Random(seed)
    rows = [(i, "hot" if i % 3 == 0 else f"text {r.randrange(n // 2)} é\n") for i in range(n)]
    rows += [(None, None), (None, "hot"), (n, None), (n + 1, ""), (7, "hot"), (7, "hot"), (n + 2, "x" * 3_000_000), (n + 3, "x" * 3_000_000), (None, "alone"), (None, "both"), (None, "both")]
    return rows


@pytest.mark.parametrize("capacity", [4096, 8, 1])
def test_groups(spark, monkeypatch, capacity):
    monkeypatch.setattr(exact, "BYTES", 2000)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("clash"), "keep": F.lit(1), "n": F.lit(2)}).repartition(3)
    got = sorted((tuple(x) for x in exact.exact_groups(df, capacity=capacity).collect()), key=repr)
    assert got == brute(rows)


def whole(index):
    """Whether the buckets cover all hashes, none twice."""
    ends = sorted((r["lo"], r["lo"] + (1 << 64 - r["depth"])) for r in index.directory().collect())
    return ends[0][0] == -(1 << 63) and ends[-1][1] == 1 << 63 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_buckets_split_and_only_touched_ones_are_rewritten(spark):
    rows = corpus(n=300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact.ExactIndex.build(df, capacity=8)
    held = {(r["bucket"], r["depth"]): r["n"] for r in index.entries().groupBy("bucket", "depth").agg(F.count("*").alias("n")).collect()}
    told = {(r["lo"], r["depth"]): r["entries"] for r in index.directory().collect()}
    assert held == {k: n for k, n in told.items() if n} and max(held.values()) <= 8 and len({d for _, d in held}) > 1
    assert whole(index)
    more = [(1000, "new"), (1001, "hot"), (1002, "new"), (1003, "text 3 é\n")]
    index.add(spark.createDataFrame(more, "doc_id long, text string"))
    stayed = [r for r in index.directory().collect() if r["generation"] == 1]
    assert len(told) - 3 <= len(stayed) < len(told)
    assert whole(index)
    every = rows + more
    both = spark.createDataFrame(every, "doc_id long, text string")
    assert sorted((tuple(x) for x in index.lookup(both).collect()), key=repr) == brute(every)
    assert index.entries().count() == len({t or "" for _, t in every})


def test_equal_hashes_are_chained_and_told_apart_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact, "_keyed", lambda docs, i, t: docs.select(F.col(i).alias("id"), F.coalesce(F.col(t), F.lit("")).alias("text")).withColumn("h", F.length("text").cast("long")))
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "abc"), (5, None), (6, "cd"), (7, "ef")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    index = exact.ExactIndex.build(df)
    assert sorted((tuple(x) for x in index.lookup(df).collect()), key=repr) == brute(rows)
    assert sorted(r["link"] for r in index.entries().where("h = 2").collect()) == [0, 1, 2]


def test_text_ids_empty_tables_and_dropping(spark):
    rows = [("b", "x"), ("a", "x"), ("ä", "x"), ("c", "y"), (None, "z"), ("ä", "x")]
    df = spark.createDataFrame(rows, "name string, body string").withColumn("_id", F.lit("mine"))
    assert sorted((tuple(x) for x in exact.exact_groups(df, "name", "body").collect()), key=repr) == brute(rows)
    kept = exact.drop_exact_copies(df, "name", "body")
    assert kept.columns == df.columns
    assert sorted(map(repr, (tuple(x) for x in kept.collect()))) == sorted(map(repr, [("ä", "x", "mine"), ("c", "y", "mine"), (None, "z", "mine")]))
    assert exact.exact_groups(df.limit(0), "name", "body").count() == 0 == exact.drop_exact_copies(df.limit(0), "name", "body").count()
