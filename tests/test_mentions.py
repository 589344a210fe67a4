"""Which pages name or link which nodes, where many nodes have one name."""

import random

from pyspark.sql import functions as F

from lorebase.functions import text as tx
from lorebase.operators import graph


def test_nodes_of_one_name_are_searched_once(spark, monkeypatch):
    """Every pair is found, by brute force, from one row per page and name."""
    r, names = random.Random(3), ["Red Apples", "red-apple", "ox", "Blue Sky", "be at", "Straße", "Green Sea s", "apples", "x y"]
    nodes = []
    for i in range(90):
        text = " ".join(r.choice([*names, "redapple", "bluesky", "plain", "STRASSE", "beat"]) for _ in range(r.randrange(4)))
        nodes.append((i, r.choice(names), r.choice([None, None, "Blue Sky", "page " + str(i % 3)]), text + (f" [[{r.choice(names)}]]" if i % 3 else "")))
    df = spark.createDataFrame(nodes, "id long, display_name string, page_title string, body string")
    wrote, real = {}, graph.written

    def written(df, tag):
        wrote[tag] = real(df, tag)
        return wrote[tag]

    monkeypatch.setattr(graph, "written", written)
    got = {(x["id"], x["other"]): x["relation_type"] for x in graph.text_edges(df).collect()}
    a, b = df.select("id", "body"), df.select(F.col("id").alias("other"), F.explode(F.array_compact(F.array("display_name", "page_title"))).alias("name"))
    pairs = a.crossJoin(b).where("id <> other")
    named = {(x[0], x[1]) for x in pairs.where(tx.mentions(F.col("body"), tx.name_variants(F.col("name")))).select("id", "other").collect()}
    linked = {(x[0], x[1]) for x in pairs.where(F.array_contains(tx.wikilinks(F.col("body")), F.lower("name"))).select("id", "other").collect()}
    assert got == {p: "wiki_link" if p in linked else "page_reference" for p in named | linked} and len(got) > 500
    assert wrote["text-edges"].count() < len(got) / 2


def test_whole_texts_are_read_once_and_never_written(spark, monkeypatch):
    """Links and mentions come from one reading of the bodies; only short columns are written."""
    from lorebase.operators import mentions
    from lorebase.plans import queries

    plans, columns = {}, set()

    def written(df, tag, real=graph.written):
        columns.update(df.columns)
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, tag)

    for m in (graph, mentions, queries):
        monkeypatch.setattr(m, "written", written)
    assert queries.map_text_edges(spark, "/root/testdata/sf0.001").count()
    assert not columns & {"text", "body", "low", "compact"}
    assert plans["text-edges"].count("text:string") == 1


def test_members_of_large_classes_are_dealt_out(spark, monkeypatch):
    """A class's pages go to several parts and its members in blocks, each pair once."""
    monkeypatch.setattr(graph, "PAIRS", 40)
    monkeypatch.setattr(graph, "MEMBERS", 7)
    name = lambda i: "Red Apples" if i % 4 else f"Number {i}"
    nodes = [(i, name(i), None, "red apples" if i % 2 else f"of number {i // 3}, [[Red Apples]]") for i in range(80)]
    df = spark.createDataFrame(nodes, "id long, display_name string, page_title string, body string")
    out = graph.text_edges(df)
    got = [(x["id"], x["other"], x["relation_type"], x["page_title"]) for x in out.collect()]
    a, b = df.select("id", "body"), df.select(F.col("id").alias("other"), F.col("display_name").alias("name"))
    linked, named = F.array_contains(tx.wikilinks(F.col("body")), F.lower("name")), tx.mentions(F.col("body"), tx.name_variants(F.col("name")))
    want = a.crossJoin(b).where("id <> other").where(linked | named).select("id", "other", F.when(linked, "wiki_link").otherwise("page_reference").alias("t"))
    assert sorted(got) == sorted((x["id"], x["other"], x["t"], name(x["id"])) for x in want.collect()) and len(got) > 4000
    assert out.rdd.getNumPartitions() > 50
