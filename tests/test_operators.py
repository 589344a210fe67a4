import json
import plistlib
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.operators import ask, checks, graph, ingest, normalize, resolve, search
from lorebase.operators.index import Index
from lorebase.plans.engine import KnowledgeEngine
from lorebase.plans.projects import Projects
from lorebase.sources import bookmarks, files
from lorebase.streaming import jobs

ENTITY = "id string, entity_type string, canonical_name string, display_name string, aliases array<string>, description string, confidence double, created_from_source_id string"
RELATION = "id string, from_kind string, from_id string, relation_type string, to_kind string, to_id string, confidence double, evidence_source_id string"
PAGE = "id string, page_type string, title string, status string, body string, updated_at string"


def entity(i, name, kind="concept", aliases=(), conf=0.5, source=None, about=None):
    return (i, kind, name, name, list(aliases), about, conf, source)


def test_search(spark):
    u = spark.createDataFrame([(1, "ML", "machine learning is fun", "page_body"), (2, None, "deep learning of machine parts and more machine text", "page_body"), (3, "x", "café", "artifact_body")], "unit_id int, title string, body string, unit_type string")
    hits = [r["unit_id"] for r in search.search(u, "Machine learning?").collect()]
    assert sorted(hits) == [1, 2]
    assert search.search(u, "").count() == 0 and search.search(u, "unmatched").count() == 0
    assert [r["unit_id"] for r in search.search(u, "cafe").collect()] == [3]
    assert search.search(u, "cafe", unit_types=["page_body"]).count() == 0


def test_match_syntax_and_index(spark, tmp_path):
    u = spark.createDataFrame([(1, "", "red apples fall"), (2, "", "green apple pie"), (3, "", "red wine"), (4, "x", "écru red"), (5, "", "")], "unit_id int, title string, body string")
    i = Index.build(u, f"file://{tmp_path}/index")
    for q, want in {"red": {1, 3, 4}, "red OR pie": {1, 2, 3, 4}, "red NOT wine": {1, 4}, "appl*": {1, 2}, "red appl*": {1}, "ecru": {4}, "none": set(), "": set(), "NOT red": set(), "wine OR pie NOT green": {3}}.items():
        a = {r["unit_id"]: round(r["score"], 9) for r in search.bm25(u, q).collect()}
        assert set(a) == want and a == {r["unit_id"]: round(r["score"], 9) for r in i.bm25(q).collect()}
    assert [r["unit_id"] for r in search.search(u, "red", index=i).collect()] == [r["unit_id"] for r in search.search(u, "red").collect()]


def test_boosts_rerank_the_window(spark):
    u = spark.createDataFrame([(1, "", "word word word", "p1", "s1"), (2, "", "word other text here", "p2", "s2"), (3, "", "nothing", "p3", "s3"), (4, "", "no", "p4", None), (5, "", "none", None, None)], "unit_id int, title string, body string, page_id string, source_id string")
    pages = spark.createDataFrame([("p1", "index"), ("p2", "comparison")], "id string, page_type string")
    sources = spark.createDataFrame([("s1", "low"), ("s2", "high")], "id string, trust_level string")
    assert [r["unit_id"] for r in search.search(u, "word", pages=pages, sources=sources).collect()] == [2, 1]
    assert [r["unit_id"] for r in search.search(u, "word", limit=1, pages=pages, sources=sources).collect()] == [1]


def test_resolution(spark):
    e = spark.createDataFrame([entity("a", "GPT-4", conf=0.5), entity("b", "GPT 4", conf=0.9), entity("c", "Generative 4", aliases=["gpt4"], conf=0.9), entity("d", "GPT4", kind="tool"), entity("e", "Other")], ENTITY)
    found = resolve.clusters(e)
    assert {r["id"]: r["winner"] for r in found.collect()} == {"a": "c", "b": "c", "c": "c", "d": "d", "e": "e"}
    assert tuple(resolve.stats(found).first()) == (2, 1)
    merged = resolve.merged_entities(e, found)
    assert {r["id"]: r["aliases"] for r in merged.collect()}["c"] == ["GPT 4", "GPT-4", "gpt4"]
    assert tuple(resolve.stats(resolve.clusters(merged)).first()) == (0, 0)
    r = spark.createDataFrame([("1", "entity", "a", "uses", "entity", "e", 0.5, None), ("2", "entity", "b", "uses", "entity", "e", 0.5, None), ("3", "entity", "a", "uses", "entity", "b", 0.5, None)], RELATION)
    assert [(x["id"], x["from_id"], x["to_id"]) for x in resolve.merged_relations(r, found).collect()] == [("1", "c", "e")]
    assert resolve.clusters(e.limit(0)).count() == 0


def test_chain_of_components(spark):
    from lorebase.operators.shared import min_labels

    n = 40
    nodes = spark.range(n).select(F.col("id"))
    hubs = spark.createDataFrame([(i, f"h{i}") for i in range(n)] + [(i + 1, f"h{i}") for i in range(n - 1)], "id long, hub string")
    assert {r["root"] for r in min_labels(nodes, hubs).collect()} == {0}


def test_checks(spark):
    p = spark.createDataFrame([("p1", "concept", "A", "active", "", "2024-01-01"), ("p2", "index", "B", "active", "", "2024-01-01"), ("p3", "source_summary", "C", "active", "", "2024-02-10")], PAGE).withColumn("updated_at", F.to_timestamp("updated_at"))
    r = spark.createDataFrame([("1", "page", "p3", "derived_from", "source", "s", 1.0, None)], RELATION)
    assert [x["id"] for x in checks.orphan_pages(p, r).collect()] == ["p1"]
    assert [x["id"] for x in checks.stale_pages(p, F.lit("2024-02-15").cast("timestamp")).collect()] == ["p1", "p2"]
    c = spark.createDataFrame([("c1", "x", 0.4, "active"), ("c2", "x", 0.39, "active"), ("c3", "x", 0.1, "archived")], "id string, claim_text string, confidence double, status string")
    assert [x["id"] for x in checks.weak_claims(c).collect()] == ["c2"]
    e = spark.createDataFrame([entity("a", "transformer"), entity("b", "transformers"), entity("c", "transformers", kind="tool"), entity("d", "attention")], ENTITY)
    assert [(x["b_id"], x["a_id"]) for x in checks.duplicate_entities(e).collect()] == [("b", "a")]
    found = checks.run_checks({"pages": p, "relations": r}, F.lit("2024-02-15").cast("timestamp"), ["orphan_page", "stale_page"])
    none = spark.createDataFrame([], "finding_type string, subject_id string, status string")
    first = checks.upsert_findings(none, found)
    assert first.count() == 3 and checks.upsert_findings(first, found).count() == 0


@pytest.mark.parametrize("threshold", [0.85, 0.7, 0.5, 1.0])
def test_similarity_bounds_lose_nothing(spark, threshold):
    import difflib
    import itertools
    import random

    rnd = random.Random(3)
    names = {"".join(rnd.choice("abcé-") for _ in range(rnd.randrange(1, 14))) for _ in range(80)}
    for base in ["graph neural network", "retrieval augmented generation", "aaaaaaaaaa", "abababababab"]:
        for _ in range(15):
            n = list(base)
            for _ in range(rnd.randrange(1, 6)):
                k = rnd.randrange(len(n))
                n[k : k + 1] = rnd.choice(["", "x", "ab", n[k] * 2])
            names.add("".join(n))
    names = sorted(names - {""})
    df = spark.createDataFrame([(i, "t", n) for i, n in enumerate(names)] + [(-1, "t", None), (-2, None, "abc")], "id int, entity_type string, name string")
    got = {(r["a_id"], r["b_id"]) for r in checks.similar_names(df, threshold).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2) if difflib.SequenceMatcher(None, a, b).ratio() >= threshold}
    assert got == want and (len(want) > 20 or threshold == 1)


def test_similar_parts(spark):
    """All parts of a table against brute force, and the plan: no key of type and length alone."""
    import difflib
    import itertools

    parts = spark.read.parquet("/root/testdata/sf0.01/part.parquet").selectExpr("p_partkey AS id", "p_type AS entity_type", "p_name AS canonical_name", "p_name AS name")
    rows = sorted((r["entity_type"], r["name"], r["id"]) for r in parts.collect())
    distinct = {}
    for t, n, i in rows:
        distinct.setdefault((t, n), []).append(i)
    want = set()
    for (t, n), ids in distinct.items():
        want |= {(ids[0], i) for i in ids[1:]}
    for ((t, a), x), ((u, b), y) in itertools.combinations(distinct.items(), 2):
        if t == u and difflib.SequenceMatcher(None, a, b).ratio() >= 0.85:
            want |= {(x[0], i) for i in y}
    assert {(r["a_id"], r["b_id"]) for r in checks.similar_names(parts).collect()} == want


def test_map(spark):
    e = spark.createDataFrame([entity("n", "Neural networks", conf=0.9, source="A"), entity("t", "Transformers", conf=0.8, source="B"), entity("a", "Attention", conf=0.7)], ENTITY)
    r = spark.createDataFrame([("1", "page", "p", "about", "entity", "n", 1.0, None), ("2", "entity", "n", "uses", "entity", "t", 0.92, "A"), ("3", "source", "B", "mentions", "entity", "a", 0.5, None), ("4", "source", "A", "mentions", "entity", "a", 0.5, None)], RELATION)
    p = spark.createDataFrame([("p", "concept", "Neural networks", "active", "# N\n\nSee [[Transformers]].", "")], PAGE)
    s = spark.createDataFrame([("A", "Paper A"), ("B", "Paper B")], "id string, title string")
    m = graph.knowledge_map(e, r, p, s)
    edges = {(x["source"], x["target"]): x for x in m["edges"].collect()}
    assert edges["n", "t"]["kind"] == "explicit" and edges["n", "t"]["relation_type"] == "wiki_link" and edges["n", "t"]["evidence_count"] == 2
    assert edges["a", "t"]["kind"] == "inferred" and "shared source" in edges["a", "t"]["provenance_summary"]
    stats = m["stats"].first()
    assert stats["node_count"] == 3 and stats["group_count"] <= 2
    assert all(x["group"].startswith("group_") for x in m["nodes"].collect()) and "# Graph report" in graph.report(m, "x")
    empty = graph.knowledge_map(e.limit(0), r.limit(0), p.limit(0), s.limit(0))
    assert empty["nodes"].count() == 0 and empty["stats"].first()["edge_count"] == 0


def agglomerate_brute(label, tie, target):
    """Pair by pair, as the rule is worded."""
    groups = {g: [g] for g in label}
    while len(groups) > target:
        names = list(groups)
        close = {(g, h): round(sum(tie[i][j] for i in groups[g] for j in groups[h]) + graph.SINGLE * (1 in (len(groups[g]), len(groups[h]))), 9) for k, g in enumerate(names) for h in names[k + 1 :]}
        g, h = max(close, key=close.get)
        keep, gone = (g, h) if len(groups[g]) >= len(groups[h]) else (h, g)
        groups[keep] += groups.pop(gone)
    return [next(g for g, m in groups.items() if i in m) for i in label]


def test_propagation_and_merging():
    near = {1: [(2, 1.0)], 2: [(1, 1.0), (3, 0.1)], 3: [(2, 0.1), (4, 1.0)], 4: [(3, 1.0)]}
    label = graph.propagate([1, 2, 3, 4], near)
    assert label[1] == label[2] or label[3] == label[4]
    tie = np.add.outer(np.arange(5.0), np.arange(5.0))
    merged = graph.agglomerate(np.arange(5), tie, np.zeros((5, 5)), 2)
    assert merged.tolist() == agglomerate_brute(list(range(5)), tie, 2) and len(set(merged.tolist())) == 2
    r = np.random.default_rng(4)
    for n in (7, 12):
        tie = r.integers(0, 5, (n, n)) / 4
        tie = tie + tie.T
        assert graph.agglomerate(np.arange(n), tie, np.zeros((n, n)), 3).tolist() == agglomerate_brute(list(range(n)), tie, 3)
    assert [graph.group_target(n) for n in (0, 1, 2, 6, 7, 140)] == [1, 1, 2, 2, 3, 6]


def test_ingest(spark):
    b = spark.createDataFrame([(1, "a", "http://x.org/a", "x.org", ""), (2, "b", "http://x.org/a", "x.org", ""), (3, "c", "javascript:1", "", ""), (4, "d", "http://y.com", "y.com", "Papers"), (5, "e", "", "", "")], "ordinal int, title string, url string, domain string, folder_path string").withColumn("added_at", F.lit(None).cast("timestamp"))
    rows = ingest.source_rows(b, ["x.org"], ["papers"]).collect()
    assert {r["ordinal"]: r["ingest_state"] for r in rows} == {1: "approved", 4: "approved"}
    batch = spark.createDataFrame([(1, "u1", "c1"), (2, "u2", "c1"), (3, "u3", "c3"), (4, None, "c4"), (5, "u9", None)], "ordinal int, url string, checksum string")
    old = spark.createDataFrame([("u3", "z", None), ("q", "c4", "gone")], "url string, checksum string, deleted_at string")
    out = ingest.dedup_insert(batch, old)
    assert sorted(r["ordinal"] for r in out.collect()) == [1, 4, 5]
    assert tuple(ingest.insert_counts(batch, out).first()) == (5, 3, 2)


NETSCAPE = """<!DOCTYPE NETSCAPE-Bookmark-file-1><DL><p><DT><H3>Work</H3><DL><p><DT><A HREF="https://arxiv.org/1" ADD_DATE="1700000000">Paper</A><DT><H3>Deep</H3><DL><p><DT><A HREF="https://b.org">B</A></DL><p></DL><p><DT><A HREF="https://c.org"></A></DL>"""


def test_bookmarks(spark, tmp_path):
    (tmp_path / "n.html").write_text(NETSCAPE)
    got = sorted((r["title"], r["folder_path"], r["domain"]) for r in bookmarks.read_bookmarks(spark, str(tmp_path / "n.html"), "netscape").collect())
    assert got == [("B", "Work / Deep", "b.org"), ("Paper", "Work", "arxiv.org"), ("https://c.org", "", "c.org")]
    tree = {"roots": {"bookmark_bar": {"name": "Bar", "children": [{"type": "folder", "name": "F", "children": [{"type": "url", "name": "X", "url": "http://x", "date_added": "13300000000000000"}]}]}, "other": {"children": [{"type": "url", "name": "", "url": "http://y"}]}}}
    (tmp_path / "c.json").write_text(json.dumps(tree))
    rows = bookmarks.read_bookmarks(spark, str(tmp_path / "c.json"), "chromium").orderBy("url").collect()
    assert [(r["title"], r["folder_path"]) for r in rows] == [("X", "Bar / F"), ("http://y", "")] and rows[0]["added_at"].year == 2022
    (tmp_path / "s.plist").write_bytes(plistlib.dumps({"Children": [{"Title": "Favorites", "Children": [{"URLString": "http://z", "URIDictionary": {"title": "Z"}}]}, {"Title": "com.apple.ReadingList", "Children": [{"URLString": "http://r"}]}]}))
    assert sorted((r["title"], r["folder_path"]) for r in bookmarks.read_bookmarks(spark, str(tmp_path / "s.plist"), "safari").collect()) == [("Z", "Favorites"), ("http://r", "")]
    db = sqlite3.connect(tmp_path / "places.sqlite")
    db.executescript("CREATE TABLE moz_places(id, url); CREATE TABLE moz_bookmarks(id, type, fk, parent, title, dateAdded); INSERT INTO moz_places VALUES (1, 'http://f'); INSERT INTO moz_bookmarks VALUES (1, 2, NULL, 0, '', 0), (2, 2, NULL, 1, 'Menu', 0), (3, 1, 1, 2, 'F', 1700000000000000);")
    db.commit()
    db.close()
    row = bookmarks.read_bookmarks(spark, str(tmp_path / "places.sqlite"), "firefox").first()
    assert (row["title"], row["folder_path"], row["added_at"].year) == ("F", "Menu", 2023)
    spark.dataSource.register(bookmarks.BookmarkSource)
    assert spark.read.format("bookmarks").option("kind", "netscape").load(str(tmp_path / "n.html")).count() == 3
    (tmp_path / "bad.json").write_text("{")
    assert bookmarks.read_bookmarks(spark, str(tmp_path / "bad.json"), "chromium").count() == 0


def test_normalise(spark):
    raw = spark.createDataFrame([(" s ", [(" X ", "alien", ["a"] * 9, 7.0), ("  ", "tool", [], 0.5)], [("y" * 401, "fact", 0.5), ("ok", "odd", -1.0)], [("a", "rel", ""), ("a", "rel", "b")]), ("", [], [], [])], "summary string, entities array<struct<name:string,entity_type:string,aliases:array<string>,confidence:double>>, claims array<struct<text:string,claim_kind:string,confidence:double>>, r array<struct<from_name:string,relation_type:string,to_name:string>>")
    raw = raw.withColumn("relations", F.transform("r", lambda x: x.withField("confidence", F.lit(None).cast("double")))).withColumns({"topic_labels": F.array(F.lit("t" * 99)), "quality_flags": F.lit(None).cast("array<string>")})
    (n,) = normalize.clean(raw).collect()
    assert [(e["name"], e["entity_type"], len(e["aliases"]), e["confidence"]) for e in n["entities"]] == [("X", "concept", 5, 1.0)]
    assert [(c["text"], c["claim_kind"], c["confidence"]) for c in n["claims"]] == [("ok", "fact", 0.0)] and [r["confidence"] for r in n["relations"]] == [0.8]
    assert len(n["topic_labels"][0]) == 50 and n["quality_flags"] == []


NOTES = {
    "transformers.md": "# Transformer foundations\n\nTransformers rely on attention rather than recurrence to model sequences of text.\n\n## Key Ideas\n\n- Attention heads weigh tokens\n",
    "alignment.md": "# Chat model alignment with RLHF\n\nRLHF uses human preferences to tune chat models after supervised learning on demonstrations.\n",
    "sub/rag.md": "# Retrieval augmented generation\n\nRAG systems fetch documents and condition the generator on retrieved text from an index.\n",
    "raw/skipped.md": "# Skipped\n",
}


def test_build_and_ask(spark, tmp_path):
    for name, text in NOTES.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    assert files.scan_folder(spark, str(tmp_path / "in")).count() == 3
    k = KnowledgeEngine(spark, {}).import_and_build(str(tmp_path / "in"))
    k.save(str(tmp_path / "p"))
    k = KnowledgeEngine.open(spark, str(tmp_path / "p"))
    assert k.sources_list().count() == 3 and {r["page_type"] for r in k.pages_list().collect()} == {"source_summary", "concept"}
    assert k.search("RLHF").count() >= 1
    m = k.knowledge_map()
    assert m["nodes"].count() >= 1 and m["groups"].count() >= 1
    assert "RLHF" in k.query("What does RLHF use?") and "Sources" in k.query("What does RLHF use?")
    assert k.run_maintenance().count() >= 1 and "## Sources (3)" in k.index("x").first()["body"]
    # What the calls left: runs, artifacts, question pages with their edges, findings, jobs.
    assert k.tables["query_runs"].count() == 2 and k.tables["artifacts"].count() == 2
    question = k.tables["pages"].where("page_type = 'question'").collect()
    assert len(question) == 1 and k.tables["relations"].where(F.col("from_id") == question[0]["id"]).count() >= 2
    assert "Questions (1)" in k.index("x").first()["body"] and k.search("RLHF").count() >= 2
    n = k.tables["findings"].count()
    k.run_maintenance()
    assert k.tables["findings"].where("status = 'open'").count() >= n and k.log().where("entry LIKE '%query |%'").count() == 2
    k.export_vault(str(tmp_path / "vault"), "x")
    found = {str(p.relative_to(tmp_path / "vault")): p.read_text() for p in (tmp_path / "vault").rglob("*") if p.is_file()}
    pages_now = {f"wiki/{r['file_path']}": r["body"] for r in k.tables["pages"].collect()}
    assert {n: t for n, t in found.items() if n.startswith("wiki/")} == pages_now and any(n.startswith("wiki/questions/") for n in found)
    assert found["index.md"] == k.index("x").first()["body"] and found["log.md"].count("query |") == 2
    assert sum(n.startswith("normalized/") for n in found) == 3 and sum(n.startswith("outputs/answers/") for n in found) == 2
    k.ignore(k.tables["findings"].limit(1))
    assert k.tables["findings"].where("status = 'ignored'").count() == 1
    pages = spark.createDataFrame([(1, "https://a.example.org/x", "<title>One</title><p>Sparse retrieval of pages</p>"), (2, "https://b.net/y", "<p>other text</p>"), (3, "https://b.net/y", "<p>again</p>")], "page_id int, url string, html string")
    assert k.import_pages(pages, ["example.org"]) == {"parsed": 3, "inserted": 2, "skipped": 1}
    assert k.import_pages(pages, ["example.org"])["inserted"] == 0
    waiting = k.sources_list(status="needs_review").first()["id"]
    k.set_status([waiting], "approved")
    before = {r["id"]: r["updated_at"] for r in k.tables["pages"].collect()}
    k.build()
    after = {r["id"]: r["updated_at"] for r in k.tables["pages"].collect()}
    assert len(after) > len(before) and question[0]["id"] in after and any(after[i] == before[i] for i in before if i in after)
    k.delete_sources([waiting])
    assert k.sources_list().count() == 4 and k.search("RLHF").count() >= 1
    with pytest.raises(KeyError):
        k.get("pages", "nothing")


def test_a_build_normalises_what_changed_and_equals_a_full_one(spark):
    texts = {f"s{k}": f"# Paper {k}\n\nThis paper number {k} studies RLHF and BERT in some depth and says so at length. It has results." for k in range(6)}
    frame = lambda t: spark.createDataFrame([(i, f"Paper {i}", x, i + str(len(x)), "approved") for i, x in t.items()], "id string, title string, text string, checksum string, status string")
    k = KnowledgeEngine(spark, {})
    k.import_sources(frame(texts))
    k.build()
    assert k.dirty == 6
    k.build()
    assert k.dirty == 0
    texts |= {"s2": texts["s2"] + " It also covers GPT-4 at the very end of all.", "s9": "# New\n\nA new paper about LSTM networks that is long enough to be read by someone."}
    del texts["s4"]
    now = k.tables["sources"]
    k.tables["sources"] = now.where("id <> 's2'").unionByName(now.where("id = 's2'").withColumn("text", F.lit(texts["s2"])))
    k.delete_sources(["s4"])
    k.import_sources(frame({"s9": texts["s9"]}))
    k.build()
    assert k.dirty == 2
    full = KnowledgeEngine(spark, {})
    full.import_sources(frame(texts))
    full.build()
    for name, columns in (("documents", ["source_id", "title", "summary", "entities"]), ("entities", ["id", "canonical_name", "aliases"]), ("claims", ["id", "claim_text"]), ("relations", ["id", "from_id", "to_id"]), ("pages", ["id", "title", "body"])):
        a, b = (sorted(map(repr, x.tables[name].select(*columns).collect())) for x in (k, full))
        assert a == b, name


def test_no_evidence(spark):
    none = {"pages": spark.createDataFrame([], "page_id string, title string, score double"), "sources": spark.createDataFrame([], "source_id string, title string, summary string"), "claims": spark.createDataFrame([], "claim_text string, confidence double")}
    assert "not enough evidence" in ask.answer("Why?", none) and "study guide" in ask.answer("Why?", none, "study_guide")
    some = none | {"pages": spark.createDataFrame([("p", "T", 1.0, "---\na: b\n---\nthe\n body")], "page_id string, title string, score double, body string")}
    assert "This gap analysis is" in ask.answer("Why?", some, "gap_analysis") and "- [[T]] (`p`): the body" in ask.answer("Why?", some)
    assert ask.plan("What is the meaning, of life?").terms == ["What", "meaning", "life"] and ask.plan("x", "slides").task_type == "slides"


def test_projects_and_query_phases(spark, tmp_path):
    registry = Projects(spark, f"file://{tmp_path}/registry")
    assert registry.all().count() == 0
    a, b = registry.create("My Notes", str(tmp_path / "a")), registry.create("Other", str(tmp_path / "b"), "other")
    for name, slug in (("My notes!", None), ("x", "other"), ("!!", None)):
        with pytest.raises(ValueError):
            registry.create(name, "c", slug)
    assert [r["slug"] for r in registry.all().collect()] == ["other", "my-notes"] and registry.get(a)["root_path"] == str(tmp_path / "a")
    page = spark.createDataFrame([("p", "concept", "stars", "Stars", "Stars shine by fusion.", "active", "concepts/stars.md")], "id string, page_type string, slug string, title string, body string, status string, file_path string")
    page = page.withColumns({"origin_id": F.col("id"), "body_sha256": F.sha2("body", 256), "updated_at": F.current_timestamp()})
    entities = spark.createDataFrame([("e", "concept", "Stars", "Stars")], "id string, entity_type string, canonical_name string, display_name string")
    relations = spark.createDataFrame([("r", "page", "p", "derived_from", "source", "s", 1.0, None)], RELATION)
    sources = spark.createDataFrame([("s", "Paper", "On stars", None)], "id string, title string, summary string, deleted_at timestamp")
    claims = spark.createDataFrame([], "id string, claim_text string, confidence double, status string")
    registry.save(a, KnowledgeEngine(spark, {"pages": page, "entities": entities, "relations": relations, "sources": sources, "claims": claims}))
    told = []
    k = registry.open(a)
    assert [r["slug"] for r in registry.all().collect()] == ["my-notes", "other"]
    assert "[[Stars]]" in k.query("Stars shine?", "report", lambda run, phase: told.append(phase))
    assert told == ["planning", "retrieving", "synthesizing", "writing", "done"]

    def broken(prompt, found):
        raise RuntimeError("no model")

    k.synthesizer = broken
    with pytest.raises(RuntimeError):
        k.query("Stars shine?")
    assert sorted((r["status"], r["error"]) for r in k.tables["query_runs"].collect()) == [("failed", "no model"), ("succeeded", None)]
    assert k.tables["query_events"].count() == 5 + 4 and k.tables["artifacts"].count() == 1
    assert registry.delete(a)["slug"] == "my-notes" and [r["id"] for r in registry.all().collect()] == [b] and (tmp_path / "a" / "pages").exists()
    with pytest.raises(KeyError):
        registry.open(a)


def test_jobs_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, "queued", 1), (1, "running", 2), (2, "queued", 1), (1, "succeeded", 3)], "job_id int, status string, event_id int").withColumn("ts", F.timestamp_seconds("event_id"))
    e.write.parquet(str(tmp_path / "events"))
    got = {}
    q = jobs.maintain_states(jobs.read_events(spark, str(tmp_path / "events"), e.schema), str(tmp_path / "c"), lambda df, n: got.update({r["job_id"]: r["status"] for r in df.collect()}))
    q.awaitTermination()
    assert got == {1: "succeeded", 2: "queued"} == {r["job_id"]: r["status"] for r in jobs.latest_state(e).collect()}
    assert [r["seq_no"] for r in jobs.event_seq(e).where("job_id = 1").orderBy("event_id").collect()] == [1, 2, 3]
    q = jobs.ingest_files(spark, str(tmp_path / "events"), e.schema, str(tmp_path / "c2"), str(tmp_path / "out"), lambda df: df)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_stemmed_search(spark):
    u = spark.createDataFrame([(1, "", "the models are running"), (2, "", "nothing"), (3, "", "more of it")], "unit_id int, title string, body string")
    assert [r["unit_id"] for r in search.search(u, "model runs", stemmed=True).collect()] == [1] and search.search(u, "model runs").count() == 0


def test_file_back(spark):
    found = {"pages": spark.createDataFrame([("p",)], "page_id string"), "sources": spark.createDataFrame([("s",)], "source_id string")}
    r = spark.createDataFrame([("1", "page", "p", "derived_from", "source", "t", 1.0, None)], RELATION)
    page, edges = ask.file_back("What is it?  ", "text", found, r)
    assert page.first()["title"] == "What is it" and sorted((x["relation_type"], x["to_id"]) for x in edges.collect()) == [("derived_from", "s"), ("derived_from", "t"), ("references", "p")]
    none = {k: v.limit(0) for k, v in found.items()}
    assert ask.file_back("x", "y", none, r) is None
