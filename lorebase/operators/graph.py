"""The knowledge map: scored nodes, explicit and inferred edges, groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from .mentions import mentioned
from .shared import written

# Limits and weights of the map.
MOST_NODES, INFERRED_PER_NODE, NEIGHBOURS, ROUNDS = 140, 4, 8, 8
WIKI_LINK, PAGE_REFERENCE = 0.86, 0.72
#: Rows that a task makes of pages' classes, and members of a class that are sent together, about.
PAIRS, MEMBERS = 8_000_000, 1000
GROUP_EXPLICIT, GROUP_INFERRED, GROUP_SHARED, GROUP_TERMS, SAME_TYPE, SINGLE = 1.35, 0.32, 0.07, 0.18, 0.24, 0.06

EDGE = "source, target, relation_type, kind, weight, shared_sources, evidence_count, lexical_overlap, evidence_sources, page_titles".split(", ")


def with_pages(entities: DataFrame, relations: DataFrame, pages: DataFrame) -> DataFrame:
    """MAP-01, JOI-06: entities with page_id, page_title and body of the active
    concept page about them, the first by id."""
    about = relations.where("from_kind = 'page' AND relation_type = 'about' AND to_kind = 'entity'").select(F.col("from_id").alias("page_id"), F.col("to_id").alias("id"))
    live = pages.where("status = 'active' AND page_type = 'concept'").select(F.col("id").alias("page_id"), F.struct("title", "body").alias("p"))
    one = about.join(live, "page_id").groupBy("id").agg(F.min("page_id").alias("page_id"), F.min_by("p", "page_id").alias("p"))
    return entities.join(one, "id", "left").withColumns({"page_title": F.col("p.title"), "body": F.col("p.body")}).drop("p")


def support(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """MAP-02, SET-01: distinct (entity_id, source_id) of the four ways in which a
    source supports an entity; an edge's evidence counts for its target only."""
    r = relations
    ways = [
        entities.select(F.col("id").alias("entity_id"), F.col("created_from_source_id").alias("source_id")),
        r.where("to_kind = 'entity'").select(F.col("to_id").alias("entity_id"), F.col("evidence_source_id").alias("source_id")),
        r.where("from_kind = 'source' AND to_kind = 'entity'").select(F.col("to_id").alias("entity_id"), F.col("from_id").alias("source_id")),
        r.where("from_kind = 'entity' AND to_kind = 'source'").select(F.col("from_id").alias("entity_id"), F.col("to_id").alias("source_id")),
    ]
    out = ways[0]
    for w in ways[1:]:
        out = out.unionByName(w)
    return out.where("source_id IS NOT NULL").distinct()


def select_nodes(entities: DataFrame, supports: DataFrame, limit: int = MOST_NODES) -> DataFrame:
    """MAP-03, SRT-03: the entities of the highest score, with source_count and
    rank (from 1). ``entities`` is as given by ``with_pages``."""
    n = supports.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("source_count"))
    j = entities.join(n, "id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))
    bare = (F.col("source_count") == 0) & F.col("page_id").isNull() & (F.coalesce("description", F.lit("")) == "")
    score = F.coalesce("confidence", F.lit(0.0)) + 0.35 * F.col("source_count") + F.when(F.col("page_id").isNotNull(), 0.75).otherwise(0.0) - F.when(bare, 0.5).otherwise(0.0)
    # Scores that differ by rounding alone are equal.
    best = [F.desc(F.round("score", 9)), F.lower("display_name"), F.desc("confidence"), F.asc("display_name"), F.asc("id")]
    top = j.withColumn("score", score).orderBy(*best).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*best)))  # MOST_NODES rows


def node_terms(nodes: DataFrame) -> DataFrame:
    """MAP-04: nodes with summary and terms."""
    fallback = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.concat("display_name", F.lit(" is a "), "entity_type", F.lit(".")))
    summary = F.coalesce(F.nullif(tx.markdown_summary(F.coalesce("body", F.lit("")), 220), F.lit("")), fallback)
    n = nodes.withColumn("summary", summary)
    return n.withColumn("terms", tx.topical_terms(F.concat_ws(" ", "display_name", "description", "summary", "body")))


def _pair(a: str, b: str) -> list[Column]:
    """SCA-27."""
    return [F.least(a, b).alias("source"), F.greatest(a, b).alias("target")]


def explicit_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """MAP-05, AGG-04: one edge per unordered pair of nodes with relations: the
    largest weight, how many, their sources, and the first type other than
    related_to (by relation id)."""
    ids = nodes.select(F.col("id").alias("n"))
    r = relations.where("from_kind = 'entity' AND to_kind = 'entity' AND from_id <> to_id")
    r = r.join(ids, r.from_id == F.col("n"), "left_semi").join(ids, r.to_id == F.col("n"), "left_semi")
    weight = F.greatest(F.lit(0.62), 0.55 + F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.6)) * 0.55)
    g = r.groupBy(*_pair("from_id", "to_id")).agg(
        F.min_by("relation_type", F.struct(F.col("relation_type") == "related_to", F.col("id"))).alias("relation_type"),
        F.max(weight).alias("weight"), F.count("*").alias("evidence_count"), F.array_sort(F.collect_set("evidence_source_id")).alias("evidence_sources"),
    )
    return g.withColumn("kind", F.lit("explicit"))


def text_edges(nodes: DataFrame, titles: bool = True) -> DataFrame:
    """MAP-06, JOI-15/16, AGG-16: (id, other, relation_type, weight and, with ``titles``,
    page_title): which node's page links or names which other node, the stronger way of each.

    All names are searched at once in each page, with its links, so that pages are read
    and shuffled once. Nodes of the same names are one class, whose least id stands for it
    until the last join, so that nothing but the result grows with pages times nodes of a name.
    """
    own = nodes.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("display_name", "page_title"))).alias("names"))
    least = own.groupBy(F.col("names").alias("k")).agg(F.min("id").alias("cls"))
    # Written, like the pages' classes below, so that the join on a frequent class can be split.
    members = written(own.join(least, F.col("names") == F.col("k")).select(F.col("id").alias("other"), "cls", "names"), "members")
    page = nodes.where("body IS NOT NULL AND body <> ''")
    names = members.where(F.col("other") == F.col("cls")).select("cls", F.explode("names").alias("n"))
    names = names.select(F.col("cls").alias("other"), F.explode(F.array_compact(F.array("n.display_name", "n.page_title"))).alias("name"))
    found = mentioned(page.select("id", "body"), names, itself=True, links=True)
    best = found.groupBy("id", F.col("other").alias("cls")).agg(F.max("linked").alias("linked"))
    if titles:
        best = best.join(page.select("id", F.coalesce("page_title", "display_name").alias("page_title")).distinct(), "id")
    linked, title = F.col("linked"), ["page_title"] * titles
    return _of_members(written(best, "text-edges"), members.select("cls", "other")).where("id <> other").select(
        "id", "other", F.when(linked, "wiki_link").otherwise("page_reference").alias("relation_type"), F.when(linked, WIKI_LINK).otherwise(PAGE_REFERENCE).alias("weight"), *title
    )


def _of_members(found: DataFrame, members: DataFrame) -> DataFrame:
    """``found`` (id, cls and more) once per member (cls, other) of its class, in tasks of
    some PAIRS rows: what meets is small against what comes of it, so neither bytes nor
    classes tell the work. A class's pages are dealt out, its members go to each part in blocks."""
    of = members.groupBy("cls").agg(F.count("*").alias("m")).join(found.groupBy("cls").agg(F.count("*").alias("n")), "cls")
    of = written(of.select("cls", (F.col("m") * F.col("n")).alias("pairs"), F.ceil(F.col("m") * F.col("n") / PAIRS).alias("parts"), F.ceil(F.col("m") / MEMBERS).alias("blocks")), "classes")
    tasks = max(1, math.ceil((of.agg(F.sum("pairs")).first()[0] or 0) / PAIRS))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    left = found.join(of.select("cls", "parts"), "cls").withColumn("part", part("id", "parts")).drop("parts").repartition(tasks, "cls", "part")
    blocks = members.join(of.select("cls", "parts", "blocks"), "cls").groupBy("cls", "parts", part("other", "blocks")).agg(F.collect_list("other").alias("others"))
    right = blocks.select("cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "others").repartition(tasks, "cls", "part")
    return left.join(right, ["cls", "part"]).withColumn("other", F.explode("others")).drop("part", "others")


def merge_text_edges(explicit: DataFrame, found: DataFrame) -> DataFrame:
    """Explicit edges with what the pages add: the larger weight, one more piece of
    evidence per page, and a wiki link's type before any other; of a pair with no
    relation a weak type yields to the pages'."""
    t = found.groupBy(*_pair("id", "other")).agg(
        F.max("weight").alias("w"), F.count("*").alias("n"), F.max_by("relation_type", "weight").alias("t"), F.array_sort(F.collect_set("page_title")).alias("page_titles")
    )
    j = explicit.join(t, ["source", "target"], "full")
    weak = F.col("relation_type").isNull() | F.col("relation_type").isin("related_to", "shared_source") | (F.col("t") == "wiki_link")
    none = F.array().cast("array<string>")
    return j.select(
        "source", "target", F.when(F.col("t").isNotNull() & weak, F.col("t")).otherwise(F.col("relation_type")).alias("relation_type"), F.lit("explicit").alias("kind"),
        F.greatest("weight", "w").alias("weight"), (F.coalesce("evidence_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("evidence_count"),
        F.coalesce("evidence_sources", F.array().cast(dict(explicit.dtypes)["evidence_sources"])).alias("evidence_sources"), F.coalesce("page_titles", none).alias("page_titles"),
    )


def shared_pairs(nodes: DataFrame, supports: DataFrame) -> DataFrame:
    """JOI-13: (a, b, shared, lexical, sources) for nodes a before b (by rank) that
    share a source, unless just one and no term of the first eight."""
    s = supports.join(F.broadcast(nodes.select(F.col("id").alias("entity_id"), "rank")), "entity_id")  # MOST_NODES rows
    a, b = s.select(F.col("entity_id").alias("a"), F.col("rank").alias("ra"), "source_id"), s.select(F.col("entity_id").alias("b"), F.col("rank").alias("rb"), "source_id")
    shared = a.join(b, "source_id").where("ra < rb").groupBy("a", "b").agg(F.count("*").alias("shared"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    t = nodes.select("id", F.slice("terms", 1, 8).alias("t"))
    j = shared.join(t.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return j.withColumn("lexical", F.size(F.array_intersect("ta", "tb"))).drop("ta", "tb").where("shared > 1 OR lexical > 0")


def map_edges(explicit: DataFrame, pairs: DataFrame) -> DataFrame:
    """MAP-07, WIN-01: explicit edges with what their ends share, and the strongest
    INFERRED_PER_NODE pairs of each node that have no explicit edge."""
    keyed = pairs.select(*_pair("a", "b"), "a", "b", "shared", "lexical", "sources")
    strong = explicit.join(keyed.drop("a", "b"), ["source", "target"], "left").select(
        "source", "target", "relation_type", "kind", "weight", F.coalesce("shared", F.lit(0)).alias("shared_sources"), "evidence_count", F.coalesce("lexical", F.lit(0)).alias("lexical_overlap"),
        F.array_sort(F.array_union("evidence_sources", F.coalesce("sources", "evidence_sources"))).alias("evidence_sources"), "page_titles",
    )
    rest = keyed.join(explicit.select("source", "target"), ["source", "target"], "left_anti")
    rest = rest.withColumn("weight", F.round(0.14 + F.least(F.lit(0.34), 0.08 * F.col("shared") + 0.05 * F.col("lexical")), 4))
    rest = rest.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))).where(F.col("_r") <= INFERRED_PER_NODE)
    weak = rest.select(
        "source", "target", F.lit("shared_source").alias("relation_type"), F.lit("inferred").alias("kind"), "weight", F.col("shared").alias("shared_sources"),
        F.col("shared").alias("evidence_count"), F.col("lexical").alias("lexical_overlap"), F.col("sources").alias("evidence_sources"), F.array().cast("array<string>").alias("page_titles"),
    )
    return strong.unionByName(weak)


def ends(edges: DataFrame) -> DataFrame:
    """Each edge from both sides: id, other and the edge's columns."""
    more = [c for c in edges.columns if c not in ("source", "target", "id")]
    return edges.select(F.col("source").alias("id"), F.col("target").alias("other"), *more).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), *more))


def degrees(edges: DataFrame) -> DataFrame:
    """MAP-08, AGG-05: (id, degree, weighted_degree)."""
    return ends(edges).groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def neighbours(edges: DataFrame, nodes: DataFrame, limit: int = NEIGHBOURS) -> DataFrame:
    """WIN-02: each node's strongest neighbours, by weight and name."""
    named = ends(edges).join(nodes.select(F.col("id").alias("other"), F.col("display_name").alias("label")), "other")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), F.lower("label"), "other"))
    return named.withColumn("place", place).where(F.col("place") <= limit)


def group_target(n: int) -> int:
    """MAP-10."""
    return max(1, min(2, n)) if n <= 6 else max(3, min(6, math.ceil(math.sqrt(n) / 1.4)))


def propagate(ids: list, near: dict) -> dict:
    """MAP-09: up to ROUNDS passes over the nodes, the most connected first, each
    taking the label with the largest (weight, label) among its neighbours as
    they are labelled at that moment."""
    label = {i: i for i in ids}
    order = sorted(ids, key=lambda i: (-sum(w for _, w in near.get(i, ())), i))
    for _ in range(ROUNDS):
        before = dict(label)
        for i in order:
            votes: dict = {}
            for other, w in near.get(i, ()):
                votes[label[other]] = votes.get(label[other], 0.0) + w
            if votes:
                label[i] = max(votes, key=lambda k: (votes[k], k))
        if label == before:
            break
    return label


def agglomerate(labels: np.ndarray, tie: np.ndarray, same: np.ndarray, target: int) -> np.ndarray:
    """MAP-12: joins the two closest groups until ``target`` remain; on ties the
    first pair; the larger group (or the first) keeps its label.

    ``tie`` and ``same`` are matrices over nodes: their affinity, and whether
    their types agree. Summed over members they give the groups' affinities, so
    a step is one product of small matrices.
    """
    names = list(dict.fromkeys(labels.tolist()))
    member = np.array([[x == g for x in labels.tolist()] for g in names], float)
    while len(names) > target:
        size = member.sum(1)
        close = member @ tie @ member.T + SAME_TYPE * (member @ same @ member.T > 0) + SINGLE * ((size[:, None] == 1) | (size == 1))
        # Sums of other orders are equal if they differ by rounding alone.
        close = np.where(np.triu(np.ones_like(close), 1) > 0, close.round(9), -np.inf)
        a, b = divmod(int(close.argmax()), len(names))
        keep, gone = (a, b) if size[a] >= size[b] else (b, a)
        member[keep] += member[gone]
        member = np.delete(member, gone, 0)
        del names[gone]
    return np.array(names, dtype=object)[member.argmax(0)]


def node_groups(nodes: DataFrame, edges: DataFrame, supports: DataFrame) -> DataFrame:
    """MAP-09..12, WIN-05: (id, label, group). The steps depend on their order, so
    one task takes the whole map (MOST_NODES nodes by construction)."""
    of = supports.join(F.broadcast(nodes.select(F.col("id").alias("entity_id"))), "entity_id").groupBy(F.col("entity_id").alias("id")).agg(F.collect_set("source_id").alias("sources"))
    rows = nodes.join(of, "id", "left").select(F.lit(0).alias("k"), F.struct("rank", "id", "entity_type", F.slice("terms", 1, 8).alias("terms"), "sources").alias("node"))
    n = rows.groupBy("k").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    e = edges.select(F.lit(0).alias("k"), F.struct("source", "target", F.col("weight").cast("double").alias("weight"), "kind").alias("edge")).groupBy("k").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    kind = dict(nodes.dtypes)["id"]

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids = [x["id"] for x in r.nodes]
                at = {i: k for k, i in enumerate(ids)}
                sets = [[set(v if v is not None else ()) for v in (x["terms"], x["sources"])] for x in r.nodes]
                near, tie = {}, np.array([[GROUP_SHARED * len(a[1] & b[1]) + GROUP_TERMS * len(a[0] & b[0]) for b in sets] for a in sets])
                for x in r.edges if r.edges is not None else ():
                    near.setdefault(x["source"], []).append((x["target"], x["weight"]))
                    near.setdefault(x["target"], []).append((x["source"], x["weight"]))
                    i, j = at[x["source"]], at[x["target"]]
                    tie[[i, j], [j, i]] += GROUP_EXPLICIT * (1 + x["weight"]) if x["kind"] == "explicit" else GROUP_INFERRED * x["weight"]
                same = np.array([[float(a["entity_type"] == b["entity_type"]) for b in r.nodes] for a in r.nodes])
                first = propagate(ids, near)
                label = dict(zip(ids, agglomerate(np.array([first[i] for i in ids], dtype=object), tie, same, group_target(len(ids))).tolist(), strict=True))
                size = {g: sum(x == g for x in label.values()) for g in set(label.values())}
                number = {g: f"group_{k}" for k, g in enumerate(sorted(size, key=lambda g: (-size[g], g)), 1)}
                yield pd.DataFrame({"id": ids, "label": [label[i] for i in ids], "group": [number[label[i]] for i in ids]})

    return n.join(e, "k", "left").select("nodes", "edges").mapInPandas(run, f"id {kind}, label {kind}, `group` string")


def group_themes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """AGG-03/07, WIN-04: (group, themes): the three terms of the best count times
    1.35 / df among the first ten of each member."""
    df = nodes.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    local = nodes.join(groups.select("id", "group"), "id").select("group", F.explode(F.slice("terms", 1, 10)).alias("term")).groupBy("group", "term").agg(F.count("*").alias("n"))
    scored = local.join(df, "term").withColumn("score", F.col("n") * 1.35 / F.col("df"))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "term"))).where("r <= 3")
    return top.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: tx.display_token(x["term"])).alias("themes"))


def _s(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def group_stats(nodes: DataFrame, edges: DataFrame, groups: DataFrame, supports: DataFrame) -> DataFrame:
    """MAP-13, AGG-06, WIN-03, SCA-39: one row per group: size, label, themes,
    representatives, counts of inner edges and sources, and a rationale."""
    g = groups.select("id", "group")
    inner = edges.join(g.select(F.col("id").alias("source"), F.col("group").alias("g")), "source").join(g.select(F.col("id").alias("target"), F.col("group").alias("h")), "target").where("g = h")
    e = inner.groupBy(F.col("g").alias("group")).agg(F.count_if(F.col("kind") == "explicit").alias("explicit_edge_count"), F.count_if(F.col("kind") == "inferred").alias("inferred_edge_count"))
    s = supports.join(g.select(F.col("id").alias("entity_id"), "group"), "entity_id").groupBy("group").agg(F.count_distinct("source_id").alias("source_count"))
    weight = ends(inner.select("source", "target", "weight")).groupBy("id").agg(F.sum("weight").alias("w"))
    m = nodes.join(g, "id").join(weight, "id", "left").withColumn("r_score", F.coalesce("w", F.lit(0.0)) + F.coalesce("confidence", F.lit(0.0)) + 0.12 * F.col("source_count"))
    m = m.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(F.desc(F.round("r_score", 9)), F.lower("display_name"), "id")))  # scores that differ by rounding alone are equal
    r = m.groupBy("group").agg(F.count("*").alias("size"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "display_name")))), lambda x: x["display_name"]).alias("representative_nodes"))
    out = r.join(group_themes(nodes, groups), "group", "left").join(e, "group", "left").join(s, "group", "left")
    out = out.fillna(0, ["explicit_edge_count", "inferred_edge_count", "source_count"]).withColumn("themes", F.coalesce("themes", F.array().cast("array<string>")))
    n, i, c = F.col("explicit_edge_count"), F.col("inferred_edge_count"), F.col("source_count")
    focus = F.when(F.size("themes") > 0, F.array_join("themes", ", ")).otherwise(F.array_join(F.slice("representative_nodes", 1, 2), ", "))
    tail = F.concat_ws(
        ", ",
        F.when(n > 0, F.concat(n, F.lit(" explicit link"), _s(n))), F.when(i > 0, F.concat(i, F.lit(" inferred overlap link"), _s(i))),
        F.when(c > 0, F.concat(F.lit("support spread across "), c, F.lit(" source"), _s(c))),
    )
    rationale = F.concat(F.lit("Grouped around "), focus, F.when(tail == "", F.lit(".")).otherwise(F.concat(F.lit(", with "), tail, F.lit("."))))
    label = F.array_join(F.slice("representative_nodes", 1, 2), " + ")
    return out.select("group", label.alias("label"), "size", "themes", "representative_nodes", "explicit_edge_count", "inferred_edge_count", "source_count", rationale.alias("rationale"))


def serialised(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """MAP-15, SCA-38, WIN-08: edges with source_titles, provenance_kind and the
    sentence that explains them."""
    titles = edges.select("source", "target", F.explode("evidence_sources").alias("sid")).join(sources.select(F.col("id").alias("sid"), F.coalesce(F.col("title"), F.col("id").cast("string")).alias("title")), "sid", "left")
    titles = titles.groupBy("source", "target").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("sid", F.coalesce("title", F.col("sid").cast("string")).alias("title")))), 1, 3), lambda x: x["title"]).alias("source_titles"))
    j = edges.join(titles, ["source", "target"], "left").withColumn("source_titles", F.coalesce("source_titles", F.array().cast("array<string>")))
    n, shared, words, explicit = F.col("evidence_count"), F.col("shared_sources"), F.col("lexical_overlap"), F.col("kind") == "explicit"
    kind = F.when(explicit & (shared > 0), "hybrid").when(explicit, "explicit_relation").otherwise("shared_support")
    said = F.concat(F.lit("Explicit relation '"), F.replace("relation_type", F.lit("_"), F.lit(" ")), F.lit("'"), F.when(n > 1, F.concat(F.lit(" seen "), n, F.lit(" times"))).otherwise(""))
    # The wording of the sentences.
    base = F.when(F.col("relation_type") == "wiki_link", "Explicit wiki link").when(F.col("relation_type") == "page_reference", "Explicit concept-page reference").otherwise(said)
    pages = F.when(F.size("page_titles") > 0, F.concat(F.lit(" from "), F.array_join(F.slice("page_titles", 1, 2), ", "))).otherwise("")
    more = F.when(shared > 0, F.concat(F.lit(", reinforced by "), shared, F.lit(" shared source"), _s(shared))).otherwise("")
    guess = F.concat(F.lit("Inferred from "), shared, F.lit(" shared source"), _s(shared), F.when(words > 0, F.concat(F.lit(" and "), words, F.lit(" overlapping topical term"), _s(words))).otherwise(""))
    cite = F.when(F.size("source_titles") > 0, F.concat(F.lit(" ("), F.array_join("source_titles", ", "), F.lit(")"))).otherwise("")
    sentence = F.concat(F.when(explicit, F.concat(base, pages, more)).otherwise(guess), cite, F.lit("."))
    return j.withColumns({"weight": F.round("weight", 3), "provenance_kind": kind, "provenance_summary": sentence}).withColumn("id", F.concat_ws("_", F.lit("edge"), "source", "target"))


def knowledge_map(entities: DataFrame, relations: DataFrame, pages: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """MAP-14/16/17: nodes, edges, groups and stats; an empty project gives empty ones."""
    supports = support(entities, relations)
    # The nodes and what ties them are few and used many times over.
    nodes = written(node_terms(select_nodes(with_pages(entities, relations, pages), supports)), "nodes")
    supports = written(supports.join(F.broadcast(nodes.select(F.col("id").alias("entity_id"))), "entity_id", "left_semi"), "supports")
    explicit = merge_text_edges(explicit_edges(relations, nodes), text_edges(nodes))
    edges = written(map_edges(explicit, shared_pairs(nodes, supports)), "edges")
    groups = written(node_groups(nodes, edges, supports), "groups")
    meta = written(group_stats(nodes, edges, groups, supports), "groups")
    shown = serialised(edges, sources)
    lead = neighbours(shown, nodes).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("other").alias("neighbour"), "label", "relation_type", "kind", "weight", "provenance_summary"))), lambda x: x.dropFields("place")).alias("lead_ideas"))
    records = (
        nodes.join(groups.select("id", "group"), "id").join(meta.select("group", F.col("label").alias("group_label"), F.col("rationale").alias("group_rationale")), "group")
        .join(degrees(edges), "id", "left").join(lead, "id", "left")
        .select("id", F.col("display_name").alias("label"), "entity_type", "summary", "group", "group_label", "group_rationale", "page_id", "page_title", "source_count", F.coalesce("degree", F.lit(0)).alias("degree"), F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"), "lead_ideas", F.round(tx.stable_noise(F.col("id").cast("string")), 6).alias("seed"))
    )
    counts = edges.agg(F.count("*").alias("edge_count"), F.count_if(F.col("kind") == "explicit").alias("explicit_edge_count"), F.count_if(F.col("kind") == "inferred").alias("inferred_edge_count"))
    stats = counts.join(nodes.agg(F.count("*").alias("node_count"))).join(meta.agg(F.count("*").alias("group_count")))  # one row each
    return {"nodes": records, "edges": shown.orderBy(F.desc("weight"), "source", "target"), "groups": meta, "stats": stats}


def hubs(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """WIN-10: the most connected nodes of a map."""
    return nodes.orderBy(F.desc("degree"), F.desc("source_count"), F.lower("label")).limit(limit)


def export(parts: dict[str, DataFrame], path: str) -> None:
    """SNK-07: nodes, edges, groups and stats as JSON lines, a folder of each."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def report(parts: dict[str, DataFrame], name: str) -> str:
    """SNK-07: the map as Markdown, from its bounded tables."""
    s = parts["stats"].first()
    lines = [f"# Graph report: {name}", "", f"{s['node_count']} nodes, {s['edge_count']} edges ({s['explicit_edge_count']} explicit, {s['inferred_edge_count']} inferred), {s['group_count']} groups", "", "## Hubs", ""]
    lines += [f"- {r['label']} (degree {r['degree']}, sources {r['source_count']})" for r in hubs(parts["nodes"]).collect()]
    for kind in ("explicit", "inferred"):
        lines += ["", f"## Strongest {kind} edges", ""]
        lines += [f"- {r['source']} – {r['target']}: {r['provenance_summary']}" for r in parts["edges"].where(F.col("kind") == kind).orderBy(F.desc("weight"), "source", "target").limit(8).collect()]
    lines += ["", "## Groups", ""] + [f"- {r['label']}: {r['rationale']}" for r in parts["groups"].orderBy("group").collect()]
    return "\n".join(lines) + "\n"
