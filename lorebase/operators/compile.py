"""Compilation: pages, indexes and logs as tables of Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx

# How many of each a page shows, and where kinds of pages and artifacts go.
CLAIMS, ENTITIES, EVIDENCE, RELATED, QUESTIONS = 8, 10, 5, 6, 3
WIKI = {"concept": "concepts", "source_summary": "sources", "comparison": "comparisons", "timeline": "timelines", "question": "questions", "index": "indexes", "glossary": "indexes"}
OUTPUT = {"answer": "answers", "report": "reports", "slides": "slides", "diagram": "diagrams", "memo": "reports", "study_guide": "reports", "checklist": "reports"}
RAW = {"bookmark": "bookmark_candidates", "url_article": "articles", "pdf": "papers", "repo_doc": "repos", "markdown_note": "notes", "image": "images", "dataset": "datasets"}
KNOWN = ["concept", "source_summary", "question", "index"]
# The index page's head and sections, and the words of log entries below.
INDEX_HEAD = '---\npage_type: "index"\ntitle: "Project Index"\nproject_id: "{}"\n---\n\n# Project Index\n'
SECTIONS = {"concept": "Concepts", "source_summary": "Sources", "question": "Questions", "index": "Indexes", "other": "Other Pages"}


def routed(kind: Column, table: dict[str, str], default: str) -> Column:
    """SNK-03/04/06: the folder of a kind."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(m, kind), F.lit(default))


def pick(rows: DataFrame, by: str, order: list, limit: int) -> DataFrame:
    """SRT-06: the first ``limit`` rows of each ``by``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= limit)


def bullets(items: Column, empty: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(empty))


def source_pages(documents: DataFrame) -> DataFrame:
    """CMP-01: the summary page of each normalised document."""
    claims = F.transform(F.slice(F.array_sort("claims", lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0)), 1, CLAIMS), lambda c: c["text"])
    names = F.transform(F.slice("entities", 1, ENTITIES), lambda e: F.concat(F.lit("[["), e["name"], F.lit("]]")))
    body = F.concat(F.lit("# "), "title", F.lit("\n\n"), "summary", F.lit("\n\n## Key claims\n\n"), bullets(claims, "_None._"), F.lit("\n\n## Concepts\n\n"), bullets(names, "_None._"), F.lit("\n"))
    return _pages(documents.withColumn("body", body), "source_summary", F.col("source_id"))


def _pages(df: DataFrame, kind: str, key: Column) -> DataFrame:
    slug = tx.slugify(F.col("title"))
    return df.select(
        F.sha2(F.concat_ws("\u0001", F.lit(kind), slug), 256).alias("id"), F.lit(kind).alias("page_type"), slug.alias("slug"), "title", "body", F.lit("active").alias("status"),
        key.alias("origin_id"), F.sha2("body", 256).alias("body_sha256"), tx.token_count(F.col("body")).alias("token_count"), F.concat_ws("/", routed(F.lit(kind), WIKI, "concepts"), F.concat(slug, F.lit(".md"))).alias("file_path"),
    )


def concept_context(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """JOI-07, SRT-06: (id, relationships): each entity's strongest relations as
    lines 'other (type)', the other end's name first."""
    r = relations.where("from_kind = 'entity' AND to_kind = 'entity'")
    both = r.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "relation_type", "confidence").unionByName(r.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "relation_type", "confidence"))
    named = both.join(entities.select(F.col("id").alias("other"), F.col("display_name").alias("name")), "other")
    top = pick(named, "id", [F.desc("confidence"), "name", "relation_type", "other"], RELATED)
    return top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name", "relation_type"))), lambda x: F.concat(x["name"], F.lit(" ("), x["relation_type"], F.lit(")"))).alias("relationships"))


def concept_pages(entities: DataFrame, relations: DataFrame, supports: DataFrame, documents: DataFrame) -> DataFrame:
    """CMP-02: the page of each entity that has a source or a description: the
    sources' summaries, up to four claims (those that name it, else the first),
    its relationships and open questions."""
    d = documents.select("source_id", F.col("title").alias("source_title"), "summary", F.transform("claims", lambda c: c["text"]).alias("texts"))
    s = pick(supports.join(d, "source_id"), "entity_id", [F.desc("source_id")], EVIDENCE)
    s = s.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("_r", "source_id", "source_title", "summary", "texts"))).alias("s"))
    j = entities.join(s, "id", "left").join(concept_context(entities, relations), "id", "left").where("s IS NOT NULL OR coalesce(description, '') <> ''")
    none = F.array().cast("array<string>")
    texts = F.coalesce(F.flatten(F.transform("s", lambda x: x["texts"])), none)
    j = j.withColumn("_texts", texts).withColumn("_own", F.filter("_texts", lambda t: F.contains(F.lower(t), F.lower(F.col("display_name")))))
    claims = F.slice(F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.slice("_texts", 1, 1)), 1, 4)
    about = F.coalesce(F.nullif("description", F.lit("")), F.get(F.transform("s", lambda x: x["summary"]), F.lit(0)))
    cited = F.coalesce(F.transform("s", lambda x: F.concat(F.lit("[["), x["source_title"], F.lit("]]"))), none)
    asks = F.transform(F.slice(F.coalesce("relationships", none), 1, QUESTIONS), lambda x: F.concat(F.lit("How does "), F.col("display_name"), F.lit(" relate to "), x, F.lit("?")))
    body = F.concat(F.lit("# "), "display_name", F.lit("\n\n"), F.coalesce(about, F.lit("")), F.lit("\n\n## Claims\n\n"), bullets(claims, "_None._"), F.lit("\n\n## Relationships\n\n"), bullets(F.coalesce("relationships", none), "_None._"), F.lit("\n\n## Sources\n\n"), bullets(cited, "_None._"), F.lit("\n\n## Open questions\n\n"), bullets(asks, "_None._"), F.lit("\n"))
    return _pages(j.withColumn("title", F.col("display_name")).withColumn("body", body), "concept", F.col("id"))


def upsert_pages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """DML-09, JOI-08, SET-06: pages by (page_type, slug), the new ones first; of
    several with one key the last by id. A page of the same origin under another
    slug goes."""
    w = Window.partitionBy("page_type", "slug").orderBy(F.desc("id"), F.desc("origin_id"))
    one = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    kept = existing.join(one.select("page_type", "slug"), ["page_type", "slug"], "left_anti").join(one.select("page_type", "origin_id"), ["page_type", "origin_id"], "left_anti")
    return kept.unionByName(one, allowMissingColumns=True)


def changed_pages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """FLT-11: the pages whose text is new or differs from the stored one."""
    return new.join(existing.select("id", "body_sha256"), ["id", "body_sha256"], "left_anti")


def content_units(pages: DataFrame) -> DataFrame:
    """FTS-02, DML-04: one retrieval unit per page; the index is derived, never patched."""
    return pages.select(F.col("id").alias("unit_id"), F.lit("page_body").alias("unit_type"), F.col("id").alias("page_id"), "title", "body")


def artifact_units(artifacts: DataFrame, most: int | None = None) -> DataFrame:
    """DML-04: retrieval units of artifacts, of their first ``most`` characters or whole."""
    body = F.col("body") if most is None else F.substring("body", 1, most)
    return artifacts.select(F.col("id").alias("unit_id"), F.lit("artifact_body").alias("unit_type"), F.lit(None).cast("string").alias("page_id"), "title", body.alias("body"))


def index_catalog(pages: DataFrame) -> DataFrame:
    """AGG-09: (bucket, n, entries): per kind of page its entries by title."""
    live = pages.where("status = 'active'")
    bucket = F.when(F.col("page_type").isin(KNOWN), F.col("page_type")).otherwise("other")
    entry = tx.index_entry(F.col("title"), tx.markdown_summary(F.col("body")), F.col("updated_at").cast("string"))
    return live.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("page_type", "title", "id", entry.alias("entry")))), lambda x: x["entry"]).alias("entries"))


def index_markdown(catalog: DataFrame, project: str) -> DataFrame:
    """SNK-08: the index page as one row of text."""
    c = catalog.agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("n", "entries")))).alias("m"))  # five buckets
    parts = [F.lit(INDEX_HEAD.format(project))]
    for k, title in SECTIONS.items():
        x = F.element_at("m", F.lit(k))
        parts += [F.concat(F.lit(f"\n## {title} ("), F.coalesce(x["n"], F.lit(0)), F.lit(")\n\n"), F.coalesce(F.array_join(x["entries"], "\n"), F.lit("_None yet._")), F.lit("\n"))]
    return c.select(F.concat(*parts).alias("body"))


def index_lines(pages: DataFrame, project: str) -> DataFrame:
    """SNK-08: the index page as rows of text (place, page_type, title, id, body) that
    follow one another in this order; no row holds more than one page."""
    live = pages.where("status = 'active'")
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(KNOWN) for x in (n, k)]), F.col("page_type")), F.lit(len(KNOWN)))
    entry = tx.index_entry(F.col("title"), tx.markdown_summary(F.col("body")), F.col("updated_at").cast("string"))
    lines = live.select((2 * place + 1).alias("place"), "page_type", "title", F.col("id").cast("string").alias("id"), F.concat(entry, F.lit("\n")).alias("body"))
    spark = pages.sparkSession
    heads = spark.createDataFrame([(k, t) for k, t in enumerate(SECTIONS.values())], "k int, t string")
    counts = live.groupBy(place.alias("k")).agg(F.count("*").alias("n"))
    head = heads.join(counts, "k", "left").select((2 * F.col("k")).alias("place"), F.lit(None).cast("string").alias("page_type"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("\n## "), "t", F.lit(" ("), F.coalesce("n", F.lit(0)), F.lit(")\n\n"), F.when(F.col("n").isNull(), "_None yet._\n").otherwise("")).alias("body"))
    first = spark.createDataFrame([(-1, None, None, None, INDEX_HEAD.format(project))], "place int, page_type string, title string, id string, body string")
    return lines.unionByName(head).unionByName(first)


def project_log(sources: DataFrame, runs: DataFrame, artifacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """SET-04, SRT-09, JOI-09, SNK-09: (created_at, entry) of ingests, queries,
    builds and maintenance in order of time, those without one first."""
    when = lambda: F.concat(F.lit("## ["), tx.log_date(F.col("created_at")), F.lit("] "))
    s = sources.where("deleted_at IS NULL").select("created_at", "id", F.concat(when(), F.lit("ingest | "), F.coalesce(F.nullif("title", F.lit("")), "id"), F.lit("\n- Source ID: `"), "id", F.lit("`\n- Type: "), "source_type", F.lit("\n- Status: "), "status").alias("entry"))
    a = artifacts.select(F.col("id").alias("result_artifact_id"), F.col("title").alias("_t"))
    output = F.when(F.col("result_artifact_id").isNotNull(), F.concat(F.lit("\n- Output: `"), "result_artifact_id", F.lit("` ("), F.coalesce("_t", "result_artifact_id"), F.lit(")"))).otherwise("")
    q = runs.join(a, "result_artifact_id", "left").select("created_at", "id", F.concat(when(), F.lit("query | "), F.substring(F.coalesce(F.nullif(F.trim("prompt_text"), F.lit("")), "id"), 1, 80), F.lit("\n- Query Run ID: `"), "id", F.lit("`\n- Task type: "), "task_type", F.lit("\n- Status: "), "status", output).alias("entry"))
    kind = F.when(F.col("job_type") == "compile_project", "build | ").otherwise("lint | ")
    j = jobs.where("job_type IN ('compile_project', 'run_maintenance')").select("created_at", "id", F.concat(when(), kind, "job_type", F.lit("\n- Job ID: `"), "id", F.lit("`\n- Status: "), "status").alias("entry"))
    return s.unionByName(q).unionByName(j).orderBy(F.coalesce("created_at", F.lit("")), "id")
