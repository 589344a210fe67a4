"""Questions: plan, evidence, answer and its filing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as tx
from .search import bm25, exact_search, query_tokens, relation_expand

# The kinds of tasks and the budgets of evidence.
TASKS = ("answer", "comparison", "study_guide", "reading_plan", "report", "slides", "checklist", "open_questions", "gap_analysis", "maintenance_report")
PAGES, SOURCES, CLAIMS, FETCHED, USED, EXACT_TERMS, TERMS = 8, 5, 15, 20, 15, 3, 5
RELATED, PAGES_EACH = 5, 3


@dataclass
class Plan:
    """QRY-01."""

    task_type: str
    terms: list[str]
    exact_terms: list[str] = field(default_factory=list)


def plan(prompt: str, task_type: str = "auto", classify=None) -> Plan:
    """An explicit task type is kept; else ``classify`` (a model) or 'answer'.
    Terms are the words of over three characters, the first five."""
    words = [w.strip(".,?!") for w in prompt.split() if len(w) > 3][:TERMS]
    kind = task_type if task_type in TASKS else (classify(prompt) if classify else "answer")
    return Plan(kind if kind in TASKS else "answer", words, words[:EXACT_TERMS])


def evidence(p: Plan, units: DataFrame, pages: DataFrame, entities: DataFrame, relations: DataFrame, sources: DataFrame, claims: DataFrame, index=None) -> dict[str, DataFrame]:
    """QRY-02, JOI-05, WIN-09: pages (the best by score, then id), summaries of
    sources behind them, and the project's most certain claims. With ``index`` (an
    ``Index`` of the units) no unit's text is read."""
    hits = None
    for t in p.exact_terms:
        h = exact_search(pages, entities, t)
        hits = h if hits is None else hits.unionByName(h)
    words = " ".join(p.terms)
    found = (index.bm25(words, limit=FETCHED) if index else bm25(units, words)).orderBy(F.desc("score"), "unit_id").limit(FETCHED).limit(USED).select(F.col("page_id").cast("string").alias("page_id"), "score")
    if hits is not None:
        seeds = hits.where("kind = 'entity'").select("id").distinct()
        rel = relations.withColumns({"from_id": F.col("from_id").cast("string"), "to_id": F.col("to_id").cast("string")})
        near = relation_expand(rel, seeds).orderBy(F.desc("confidence"), "id").limit(RELATED * EXACT_TERMS).select("id")
        about = rel.where("from_kind = 'page' AND relation_type = 'about' AND to_kind = 'entity'").join(near.union(seeds).distinct().withColumnRenamed("id", "to_id"), "to_id")
        about = about.withColumn("_r", F.row_number().over(Window.partitionBy("to_id").orderBy("from_id"))).where(F.col("_r") <= PAGES_EACH)
        found = found.unionByName(about.select(F.col("from_id").alias("page_id"), F.lit(1.0).alias("score"))).unionByName(hits.where("kind = 'page'").select(F.col("id").alias("page_id"), "score"))
    best = found.groupBy("page_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "page_id").limit(PAGES)
    shown = best.join(pages.withColumn("page_id", F.col("id").cast("string")).select("page_id", "title", "body"), "page_id")
    behind = expand_sources(best, relations).select("source_id")
    summaries = sources.withColumn("source_id", F.col("id").cast("string")).join(behind, "source_id", "left_semi").where("deleted_at IS NULL").orderBy("source_id").limit(SOURCES)
    return {"pages": shown, "sources": summaries.select("source_id", "title", F.substring(F.coalesce("summary", F.lit("")), 1, 1000).alias("summary")), "claims": claims.where("status = 'active'").orderBy(F.desc("confidence"), "id").limit(CLAIMS)}


def expand_sources(pages: DataFrame, relations: DataFrame) -> DataFrame:
    """JOI-19: distinct (page_id, source_id) by derivation."""
    d = relations.where("from_kind = 'page' AND relation_type = 'derived_from' AND to_kind = 'source'").select(F.col("from_id").cast("string").alias("page_id"), F.col("to_id").cast("string").alias("source_id"))
    return d.join(pages.select("page_id"), "page_id", "left_semi").distinct()


def answer(prompt: str, found: dict[str, DataFrame], task_type: str = "answer") -> str:
    """QRY-03: the deterministic answer to a task from the bounded evidence."""
    pages = found["pages"].orderBy(F.desc("score"), "page_id").limit(5).collect()
    sources, claims = found["sources"].limit(5).collect(), found["claims"].limit(6).collect()
    kind = task_type.replace("_", " ")
    if not pages and not sources and not claims:
        return f"# {prompt}\n\nThere is not enough evidence in this project for this {kind} yet: no page, source or claim matches.\n\nImport or approve sources, build the project, or ask about one of its pages.\n"
    out = [f"# {prompt}", "", f"This {kind} is put together from the project's pages, sources and claims, without a model.", ""]
    if pages:
        out += ["## Pages", "", *[f"- [[{r['title']}]] (`{r['page_id']}`): {_excerpt(r['body'])}" for r in pages], ""]
    if sources:
        out += ["## Sources", "", *[f"- {r['title']} (`{r['source_id']}`): {_excerpt(r['summary'])}" for r in sources], ""]
    if claims:
        out += ["## Claims", "", *[f"- {r['claim_text']} ({r['confidence']:.2f})" for r in claims], ""]
    return "\n".join(out)


def _excerpt(text: str | None) -> str:
    """The start of a text on one line, without a header block."""
    body = (text or "").strip()
    if body.startswith("---") and (end := body.find("\n---", 3)) > 0:
        body = body[end + 4 :]
    return " ".join(body.split())[:220].rstrip()


def with_provenance(text: str, found: dict[str, DataFrame]) -> str:
    """QRY-04: the footer that names up to ten pages and sources."""
    pages = [r["page_id"] for r in found["pages"].select("page_id").orderBy("page_id").limit(10).collect()]
    sources = [r["source_id"] for r in found["sources"].select("source_id").orderBy("source_id").limit(10).collect()]
    return f"{text}\n---\nPages: {', '.join(pages) or 'none'}\nSources: {', '.join(sources) or 'none'}\n"


def file_back(prompt: str, text: str, found: dict[str, DataFrame], relations: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """QRY-05: the question page and its edges: derived_from the evidence's sources,
    those behind its pages included, and references to the pages. None without evidence."""
    pages, sources = found["pages"].select("page_id"), found["sources"].select("source_id")
    if pages.isEmpty() and sources.isEmpty():
        return None
    spark = pages.sparkSession
    title = question_title(prompt)
    page = spark.createDataFrame([(title, text)], "title string, body string")
    slug = tx.slugify(F.col("title"), collapse_dashes=False)
    page = page.select(F.sha2(F.concat_ws("\u0001", F.lit("question"), slug), 256).alias("id"), F.lit("question").alias("page_type"), slug.alias("slug"), "title", "body", F.lit("active").alias("status"))
    own = page.select(F.col("id").alias("from_id"))
    every = sources.union(expand_sources(pages, relations).select("source_id")).distinct()
    ends = every.select(F.lit("derived_from").alias("relation_type"), F.lit("source").alias("to_kind"), F.col("source_id").alias("to_id")).unionByName(
        pages.distinct().select(F.lit("references").alias("relation_type"), F.lit("page").alias("to_kind"), F.col("page_id").alias("to_id"))
    )
    edges = ends.join(own).withColumn("from_kind", F.lit("page"))  # one page
    return page, edges.select(F.sha2(F.concat_ws("|", "from_id", "relation_type", "to_id"), 256).alias("id"), "from_kind", "from_id", "relation_type", "to_kind", "to_id", F.lit(1.0).alias("confidence"))


def question_title(prompt: str) -> str:
    """SCA-34."""
    return prompt[:80].rstrip(".? ")


__all__ = ["Plan", "answer", "evidence", "expand_sources", "file_back", "plan", "query_tokens", "question_title", "with_provenance"]
