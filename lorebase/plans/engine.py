"""The facade: one method per analytic call, over a project's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import settings
from ..operators import ask, checks, compile as pages_, graph, ingest, normalize, resolve, search
from ..operators.index import Index
from ..operators.shared import new_folder, written
from ..sources import files, vault


class KnowledgeEngine:
    """A project's tables by name, and the operations on them. ``extractor``,
    ``synthesizer`` and ``classifier`` may replace the deterministic rules."""

    TABLES = ("sources", "entities", "claims", "relations", "pages", "query_runs", "artifacts", "jobs", "findings", "documents", "query_events")

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], extractor: Callable | None = None, synthesizer: Callable | None = None, classifier: Callable | None = None):
        self.spark, self.tables = spark, dict(tables)
        self.index_: Index | None = None
        self.parts: dict[str, int] = {}
        self.dirty = 0
        self.extractor, self.synthesizer, self.classifier = extractor or normalize.extract, synthesizer, classifier

    @classmethod
    def open(cls, spark: SparkSession, path: str, **how) -> KnowledgeEngine:
        """Opens the Parquet tables of a project's folder."""
        found = {}
        for t in cls.TABLES:
            try:
                found[t] = spark.read.parquet(f"{path}/{t}")
            except Exception as e:  # a table that was never written
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return cls(spark, found, **how)

    def save(self, path: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    #: Additions to a table after which it is written anew.
    PARTS = 16

    def _append(self, table: str, rows: DataFrame) -> None:
        """Rows at the end of a table: they are written, the table is not."""
        old = self.tables.get(table)
        new = written(rows, table)
        self._put(table, old.unionByName(new, allowMissingColumns=True) if old is not None else new)

    def _put(self, table: str, df: DataFrame) -> None:
        """A table after a small change, which is written anew only once in PARTS changes."""
        self.parts[table] = self.parts.get(table, 0) + 1
        if self.parts[table] >= self.PARTS:
            df, self.parts[table] = written(df, table), 0
        self.tables[table] = df

    def _row(self, **values) -> DataFrame:
        kinds = ", ".join(f"{k} string" for k in values)
        return self.spark.createDataFrame([tuple(values.values())], kinds).withColumn("created_at", F.current_timestamp())

    def _job(self, kind: str, status: str = "succeeded") -> str:
        job = uuid.uuid4().hex
        self._append("jobs", self._row(id=job, job_type=kind, status=status))
        return job

    def import_sources(self, rows: DataFrame) -> dict[str, int]:
        """ING-03, SET-07, AGG-15: source rows (id, title, text, checksum, ...) that
        are not there yet, by URL and checksum; how many were given, new and known."""
        given = rows if "url" in rows.columns else rows.withColumn("url", F.lit(None).cast("string"))
        given = given.withColumn("ordinal", F.monotonically_increasing_id() if "ordinal" not in rows.columns else F.col("ordinal"))
        given = written(given.withColumns({"deleted_at": F.lit(None).cast("timestamp"), "created_at": F.current_timestamp()}), "batch")
        old = self.tables.get("sources")
        stored = old if old is not None else given.limit(0)
        new = written(ingest.dedup_insert(given, stored), "inserted")
        counts = ingest.insert_counts(given, new).first().asDict()
        self._append("sources", new.drop("ordinal"))
        self._job("import_sources")
        return counts

    def import_bookmarks(self, bookmarks: DataFrame, domains: list[str] = (), folders: list[str] = ()) -> dict[str, int]:
        """ING-01: bookmarks (with ``ordinal``) as sources that wait for their pages."""
        rows = ingest.source_rows(bookmarks, list(domains), list(folders))
        return self.import_sources(rows.select("id", "title", F.lit(None).cast("string").alias("text"), "checksum", "url", "ordinal", "trust_level", F.col("ingest_state").alias("status")))

    def import_pages(self, pages: DataFrame, domains: list[str] = ()) -> dict[str, int]:
        """ING-03: fetched web pages (page_id, url, html)."""
        return self.import_sources(files.article_sources(pages, list(domains)))

    def set_status(self, ids: list[str], status: str) -> None:
        """DML-03: sources approved or rejected; those deleted stay as they are."""
        live = self.tables["sources"].where("deleted_at IS NULL")
        gone = self.tables["sources"].where("deleted_at IS NOT NULL")
        self.tables["sources"] = written(settings.transition(live, "status", ids, status).unionByName(gone), "sources")

    def delete_sources(self, ids: list[str]) -> None:
        """DML-08: marks sources as deleted."""
        when = F.when(F.col("id").isin(ids), F.coalesce("deleted_at", F.current_timestamp())).otherwise(F.col("deleted_at"))
        self.tables["sources"] = written(self.tables["sources"].withColumn("deleted_at", when), "sources")

    def import_and_build(self, folder: str) -> KnowledgeEngine:
        """Folder to sources: text, Markdown and PDF files; then ``build``."""
        found = written(files.scan_folder(self.spark, folder), "files")
        self.import_sources(files.text_documents(found).unionByName(files.pdf_sources(found)))
        return self.build()

    def build(self) -> KnowledgeEngine:
        """CMP-03, FLT-11: sources to normalised documents, resolved entities and pages.

        Only sources that are new, or whose title or text differ from what was
        normalised, are normalised; documents of other sources stay, those of sources
        that are gone go. Pages that did not change stay as they are; question pages
        stay. ``dirty`` says how many sources were normalised."""
        known = self.tables.get("documents")
        digest = F.sha2(F.to_json(F.struct(F.coalesce("given_title", F.lit("")).alias("a"), F.coalesce("text", F.lit("")).alias("b"))), 256)
        given = self.tables["sources"]
        given = given if "given_title" in given.columns else given.withColumn("given_title", F.col("title"))
        sources = given.where("deleted_at IS NULL AND status = 'approved'").withColumn("title", F.coalesce("given_title", "title"))
        states = written(sources.select("id", digest.alias("source_sha256")), "states")
        if known is None or "source_sha256" not in known.columns:
            dirty, kept = states, None
        else:
            kept = known.join(states.withColumnRenamed("id", "source_id"), ["source_id", "source_sha256"], "left_semi")
            dirty = written(states.join(known.select(F.col("source_id").alias("id"), "source_sha256"), ["id", "source_sha256"], "left_anti"), "dirty")
        self.dirty = dirty.count()
        fresh = normalize.clean(self.extractor(sources.join(dirty.select("id"), "id", "left_semi"))).join(dirty.withColumnRenamed("id", "source_id"), "source_id")
        documents = written(fresh if kept is None else kept.unionByName(fresh), "documents")
        t = {name: written(df, name) for name, df in normalize.tables(documents).items()}
        groups = written(resolve.clusters(t["entities"]), "groups")
        entities = resolve.merged_entities(t["entities"], groups).withColumn("description", F.lit(None).cast("string"))
        relations = t["relations"].select(F.sha2(F.concat_ws("|", "from_id", "relation_type", "to_id"), 256).alias("id"), F.lit("entity").alias("from_kind"), "from_id", "relation_type", F.lit("entity").alias("to_kind"), "to_id", "confidence", "evidence_source_id")
        mentions = documents.select("source_id", F.explode("entities").alias("e")).join(t["entities"].select("id", "canonical_name"), F.col("e.name") == F.col("canonical_name")).join(groups.select("id", "winner"), "id")
        mentions = mentions.select("source_id", "winner").distinct().select(F.sha2(F.concat_ws("|", "source_id", "winner"), 256).alias("id"), F.lit("source").alias("from_kind"), F.col("source_id").alias("from_id"), F.lit("mentions").alias("relation_type"), F.lit("entity").alias("to_kind"), F.col("winner").alias("to_id"), F.lit(0.35).alias("confidence"), F.col("source_id").alias("evidence_source_id"))
        entities, relations = written(entities, "entities"), written(resolve.merged_relations(relations, groups).unionByName(mentions), "relations")
        supports = graph.support(entities, relations)
        sp = pages_.source_pages(documents)
        cp = pages_.concept_pages(entities, relations, supports, documents)
        edge = lambda p, kind, rel: p.select(F.sha2(F.concat_ws("|", "id", "origin_id"), 256).alias("id"), F.lit("page").alias("from_kind"), F.col("id").alias("from_id"), F.lit(rel).alias("relation_type"), F.lit(kind).alias("to_kind"), F.col("origin_id").alias("to_id"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("evidence_source_id"))
        new = written(sp.unionByName(cp).withColumn("updated_at", F.current_timestamp()), "pages")
        old = self.tables.get("pages")
        kept = old.where("page_type = 'question'") if old is not None else new.limit(0)
        if old is not None:
            changed = pages_.changed_pages(old, new)
            same = old.join(new.select("id", "body_sha256"), ["id", "body_sha256"], "left_semi")
            new = same.unionByName(changed, allowMissingColumns=True)
        asked = self.tables["relations"].join(kept.select(F.col("id").alias("from_id")), "from_id", "left_semi").where("from_kind = 'page'") if "relations" in self.tables else None
        every = relations.unionByName(edge(sp, "source", "derived_from")).unionByName(edge(cp, "entity", "about"))
        named = given.drop("summary").join(documents.select(F.col("source_id").alias("id"), "summary", F.col("title").alias("_t")), "id", "left")
        self.tables |= {
            "sources": written(named.withColumn("title", F.coalesce("_t", "title")).drop("_t"), "sources"),
            "entities": entities, "claims": t["claims"], "documents": documents,
            "relations": written(every.unionByName(asked, allowMissingColumns=True) if asked is not None else every, "relations"),
            "pages": written(pages_.upsert_pages(kept, new), "pages"),
        }
        self._reindex(old)
        self._job("compile_project")
        return self

    def sources_list(self, status: str | None = None, ingest_state: str | None = None, limit: int = 200) -> DataFrame:
        """FLT-01, FLT-10."""
        s = self.tables["sources"].where("deleted_at IS NULL")
        for name, value in (("status", status), ("ingest_state", ingest_state)):
            if value is not None:
                s = s.where(F.col(name) == value)
        return s.orderBy(F.desc("created_at"), "id").limit(limit)

    def pages_list(self, page_type: str | None = None) -> DataFrame:
        """FLT-02."""
        p = self.tables["pages"]
        return p.where(F.col("page_type") == page_type).orderBy(F.desc("updated_at"), "id") if page_type else p.orderBy("page_type", "title", "id")

    def get(self, table: str, key: str) -> dict:
        """FLT-05: one row, or KeyError."""
        row = self.tables[table].where(F.col("id") == key).limit(1).first()
        if row is None:
            raise KeyError(f"{table}: {key}")
        return row.asDict(recursive=True)

    def search(self, query: str, limit: int = 20) -> DataFrame:
        p = self.tables["pages"]
        return search.search(self._units(), query, limit, pages=p, index=self._index())

    def _units(self) -> DataFrame:
        u = pages_.content_units(self.tables["pages"])
        a = self.tables.get("artifacts")
        return u.unionByName(pages_.artifact_units(a)) if a is not None else u

    def _index(self) -> Index | None:
        """The stored index of pages and artifacts, built when first asked for and then kept up."""
        if self.index_ is None:
            units = self._units()
            self.index_ = Index.build(units, new_folder(self.spark, "index")) if not units.isEmpty() else None
        return self.index_

    def _reindex(self, old: DataFrame | None) -> None:
        """Brings the index from the ``old`` pages to the present ones: only pages that
        differ are added, in a segment of their own."""
        if self.index_ is None or old is None:
            self.index_ = None
            return
        now, columns = self.tables["pages"], ["id", "title", "body_sha256"]
        changed = now.join(old.select(columns), columns, "left_anti")
        gone = old.join(now.select("id"), "id", "left_anti").select(F.col("id").alias("unit_id"))
        self.index_.update(pages_.content_units(changed), gone)

    def query(self, prompt: str, task_type: str = "auto", on_phase: Callable[[str, str], None] | None = None) -> str:
        """QRY-04..06: plan, evidence and answer with its provenance, which is kept:
        the run, its phases, its artifact and, with evidence, a question page with its
        edges. ``on_phase`` is told of each phase as it begins. A run that raises is
        kept as failed, with the phase it came to."""
        run, phases = uuid.uuid4().hex, []

        def phase(name: str) -> None:
            phases.append(name)
            if on_phase is not None:
                on_phase(run, name)

        try:
            return self._query(run, prompt, task_type, phase)
        except Exception as e:
            phase("failed")
            self._append("query_runs", self._row(id=run, prompt_text=prompt, task_type=task_type, status="failed", error=str(e)[:1000]))
            raise
        finally:
            rows = self.spark.createDataFrame([(run, k, p) for k, p in enumerate(phases, 1)], "query_run_id string, seq_no int, phase string")
            self._append("query_events", rows)

    def _query(self, run: str, prompt: str, task_type: str, phase: Callable[[str], None]) -> str:
        t = self.tables
        phase("planning")
        p = ask.plan(prompt, task_type, self.classifier)
        phase("retrieving")
        found = {k: written(v, f"evidence-{k}") for k, v in ask.evidence(p, pages_.content_units(t["pages"]), t["pages"], t["entities"], t["relations"], t["sources"], t["claims"], self._index()).items()}
        phase("synthesizing")
        text = ask.with_provenance(self.synthesizer(prompt, found) if self.synthesizer else ask.answer(prompt, found, p.task_type), found)
        phase("writing")
        kind = "answer" if p.task_type == "answer" else p.task_type
        artifact = self._row(id=f"artifact-{run}", artifact_type=kind, title=ask.question_title(prompt), body=text, status="active").withColumn("file_path", F.concat_ws("/", pages_.routed(F.lit(kind), pages_.OUTPUT, "reports"), F.lit(f"{run}.md")))
        self._append("artifacts", artifact)
        self._append("query_runs", self._row(id=run, prompt_text=prompt, task_type=p.task_type, status="succeeded", result_artifact_id=f"artifact-{run}"))
        new, gone = pages_.artifact_units(artifact), None
        if (filed := ask.file_back(prompt, text, found, t["relations"])) is not None:
            page, edges = (written(x, "filed") for x in filed)
            page = page.withColumns({"origin_id": F.col("id"), "file_path": F.concat_ws("/", pages_.routed(F.lit("question"), pages_.WIKI, "concepts"), F.concat("slug", F.lit(".md"))), "body_sha256": F.sha2("body", 256), "updated_at": F.current_timestamp()})
            page = written(page, "filed")
            old = t["pages"]
            self._put("pages", pages_.upsert_pages(old, page))
            self._put("relations", settings.upsert(t["relations"], edges.withColumn("evidence_source_id", F.lit(None).cast("string")).select(t["relations"].columns), ["id"]))
            new = new.unionByName(pages_.content_units(page))
            gone = old.where("page_type = 'question'").join(page.select("slug"), "slug", "left_semi").select(F.col("id").alias("unit_id"))
        if self.index_ is not None:
            self.index_.update(new, gone)
        phase("done")
        return text

    def knowledge_map(self) -> dict[str, DataFrame]:
        t = self.tables
        return graph.knowledge_map(t["entities"], t["relations"], t["pages"], t["sources"])

    def run_maintenance(self, as_of=None, names: list[str] | None = None) -> DataFrame:
        t = self.tables
        concepts = t["entities"].where("entity_type = 'concept'").select("id", F.col("display_name").alias("name"))
        given = t | {"concepts": concepts, "evidence": graph.support(t["entities"], t["relations"])}
        found = written(checks.run_checks(given, as_of if as_of is not None else F.current_timestamp(), names), "found")
        old = t.get("findings")
        new = checks.upsert_findings(old if old is not None else found.limit(0).withColumn("status", F.lit("open")), found)
        self._append("findings", new)
        self._job("run_maintenance")
        return found

    def ignore(self, keys: DataFrame) -> None:
        """DML-03: findings (finding_type, subject_id) that are not to be shown again."""
        self.tables["findings"] = written(checks.ignore_findings(self.tables["findings"], keys), "findings")

    def log(self) -> DataFrame:
        """SNK-09: the project's log, from what was kept of its calls."""
        text = lambda df: df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
        empty = {"query_runs": "id string, prompt_text string, task_type string, status string, result_artifact_id string, created_at timestamp", "artifacts": "id string, title string", "jobs": "id string, job_type string, status string, created_at timestamp"}
        t = {k: self.tables[k] if k in self.tables else self.spark.createDataFrame([], v) for k, v in empty.items()}
        sources = text(self.tables["sources"]).withColumn("source_type", F.lit("document"))
        return pages_.project_log(sources, text(t["query_runs"]), t["artifacts"], text(t["jobs"]))

    def findings(self, rank: bool = True, limit: int = 100) -> DataFrame:
        """FLT-03: open findings, the gravest first; ``rank=False`` orders by the word."""
        place = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2) if rank else F.desc("severity")
        return self.tables["findings"].where("status = 'open'").orderBy(place, "finding_type", "subject_id").limit(limit)

    def recent(self, table: str, limit: int = 50) -> DataFrame:
        """FLT-04: the newest jobs, runs or artifacts."""
        return self.tables[table].orderBy(F.desc("created_at"), "id").limit(limit)

    def export_vault(self, folder: str, project: str) -> None:
        """SNK-03/04/05/08/09: pages, artifacts, normalised documents, the index and the
        log as files of ``folder``, all or none; those that are right already stay."""
        wiki = self.tables["pages"].select(F.concat(F.lit("wiki/"), "file_path").alias("file_path"), "body", F.lit(0).alias("place"), *[F.lit(None).cast("string").alias(c) for c in ("page_type", "title", "id")])
        one = lambda df, path, body: df.select(path.alias("file_path"), body.alias("body"), F.lit(0).alias("place"), *[F.lit(None).cast("string").alias(c) for c in ("page_type", "title", "id")])
        rows = wiki
        if "artifacts" in self.tables:
            rows = rows.unionByName(one(self.tables["artifacts"], F.concat(F.lit("outputs/"), "file_path"), F.col("body")))
        if "documents" in self.tables:
            d = self.tables["documents"]
            rows = rows.unionByName(one(d, F.concat(F.lit("normalized/"), "source_id", F.lit(".json")), F.to_json(F.struct(*d.columns))))
        rows = rows.unionByName(pages_.index_lines(self.tables["pages"], project).withColumn("file_path", F.lit("index.md")))
        log = self.log().select(F.lit("log.md").alias("file_path"), F.concat("entry", F.lit("\n\n")).alias("body"), F.lit(0).alias("place"), F.col("created_at").alias("page_type"), F.lit(None).cast("string").alias("title"), F.col("entry").alias("id"))
        vault.write_files(rows.unionByName(log), folder, "place", "page_type", "title", "id")

    def index(self, project: str) -> DataFrame:
        return pages_.index_markdown(pages_.index_catalog(self.tables["pages"]), project)
