"""Normalisation: documents to summaries, entities, claims and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import documents as dc, text as tx
from .shared import written

# The kinds that are known, and the limits of a normalised document.
ENTITY_TYPES = ["concept", "person", "org", "method", "dataset", "tool", "topic"]
CLAIM_KINDS = ["fact", "comparison", "definition", "open_question", "recommendation"]
TEXT, SUMMARY, NAME, CLAIM, TYPE = 12_000, 800, 200, 400, 50
ENTITIES, ALIASES, CLAIMS, RELATIONS, LABELS, FLAGS = 15, 5, 10, 10, 6, 4


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean(docs: DataFrame) -> DataFrame:
    """NRM-02, FLT-12/13, SRT-08, SCA-30: rows with summary, entities, claims,
    relations, topic_labels and quality_flags, cleaned and cut; a row without a
    summary is refused."""
    none = F.array()

    def arr(name: str) -> Column:
        return F.coalesce(F.col(name), none)

    named = F.filter(arr("entities"), lambda e: F.coalesce(_stripped(e["name"]), F.lit("")) != "")
    entities = F.transform(named, lambda e: F.struct(
        F.substring(_stripped(e["name"]), 1, NAME).alias("name"),
        F.when(e["entity_type"].isin(ENTITY_TYPES), e["entity_type"]).otherwise("concept").alias("entity_type"),
        F.slice(F.coalesce(e["aliases"], none.cast("array<string>")), 1, ALIASES).alias("aliases"), tx.clamp(F.coalesce(e["confidence"], F.lit(0.8))).alias("confidence")))
    said = F.filter(arr("claims"), lambda c: (F.coalesce(_stripped(c["text"]), F.lit("")) != "") & (F.length(c["text"]) <= CLAIM))
    claims = F.transform(said, lambda c: F.struct(
        _stripped(c["text"]).alias("text"), F.when(c["claim_kind"].isin(CLAIM_KINDS), c["claim_kind"]).otherwise("fact").alias("claim_kind"), tx.clamp(F.coalesce(c["confidence"], F.lit(0.5))).alias("confidence")))
    tied = F.filter(arr("relations"), lambda r: (F.coalesce(_stripped(r["from_name"]), F.lit("")) != "") & (F.coalesce(_stripped(r["to_name"]), F.lit("")) != ""))
    relations = F.transform(tied, lambda r: F.struct(
        F.substring(_stripped(r["from_name"]), 1, NAME).alias("from_name"), F.substring(F.coalesce(r["relation_type"], F.lit("related_to")), 1, TYPE).alias("relation_type"),
        F.substring(_stripped(r["to_name"]), 1, NAME).alias("to_name"), tx.clamp(F.coalesce(r["confidence"], F.lit(0.8))).alias("confidence")))
    short = lambda name, n: F.transform(F.slice(F.coalesce(F.col(name), none.cast("array<string>")), 1, n), lambda x: F.substring(x, 1, TYPE))
    return docs.where("summary IS NOT NULL AND trim(summary) <> ''").withColumns({
        "summary": F.substring("summary", 1, SUMMARY), "entities": F.slice(entities, 1, ENTITIES), "claims": F.slice(claims, 1, CLAIMS), "relations": F.slice(relations, 1, RELATIONS),
        "topic_labels": short("topic_labels", LABELS), "quality_flags": short("quality_flags", FLAGS)})


def extract(sources: DataFrame) -> DataFrame:
    """NRM-01/04: (source_id, title, summary, entities, claims, ...) from sources
    (id, title, text) by the deterministic rules; a source without text is its title."""
    s = sources.select(F.col("id").alias("source_id"), "title", F.substring(F.coalesce("text", F.lit("")), 1, TEXT).alias("text"))
    # Written: rules that read each other's results would else be expanded into one another.
    s = written(dc.described(s).select("source_id", "title", "abstract", (F.trim("text") == "").alias("_blank")), "described")
    s = s.withColumn("summary", F.coalesce(F.nullif("abstract", F.lit("")), "title"))
    blank = F.col("_blank")
    flags = F.when(blank, F.array(F.lit("no_text"))).otherwise(F.array(F.lit("deterministic_fallback")))
    s = dc.with_concepts(s, summary="summary")
    entities = F.transform("concepts", lambda c: F.struct(c.alias("name"), F.lit("concept").alias("entity_type"), F.array().cast("array<string>").alias("aliases"), F.lit(0.35).alias("confidence")))
    claims = F.transform(tx.key_claims(F.col("summary")), lambda c: F.struct(c.alias("text"), F.lit("fact").alias("claim_kind"), F.lit(0.3).alias("confidence")))
    return s.select("source_id", "title", "summary", F.when(~blank, entities).otherwise(F.array()).alias("entities"), F.when(~blank, claims).otherwise(F.array()).alias("claims"), F.array().cast("array<struct<from_name:string,relation_type:string,to_name:string,confidence:double>>").alias("relations"), F.array().cast("array<string>").alias("topic_labels"), flags.alias("quality_flags"))


def tables(docs: DataFrame, versions: DataFrame | None = None) -> dict[str, DataFrame]:
    """NRM-03, JOI-17: entities, claims, relations and source versions of cleaned
    documents. Identifiers are hashes of natural keys, so reruns agree; names on
    both ends of a relation are looked up among the document's own entities first."""
    e = docs.select("source_id", F.posexplode("entities").alias("n", "e")).select("source_id", "n", "e.*")
    key = F.sha2(F.concat_ws("\u0001", "entity_type", tx.name_key(F.col("name"))), 256)
    first = F.struct("source_id", "n")
    entities = e.withColumn("id", key).groupBy("id").agg(
        F.min_by("entity_type", first).alias("entity_type"), F.min_by("name", first).alias("canonical_name"), F.min_by("name", first).alias("display_name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.max("confidence").alias("confidence"), F.min("source_id").alias("created_from_source_id"))
    c = docs.select("source_id", F.posexplode("claims").alias("n", "c")).select("source_id", "n", "c.*")
    claims = c.select(F.sha2(F.concat_ws("\u0001", "source_id", "n", "text"), 256).alias("id"), "source_id", F.col("text").alias("claim_text"), "claim_kind", "confidence", F.lit("active").alias("status"))
    r = docs.select("source_id", F.explode("relations").alias("r")).select("source_id", "r.*")
    names = entities.groupBy(F.lower(F.trim("canonical_name")).alias("k")).agg(F.min("id").alias("i"))
    for end in ("from", "to"):
        r = r.join(names.select(F.col("k").alias(f"_{end}"), F.col("i").alias(f"{end}_id")), F.lower(F.trim(f"{end}_name")) == F.col(f"_{end}")).drop(f"_{end}")
    relations = r.where("from_id <> to_id").groupBy("from_id", "relation_type", "to_id").agg(F.max("confidence").alias("confidence"), F.min("source_id").alias("evidence_source_id"))
    last = versions.groupBy("source_id").agg(F.max("version_no").alias("v")) if versions is not None else docs.select("source_id").limit(0).withColumn("v", F.lit(0))
    new = docs.select("source_id", "summary").join(last, "source_id", "left").select("source_id", (F.coalesce("v", F.lit(0)) + 1).alias("version_no"), "summary")
    return {"entities": entities, "claims": claims, "relations": relations, "source_versions": new, "documents": docs.select("source_id", F.to_json(F.struct("summary", "entities", "claims", "relations", "topic_labels", "quality_flags")).alias("json"))}
