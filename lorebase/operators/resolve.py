"""Entity resolution: keys, components, winners and merged edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from .shared import min_labels


def entity_keys(entities: DataFrame) -> DataFrame:
    """RES-01: (id, entity_type, key), a row per key of a name or alias. An empty
    key identifies nothing."""
    keys = tx.name_keys(F.col("canonical_name"), F.col("aliases"))
    return entities.select("id", "entity_type", F.explode(keys).alias("key")).where("key <> ''").distinct()


def match(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """RES-02, JOI-18: (id, match_id): the least existing entity of the same type
    that shares a key. The four alias rules say just this, so it is one join."""
    a = entity_keys(incoming)
    # The least holder of each key first: a key that many share would else give a row per pair.
    b = entity_keys(existing).groupBy("entity_type", "key").agg(F.min("id").alias("match_id"))
    return a.join(b, ["entity_type", "key"]).groupBy("id").agg(F.min("match_id").alias("match_id"))


def clusters(entities: DataFrame) -> DataFrame:
    """RES-04/05: (id, root, winner): components over shared keys within a type,
    and each one's entity of the highest (confidence, id)."""
    hubs = entity_keys(entities).select("id", F.concat_ws("\u0001", "entity_type", "key").alias("hub"))
    roots = min_labels(entities, hubs)
    scored = entities.select("id", F.coalesce("confidence", F.lit(0.0)).alias("c")).join(roots, "id")
    best = scored.groupBy("root").agg(F.max_by("id", F.struct("c", "id")).alias("winner"))
    return roots.join(best, "root").select("id", "root", "winner")


def merged_entities(entities: DataFrame, found: DataFrame) -> DataFrame:
    """RES-06, AGG-12: the winners, their aliases joined with the names and aliases
    of the entities they absorb, without their own display name, sorted."""
    j = entities.join(found.select("id", "winner"), "id")
    names = F.concat(F.array("canonical_name", "display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    absorbed = j.groupBy(F.col("winner").alias("w")).agg(F.array_distinct(F.flatten(F.collect_list(names))).alias("names"), F.count("*").alias("members"))
    own = entities.join(absorbed, F.col("id") == F.col("w")).drop("w")
    kept = F.array_sort(F.filter(F.array_remove("names", F.col("display_name")), lambda n: F.trim(n) != ""))
    merged = F.when(F.col("members") > 1, kept).otherwise(F.coalesce("aliases", F.array().cast("array<string>")))
    return own.withColumn("aliases", merged).drop("names", "members")


def merged_relations(relations: DataFrame, found: DataFrame) -> DataFrame:
    """DML-05: both ends of each edge moved to the winners; of equal edges the one
    of the lowest id stays, and edges from an entity to itself go."""
    move = found.where("id <> winner").select(F.col("id").alias("_l"), "winner")
    out = relations
    for end in ("from", "to"):
        m = move.select(F.col("_l").alias(f"{end}_id"), F.lit("entity").alias(f"{end}_kind"), F.col("winner").alias("_w"))
        out = out.join(m, [f"{end}_id", f"{end}_kind"], "left").withColumn(f"{end}_id", F.coalesce("_w", f"{end}_id")).drop("_w")
    out = out.where("NOT (from_kind = to_kind AND from_id = to_id)")
    key = ["from_kind", "from_id", "relation_type", "to_kind", "to_id"]
    best = out.groupBy(*key).agg(F.min_by(F.struct("id", "confidence", "evidence_source_id"), "id").alias("x"))
    return best.select("x.id", *key, "x.confidence", "x.evidence_source_id")


def stats(found: DataFrame) -> DataFrame:
    """RES-08, AGG-13: (merged, clusters)."""
    sizes = found.groupBy("root").count()
    return sizes.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("merged"), F.count_if(F.col("count") > 1).alias("clusters"))


def absorb(entities: DataFrame, incoming: DataFrame) -> DataFrame:
    """RES-07, AGG-11: matched incoming names become aliases; confidence takes the larger."""
    m = match(incoming, entities).join(incoming.select("id", F.col("display_name").alias("n"), F.col("confidence").alias("c")), "id")
    add = m.groupBy(F.col("match_id").alias("m")).agg(F.collect_set("n").alias("names"), F.max("c").alias("c"))
    j = entities.join(add, F.col("id") == F.col("m"), "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", none), F.array_remove(F.coalesce("names", none), F.col("display_name")))))
    return j.withColumn("aliases", every).withColumn("confidence", F.greatest("confidence", "c")).drop("m", "names", "c")
