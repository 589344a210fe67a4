"""Ingest: source rows, trust and dedup on insert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx


def source_rows(bookmarks: DataFrame, domains: list[str], folders: list[str]) -> DataFrame:
    """ING-01, FLT-14, WIN-06: bookmarks (with ``ordinal``) as sources: no empty or
    script URLs, the first of each URL, approved where domain or folder is trusted."""
    ok = bookmarks.where("url IS NOT NULL AND trim(url) <> '' AND lower(url) NOT LIKE 'javascript:%'")
    one = first_by(ok, F.col("url"), [F.col("ordinal")])
    good = tx.trusted(F.col("domain"), F.col("folder_path"), domains, folders)
    return one.select(
        F.sha2("url", 256).alias("id"), "title", "url", "domain", "folder_path", "added_at", F.sha2("url", 256).alias("checksum"), "ordinal",
        F.when(good, "high").otherwise("unknown").alias("trust_level"), F.when(good, "approved").otherwise("needs_review").alias("ingest_state"),
        F.to_json(F.struct("title", "url", "folder_path")).alias("stub"),
    )


def first_by(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key; rows without a key all stay. Firsts are combined
    before the shuffle, so that a key of many rows is no burden to one task."""
    keyed = rows.withColumn("_k", key)
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    one = keyed.where("_k IS NOT NULL").groupBy("_k").agg(F.min_by(whole, F.struct(*order)).alias("x")).select("x.*")
    return one.unionByName(keyed.where("_k IS NULL").drop("_k"))


def dedup_insert(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """SET-07: the rows of a batch to insert: the first of each URL, of these the
    first of each checksum, without those that a live row already has."""
    order = [F.col("ordinal")]
    one = first_by(first_by(batch, F.col("url"), order), F.col("checksum"), order)
    live = existing.where("deleted_at IS NULL")
    urls = live.select(F.col("url").alias("_u")).where("_u IS NOT NULL")
    sums = live.select(F.col("checksum").alias("_c")).where("_c IS NOT NULL")
    return one.join(urls, F.col("url") == F.col("_u"), "left_anti").join(sums, F.col("checksum") == F.col("_c"), "left_anti")


def insert_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """AGG-15: (parsed, inserted, skipped)."""
    p, i = batch.agg(F.count("*").alias("parsed")), inserted.agg(F.count("*").alias("inserted"))
    return p.join(i).select("parsed", "inserted", (F.col("parsed") - F.col("inserted")).alias("skipped"))  # one row each
