"""Data-quality checks and their findings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.documents import similarity_udf
from .shared import written

# The thresholds and limits of the checks.
DUPLICATE, WEAK, STALE_DAYS, SHARED = 0.85, 0.4, 30, 2
MOST_LISTED, MOST_CONCEPTS, MOST_PAIRS, PREFIX = 50, 100, 10, 20
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 -"

FINDING = ["finding_type", "severity", "subject_id", "summary"]


def _finding(df: DataFrame, kind: str, severity: str, subject: str, summary: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"), F.col(subject).cast("string").alias("subject_id"), summary.alias("summary"))


def orphan_pages(pages: DataFrame, relations: DataFrame) -> DataFrame:
    """CHK-01: active pages, index pages aside, that derive from no source."""
    derived = relations.where("from_kind = 'page' AND relation_type = 'derived_from'").select(F.col("from_id").alias("id"))
    return pages.where("status = 'active' AND page_type <> 'index'").join(derived, "id", "left_anti")


def _grams(names: DataFrame, q: int) -> DataFrame:
    """(entity_type, n, token): runs of q characters of each name, the k-th of its
    kind as a token of its own, so that names share as many tokens as runs."""
    at = F.sequence(F.lit(1), F.greatest(F.length("n") - (q - 1), F.lit(1)))
    g = names.where(F.length("n") >= q).select("entity_type", "n", F.explode(F.transform(at, lambda i: F.substring(F.col("n"), i, F.lit(q)))).alias("gram"))
    g = g.groupBy("entity_type", "n", "gram").agg(F.count("*").alias("c"))
    return g.select("entity_type", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("c").cast("int")), lambda k: F.concat(k.cast("string"), F.col("gram")))).alias("token"))


def similar_names(names: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """JOI-12: (entity_type, a_id, b_id, ratio) of names of one type whose
    similarity is ``threshold`` or more, a before b by (name, id).

    An exact prefix filter. With M matched characters of S in both names, the ratio
    is 2 M / S. Matched runs number S - 2 M + 1 at most, so the names share at least
    3 M - S - 1 pairs of neighbouring characters, and M characters. A name has its
    pairs (characters, where the threshold is so low that names may share no pair)
    sorted by rarity; as it must share that many with any partner, one of the first
    few is among those that the partner begins with. Only names of one type that
    share such a token meet, once, at the first one that they share. Lengths and
    letters then bound the ratio, and what is left is compared. Twins of a name are
    joined back at the end.
    """
    low = F.lower(F.col("name"))
    one = names.select("entity_type", low.alias("n")).where("n IS NOT NULL").distinct()
    least = 1 / (1 - threshold) if threshold < 1 else math.inf  # characters of two different names that reach it
    q = 2 if (1.5 * threshold - 1) * least - 1 > 0 else 1
    tokens = written(_grams(one, q), "name-grams")
    rare = tokens.groupBy("entity_type", "token").agg(F.count("*").alias("df"))
    listed = tokens.join(rare, ["entity_type", "token"]).groupBy("entity_type", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    length = F.length("n")
    both = length + F.ceil(length * F.lit(threshold / (2 - threshold)) - 1e-9)  # with the shortest partner
    share = F.ceil(both * F.lit(1.5 * threshold - 1) - 1 - 1e-9) if q == 2 else F.ceil(both * F.lit(threshold / 2) - 1e-9)
    prefix = F.slice(F.transform("t", lambda x: x["token"]), F.lit(1), F.greatest(F.lit(0), F.size("t") - F.greatest(share, F.lit(1)).cast("int") + 1))
    first = written(listed.select("entity_type", "n", prefix.alias("p")).where(F.size("p") > 0), "name-prefixes")
    keyed = first.withColumn("token", F.explode("p"))
    x = keyed.select("entity_type", "token", F.col("n").alias("x"), F.col("p").alias("px"))
    y = keyed.select("entity_type", "token", F.col("n").alias("y"), F.col("p").alias("py"))
    lx, ly = F.length("x"), F.length("y")
    near = (F.col("x") < F.col("y")) & (2 * F.least(lx, ly) >= F.lit(threshold) * (lx + ly))
    j = x.join(y, ["entity_type", "token"]).where(near).where(F.element_at(F.array_intersect("px", "py"), 1) == F.col("token")).select("entity_type", "x", "y")
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    shared = sum((F.least(count(F.col("x"), c), count(F.col("y"), c)) for c in ALPHABET), F.lit(0))
    other = F.least(F.length(F.translate("x", ALPHABET, "")), F.length(F.translate("y", ALPHABET, "")))
    j = j.where(2 * (shared + other) >= F.lit(threshold) * (lx + ly))
    j = j.withColumn("ratio", similarity_udf("x", "y")).where(F.col("ratio") >= threshold).select("entity_type", "x", "y", "ratio")
    ids = names.select("entity_type", low.alias("n"), "id")
    first = ids.groupBy("entity_type", "n").agg(F.min("id").alias("first"))
    pairs = j.join(first.select("entity_type", F.col("n").alias("x"), F.col("first").alias("a_id")), ["entity_type", "x"]).join(ids.select("entity_type", F.col("n").alias("y"), F.col("id").alias("b_id")), ["entity_type", "y"])
    twins = ids.join(first, ["entity_type", "n"]).where("id <> first").select("entity_type", F.col("first").alias("a_id"), F.col("id").alias("b_id"), F.lit(1.0).alias("ratio"))
    return pairs.select("entity_type", "a_id", "b_id", "ratio").unionByName(twins)


def duplicate_entities(entities: DataFrame) -> DataFrame:
    """CHK-02: for each entity the first earlier one that it resembles."""
    found = similar_names(entities.select("id", "entity_type", F.col("canonical_name").alias("name")))
    return found.groupBy("b_id").agg(F.min_by(F.struct("a_id", "ratio"), F.struct(-F.col("ratio"), F.col("a_id"))).alias("x")).select("b_id", "x.a_id", "x.ratio")


def weak_claims(claims: DataFrame) -> DataFrame:
    """CHK-03: the least certain active claims."""
    return claims.where((F.col("status") == "active") & (F.col("confidence") < WEAK)).orderBy("confidence", "id").limit(MOST_LISTED)


def stale_pages(pages: DataFrame, as_of: Column) -> DataFrame:
    """CHK-04: active pages not updated for STALE_DAYS, the oldest first."""
    return pages.where((F.col("status") == "active") & (F.col("updated_at") < as_of - F.expr(f"INTERVAL {STALE_DAYS} DAYS"))).orderBy("updated_at", "id").limit(MOST_LISTED)


def missing_comparisons(concepts: DataFrame, evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """CHK-05, JOI-14/20: pairs of the first concepts by id that share SHARED
    sources or more, without a comparison page that names either."""
    first = concepts.orderBy("id").limit(MOST_CONCEPTS)
    e = evidence.join(first.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").distinct()
    a, b = e.select(F.col("entity_id").alias("a_id"), "source_id"), e.select(F.col("entity_id").alias("b_id"), "source_id")
    # At most MOST_CONCEPTS concepts, so a source has a bounded number of pairs.
    pairs = a.join(b, "source_id").where("a_id < b_id").groupBy("a_id", "b_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= SHARED)
    n = first.select("id", F.lower(F.substring("name", 1, PREFIX)).alias("n"))
    named = pairs.join(n.select(F.col("id").alias("a_id"), F.col("n").alias("a_name")), "a_id").join(n.select(F.col("id").alias("b_id"), F.col("n").alias("b_name")), "b_id")
    titles = pages.where("page_type = 'comparison'").select(F.lower("title").alias("t"))
    shown = F.contains(F.col("t"), F.col("a_name")) | F.contains(F.col("t"), F.col("b_name"))
    return named.join(titles, shown, "left_anti").orderBy(F.desc("shared"), "a_id", "b_id").limit(MOST_PAIRS)


def finding_totals(findings: DataFrame, by: str = "finding_type") -> DataFrame:
    """AGG-10: how many findings of each kind, and in all (a null kind)."""
    return findings.rollup(by).agg(F.count("*").alias("n"))


def ignore_findings(findings: DataFrame, keys: DataFrame) -> DataFrame:
    """DML-03: the open findings of these types and subjects are ignored from now on."""
    k = keys.select("finding_type", "subject_id", F.lit(True).alias("_hit")).distinct()
    j = findings.join(k, ["finding_type", "subject_id"], "left")
    return j.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "open"), F.lit("ignored")).otherwise(F.col("status"))).drop("_hit")


def upsert_findings(existing: DataFrame, found: DataFrame) -> DataFrame:
    """CHK-06, DML-02: findings without an open one of their type and subject; of
    several with one key the first by summary."""
    key = ["finding_type", "subject_id"]
    first = Window.partitionBy(*key).orderBy("summary", "severity")
    new = found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return new.join(existing.where("status = 'open'").select(*key), key, "left_anti").withColumn("status", F.lit("open"))


def run_checks(tables: dict[str, DataFrame], as_of: Column, checks: list[str] | None = None) -> DataFrame:
    """CHK-07: the findings of the named checks, of all where none is named."""
    every = {
        "orphan_page": lambda: _finding(orphan_pages(tables["pages"], tables["relations"]), "orphan_page", "medium", "id", F.concat(F.lit("No source: "), F.col("title"))),
        "duplicate_entity": lambda: _finding(duplicate_entities(tables["entities"]), "duplicate_entity", "medium", "b_id", F.concat(F.lit("Resembles "), F.col("a_id").cast("string"))),
        "weak_claim": lambda: _finding(weak_claims(tables["claims"]), "weak_claim", "low", "id", F.concat(F.lit("Low confidence: "), F.substring("claim_text", 1, 120))),
        "stale_page": lambda: _finding(stale_pages(tables["pages"], as_of), "stale_page", "low", "id", F.concat(F.lit("Not updated: "), F.col("title"))),
        "missing_comparison": lambda: _finding(missing_comparisons(tables["concepts"], tables["evidence"], tables["pages"]), "missing_comparison", "medium", "a_id", F.concat_ws(" / ", F.lit("No comparison"), "a_name", "b_name")),
    }
    out = None
    for name in checks or list(every):
        df = every[name]()
        out = df if out is None else out.unionByName(df)
    return out
