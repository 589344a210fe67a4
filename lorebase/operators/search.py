"""Full-text search: postings, BM25, boosts, exact search and graph expansion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..functions.stemming import stem, stems_udf
from .shared import drop_folder, written

# BM25 constants and the multipliers of page types and trust levels.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
PAGE_BOOST = {"comparison": 3.0, "concept": 2.0, "source_summary": 1.5, "question": 1.2, "timeline": 1.0, "glossary": 0.8, "index": 0.5}
TRUST_BOOST = {"high": 2.0, "medium": 1.0, "low": 0.5, "unknown": 0.3}


def postings(units: DataFrame) -> DataFrame:
    """FTS-02: (unit_id, term, tf) from units (unit_id, title, body)."""
    words = tx.tokens(F.concat_ws(" ", "title", "body"))
    return units.select("unit_id", F.explode(words).alias("term")).groupBy("unit_id", "term").agg(F.count("*").alias("tf"))


def term_stats(post: DataFrame) -> DataFrame:
    """AGG-17: (term, df, cf)."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_tokens(query: str) -> list[str]:
    """The distinct words of a query; all of them must occur in a hit."""
    folded = query.lower().translate(str.maketrans(tx.ACCENTED, tx.PLAIN))
    return list(dict.fromkeys(re.findall(r"[^\W_]+", folded)))


def match(query: str) -> tuple[list[list[str]], list[str]]:
    """FTS-03: (all of, none of): alternatives of which a hit holds one each, and
    words that it may not hold. Words stand side by side or are joined by OR; NOT
    excludes the next; a word that ends in * is a prefix."""
    every: list[list[str]] = []
    without: list[str] = []
    how = "and"
    for raw in re.findall(r"[^\W_]+\*?", query.translate(str.maketrans(tx.ACCENTED + tx.ACCENTED.upper(), tx.PLAIN * 2))):
        if raw in ("AND", "OR", "NOT"):
            how = raw.lower()
            continue
        word = raw.lower()
        if how == "not":
            without.append(word)
        elif how == "or" and every:
            every[-1].append(word)
        else:
            every.append([word])
        how = "and"
    return [list(dict.fromkeys(x)) for x in every], without


def _matches(term: str, column):
    return F.startswith(column, F.lit(term[:-1])) if term.endswith("*") else column == term


__all__ = ["bm25", "boost", "drop_folder", "exact_search", "match", "postings", "query_tokens", "relation_expand", "search", "spread", "term_stats"]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer pieces, as from one small file."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _scored(sized: DataFrame, every: list[list[str]], without: list[str], unit_types: list[str] | None) -> DataFrame:
    """BM25 over a written table with _dl and, per term, _tf0, _tf1, ..."""
    terms = [t for x in every for t in x]
    stats = sized.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    return _ranked(sized, stats, every, without, unit_types)


def _ranked(sized: DataFrame, stats: DataFrame, every: list[list[str]], without: list[str], unit_types: list[str] | None) -> DataFrame:
    terms, k, held = [t for x in every for t in x], 0, F.lit(True)
    for x in every:
        held = held & (F.greatest(F.lit(0), *[F.col(f"_tf{k + i}") for i in range(len(x))]) > 0)
        k += len(x)
    for i in range(len(without)):
        held = held & (F.col(f"_tf{k + i}") == 0)
    hits = sized.where(held)
    if unit_types:
        hits = hits.where(F.col("unit_type").isin(unit_types))
    j = hits.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        tf = F.col(f"_tf{i}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return j.withColumn("score", score).select(*[c for c in hits.columns if not re.fullmatch(r"_(dl|tf\d+)", c)], "score")


def bm25(units: DataFrame, query: str, unit_types: list[str] | None = None, stemmed: bool = False) -> DataFrame:
    """FTS-03/04: units that match, with score (higher is better), without their
    title and body.

    The texts are read once: sizes and counts of the query's terms are written,
    and statistics and scores come from there. ``stemmed`` compares English stems
    (in Arrow batches) instead of words. For many queries keep an ``index.Index``.
    """
    every, without = match(query)
    words = tx.tokens(F.concat_ws(" ", "title", "body"))
    if stemmed:
        every, without, words = [[stem(t) for t in x] for x in every], [stem(t) for t in without], stems_udf(words)
    rest = [c for c in units.columns if c not in ("title", "body")]
    if not every:
        return units.select(*rest).where("false").withColumn("score", F.lit(0.0))
    sized = spread(units).withColumn("_w", words).withColumn("_dl", F.size("_w"))
    for i, t in enumerate([*(t for x in every for t in x), *without]):
        sized = sized.withColumn(f"_tf{i}", F.size(F.filter("_w", _is(t))))
    return _scored(written(sized.drop("_w", "title", "body"), "bm25"), every, without, unit_types)


def _is(term: str):
    return lambda w: _matches(term, w)


def boost(column, table: dict[str, float], default: float):
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(m, column), F.lit(default))


def search(units: DataFrame, query: str, limit: int = 20, unit_types: list[str] | None = None, pages: DataFrame | None = None, sources: DataFrame | None = None, stemmed: bool = False, index=None) -> DataFrame:
    """FTS-05/06: the best ``limit`` units by BM25, then re-ranked by the boosts of
    their page's type and source's trust (a missing page or source leaves the
    score), with an excerpt. Boosts act inside the window that BM25 chose. With
    ``index`` (an ``Index`` of these units) the texts of the hits alone are read."""
    found = index.bm25(query, unit_types, limit) if index else bm25(units, query, unit_types, stemmed)
    top = found.orderBy(F.desc("score"), "unit_id").limit(limit)
    texts = units.select("unit_id", "title", "body")
    if index:  # the few hits are fetched by their ids, which reach the scan
        rows = top.collect()
        top, texts = units.sparkSession.createDataFrame(rows, top.schema), texts.where(F.col("unit_id").isin([r["unit_id"] for r in rows]))
    top = top.join(texts, "unit_id")
    if pages is not None:
        p = pages.select(F.col("id").alias("page_id"), "page_type")
        top = top.join(p, "page_id", "left").withColumn("score", F.when(F.col("page_type").isNull(), F.col("score")).otherwise(F.col("score") * boost(F.col("page_type"), PAGE_BOOST, 1.0)))
    if sources is not None:
        s = sources.select(F.col("id").alias("source_id"), F.coalesce("trust_level", F.lit("unknown")).alias("trust_level"))
        top = top.join(s, "source_id", "left").withColumn("score", F.when(F.col("trust_level").isNull(), F.col("score")).otherwise(F.col("score") * boost(F.col("trust_level"), TRUST_BOOST, 0.3)))
    return top.withColumn("excerpt", F.substring("body", 1, 500)).drop("body").orderBy(F.desc("score"), "unit_id")


def exact_search(pages: DataFrame, entities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """FTS-07: titles and names that contain the query (% and _ act as wildcards);
    equal ones score higher, pages before entities, ``limit`` of each and in all."""
    q = query.lower()

    def like(c):
        return F.lower(c).like(f"%{q}%")

    p = pages.where((F.col("status") == "active") & like(F.col("title"))).orderBy("title", "id").limit(limit)
    p = p.select(F.lit("page").alias("kind"), F.col("id").cast("string").alias("id"), F.col("title").alias("name"), F.when(F.lower("title") == q, 10.0).otherwise(5.0).alias("score"))
    e = entities.where(like(F.col("canonical_name")) | like(F.col("display_name"))).orderBy("id").limit(limit)
    e = e.select(F.lit("entity").alias("kind"), F.col("id").cast("string").alias("id"), F.col("display_name").alias("name"), F.when(F.col("canonical_name") == q, 8.0).otherwise(4.0).alias("score"))
    return p.unionByName(e).orderBy(F.desc("score"), F.col("kind") == "entity", F.col("id")).limit(limit)


def relation_expand(relations: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """FTS-08: (id, hop, relation_type, confidence) of entities within ``hops``
    edges of ``seeds`` (id), seeds excluded; the first edge by id tells how."""
    edge = relations.where("from_kind = 'entity' AND to_kind = 'entity'")
    both = edge.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "id", "relation_type", "confidence").unionByName(
        edge.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), "id", "relation_type", "confidence")
    )
    seen, front, out = seeds.select("id").distinct(), seeds.select("id").distinct(), None
    for hop in range(1, hops + 1):
        found = both.join(front.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.min_by(F.struct("relation_type", "confidence"), "id").alias("e"))
        found = found.join(seen.withColumnRenamed("id", "b"), "b", "left_anti").select(F.col("b").alias("id"), F.lit(hop).alias("hop"), "e.relation_type", "e.confidence")
        out = found if out is None else out.unionByName(found)
        front = found.select("id")
        seen = seen.union(front)
    return out
