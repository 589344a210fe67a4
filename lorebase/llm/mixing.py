"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, functions as F

from .common import materialize, ranked, sent_if_few, word_count

#: Copies are counted in units of 2**-SCALE, so that sums are exact.
SCALE = 28
#: A document of over 1/LARGE of its source's target counts as large, unless it is
#: 1/MANY of its source or less: so a source has fewer than MANY large ones.
LARGE, MANY = 200, 2000


def water_fill(sizes: dict, weights: dict, share: Fraction, cap: Fraction) -> dict:
    """Targets that share ``share`` times the total by weight, none above
    ``cap`` times its size; the excess goes to the others by weight."""
    left, open_, out = share * sum(sizes.values()), dict(weights), {}
    while open_:
        unit = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * unit > cap * sizes[s]]
        if not full:
            return out | {s: w * unit for s, w in open_.items()}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def offset(source: str | None, seed: int) -> int:
    """The one random offset of a source, in units of 2**-SCALE, from 0 to below 1."""
    key = f"{seed}:-" if source is None else f"{seed}:+{source}"
    return int(hashlib.md5(key.encode()).hexdigest()[: SCALE // 4], 16)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: Fraction = Fraction(3, 2),
    cap: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
) -> DataFrame:
    """Adds source_size, target (double) and copies (long) to ``docs``.

    ``size_col`` holds each row's size (null counts as 0). Sources in code-point
    order, null last, take ``weights`` in turn; ``water_fill`` gives their
    targets. Within a source the documents' expected copies are prefix-summed
    from the largest to the smallest, one random offset is added, and a document
    is emitted once for each integer boundary its interval crosses. A document
    expects target / source_size copies; but of large ones (see LARGE) this is
    rounded to whole copies, which no offset changes, and what the rounding
    leaves is carried to the next and at last shared by the others. These are
    small against the target, and in the order of size a systematic sample is
    off by one document at most: so the taken words come within 1/LARGE of the
    target wherever the small documents can make up for the large ones. No
    document has more than ``cap`` copies.

    Null sources form one source, null ids and repeated rows are documents like
    others (equal rows may swap places, which changes nothing), a source of size
    0 has target 0 and no copies, a very long text is a large size. An empty
    table gives an empty table. Columns of ``docs`` named like those added are
    replaced; names starting with ``_`` are reserved. The driver sees the source
    table, one row per source as in the caller's own configuration.
    """
    spark, one = docs.sparkSession, 1 << SCALE
    base = docs.drop("source_size", "target", "copies").withColumn("_size", F.coalesce(F.col(size_col), F.lit(0)).cast("long"))
    # Written with a number for each row, so that sizes are computed once and copies find their rows.
    base = materialize(base.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    sums = {r[0]: r[1] for r in base.groupBy(source_col).agg(F.sum("_size")).collect()}
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    targets = water_fill(sums, {s: weights[i % len(weights)] for i, s in enumerate(order)}, Fraction(share), Fraction(cap))
    rows = [(s, sums[s], float(targets.get(s, 0)), int(float(targets.get(s, 0)) / sums[s] * one) if sums[s] else 0, offset(s, seed)) for s in order]
    plan = spark.createDataFrame(rows, "_s string, source_size long, target double, _rate long, _offset long")
    at = F.col(source_col).eqNullSafe(F.col("_s"))
    timed = base.select(F.col(source_col), F.col(id_col), "_size", "_row").join(sent_if_few(plan), at)
    is_large = (F.col("_size") * LARGE > F.col("target")) & (F.col("_size") * MANY > F.col("source_size"))

    def whole(state, x):
        """Copies of the next large document: what is owed by now, in documents of its size."""
        owed = state["owed"] + x["size"] * state["rate"]
        n = F.least(F.greatest(F.floor(owed / (x["size"] * one) + 0.5), F.lit(0)), F.lit(cap)).cast("long")
        return F.struct(state["rate"].alias("rate"), (owed - n * x["size"] * one).alias("owed"), F.concat(state["out"], F.array(F.struct(x["row"].alias("row"), n.alias("copies")))).alias("out"))

    # Fewer than MANY entries of a source.
    order_ = F.struct((-F.col("_size")).alias("neg"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_size").alias("size"), F.col("_row").alias("row"))
    listed = timed.where(is_large).groupBy(F.col("_s").alias("_l")).agg(F.max("_rate").alias("_r"), F.array_sort(F.collect_list(order_)).alias("x"))
    none = F.array().cast("array<struct<row:bigint,copies:bigint>>")
    start = F.struct(F.col("_r").alias("rate"), F.lit(0).cast("long").alias("owed"), none.alias("out"))
    large = materialize(listed.select("_l", F.aggregate("x", start, whole).alias("z")).select("_l", "z.owed", "z.out"), "mix-large")

    # The rest: their own rate and what the large ones leave, shared by size.
    rest = ranked(timed.where(~is_large).select(source_col, id_col, "_size", "_row"), source_col, [F.col("_size").desc(), F.col(id_col).asc_nulls_last()], "mix")
    small = timed.where(~is_large).groupBy(F.col("_s").alias("_k")).agg(F.sum("_size").alias("_z"))
    due = plan.join(small, F.col("_s").eqNullSafe(F.col("_k"))).join(large.select("_l", "owed"), F.col("_s").eqNullSafe(F.col("_l")), "left")
    more = F.when(F.col("_z") > 0, F.floor(F.coalesce("owed", F.lit(0)).cast("double") / F.col("_z").cast("double"))).otherwise(0)
    due = materialize(due.select("_s", "_offset", F.least(F.greatest(F.col("_rate") + more, F.lit(0)), F.lit(cap * one)).cast("long").alias("_rate")), "mix-rates")
    mask = one - 1
    # Only the start's place between two boundaries matters, so a rank may be taken modulo 2**SCALE.
    begin = (F.col("_rank").bitwiseAND(mask) * F.col("_rate") + F.col("_offset")).bitwiseAND(mask)
    crossed = rest.join(sent_if_few(due), at).select("_row", F.shiftright(begin + F.col("_rate"), SCALE).alias("copies"))
    copies = crossed.unionByName(large.select(F.explode("out").alias("x")).select(F.col("x.row").alias("_row"), "x.copies"))
    out = base.join(copies, "_row").join(sent_if_few(plan), at)
    return out.select(*[c for c in base.columns if c not in ("_size", "_row")], "source_size", "target", "copies")


def sample_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` repeated by their copies: the mixture itself.

    Sizes are words of the text. Columns are those of ``docs``, whatever their
    names, with their own values; nulls and empty tables as in ``mix_sources``.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select(whole.alias("_doc"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    mixed = mix_sources(sized, **how).where("copies > 0")
    return mixed.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_doc.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), o AS (
  -- Sources fill up in the order of size per weight.
  SELECT *, row_number() OVER (ORDER BY source_size * 1.0 / weight, i) AS k FROM w
), p AS (
  SELECT *, 1.5 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM o
), c AS (
  SELECT *, min(CASE WHEN weight * remaining <= 2 * source_size * weights THEN k END) OVER () AS first_open FROM p
), t AS (
  SELECT source, source_size,
         CASE WHEN k < coalesce(first_open, 1000000000) THEN 2.0::DOUBLE * source_size
              ELSE (weight * max(CASE WHEN k = first_open THEN remaining END) OVER ())::DOUBLE
                   / (max(CASE WHEN k = first_open THEN weights END) OVER ())::DOUBLE END AS target FROM c
), u AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size * 268435456) AS BIGINT) END AS rate,
         ('0x' || substr(md5(CASE WHEN source IS NULL THEN '17:-' ELSE '17:+' || source END), 1, 7))::BIGINT AS off FROM t
), e AS (
  SELECT d.doc_id, d.source, d.size, u.source_size, u.target, u.rate, u.off, size * 200 > target AND size * 2000 > source_size AS large
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id NULLS LAST) AS rk FROM e WHERE large
), g AS (
  -- Whole copies of the large documents, one after another.
  SELECT source, rk, size * rate AS owed, CAST(least(greatest(floor(size * rate / (size * 268435456) + 0.5), 0), 2) AS BIGINT) AS copies, size FROM l WHERE rk = 1
  UNION ALL
  SELECT l.source, l.rk, g.owed - g.copies * g.size * 268435456 + l.size * l.rate,
         CAST(least(greatest(floor((g.owed - g.copies * g.size * 268435456 + l.size * l.rate) / (l.size * 268435456) + 0.5), 0), 2) AS BIGINT), l.size
  FROM g JOIN l ON l.source IS NOT DISTINCT FROM g.source AND l.rk = g.rk + 1
), o2 AS (
  SELECT source, arg_max(owed - copies * size * 268435456, rk) AS owed FROM g GROUP BY source
), z AS (
  SELECT source, sum(size) AS z FROM e WHERE NOT large GROUP BY source
), r AS (
  SELECT e.*, row_number() OVER (PARTITION BY e.source ORDER BY e.size DESC, doc_id NULLS LAST) - 1 AS rk,
         least(greatest(rate + CASE WHEN z > 0 THEN CAST(floor(coalesce(o2.owed, 0)::DOUBLE / z::DOUBLE) AS BIGINT) ELSE 0 END, 0), 536870912) AS own
  FROM e JOIN z ON e.source IS NOT DISTINCT FROM z.source LEFT JOIN o2 ON e.source IS NOT DISTINCT FROM o2.source WHERE NOT large
), x AS (
  SELECT doc_id, source, size, source_size, target, ((rk * own + off) % 268435456 + own) // 268435456 AS copies FROM r
  UNION ALL SELECT l.doc_id, l.source, l.size, source_size, target, copies FROM l JOIN g ON l.source IS NOT DISTINCT FROM g.source AND l.rk = g.rk
)
SELECT doc_id, source, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM x
"""
