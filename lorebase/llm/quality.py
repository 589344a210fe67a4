"""Quality rules with cutoffs that adapt to each language and source.

Built of DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, materialize, sent_if_few

#: Base rules: fewest words, and most repeated words in percent.
MIN_WORDS, MAX_REPEAT, GRAM = 20, 30, 8
#: Measures with cutoffs, in thousandths: of what size one unit of each is a share,
#: and whether low values are out of line as well.
MEASURES = {"symbols": ("n_words", False), "word_length": ("n_words", True), "dup_lines": ("_n_lines", False)}
SIZES = ("n_words", "_n_lines")
#: A value is out of line so many spreads beyond the quartiles.
REACH = 4
#: Documents that a group's language, and a language's all documents, count for
#: beside the group's own, and the units in which documents are counted.
PRIOR, UNIT = 50, 1000
#: Significant bits of a sketch's buckets: quantiles are off by less than 1/64.
BITS = 7


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    A null text counts as empty. n_repeat_words are the words in windows of 8
    words that the text holds twice or more, the first included: windows are
    hashed, and only where a hash repeats are they sorted by hash to find the
    positions that have an equal neighbour.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.withColumn("_t", text).withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("_l", lines)
    window = F.transform(F.sequence(F.lit(0), F.size("_w") - GRAM), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(GRAM)]))
    d = d.withColumn("_h", F.when(F.size("_w") >= GRAM, window).otherwise(F.array().cast("array<bigint>")))
    placed = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))

    def again(x: Column, k: Column) -> Column:
        return (F.get(F.col("_p"), k - 1)["h"].eqNullSafe(x["h"])) | (F.get(F.col("_p"), k + 1)["h"].eqNullSafe(x["h"]))

    d = d.withColumn("_r", F.sort_array(F.transform(F.filter("_p", again), lambda x: x["i"])))
    cover = F.transform("_r", lambda x, k: F.least(F.lit(GRAM), F.coalesce(F.get(F.col("_r"), k + 1) - x, F.lit(GRAM))))
    d = d.select(
        *[c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("_n_lines"),
        F.aggregate(cover, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def _thousandths() -> dict[str, Column]:
    return {
        "symbols": F.expr("1000 * n_symbols div greatest(n_words, 1)"),
        "word_length": F.expr("1000 * word_chars div greatest(n_words, 1)"),
        "dup_lines": F.expr("1000 * n_dup_lines div greatest(_n_lines, 1)"),
    }


def bucket(value: Column) -> Column:
    """The lower end of a value's bucket: its BITS leading bits, so the width
    grows with the value."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return value - F.pmod(value, unit)


def quantile_sketches(measured: DataFrame, groups: tuple[str, str]) -> DataFrame:
    """Histograms with logarithmic buckets: (lang, source, measure, bucket, n),
    of the measures and of the sizes that they are shares of.

    Two such sketches merge by adding counts, which partial aggregation does
    before the shuffle; a group has some hundred rows however many documents.
    """
    values = _thousandths() | {c: F.col(c) for c in SIZES}
    stacked = measured.select(
        *[F.col(g) for g in groups],
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(v).alias("bucket")) for m, v in values.items()])).alias("x"),
    )
    return stacked.groupBy(*groups, F.col("x.measure").alias("measure"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def _with_prior(own: DataFrame, wider: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """The sketches ``own`` (keys, measure, bucket, n) with those of the wider
    group that they belong to (by ``on``) added as PRIOR documents."""
    size = wider.groupBy(*on, "measure").agg(F.sum("n").alias("_all"))
    w = wider.join(size.select(*[F.col(k).alias(f"_{k}") for k in on], F.col("measure").alias("_m"), "_all"), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on], F.col("measure") == F.col("_m")))
    w = w.select(*[F.col(k).alias(f"_{k}") for k in on], F.col("measure").alias("_m"), "bucket", F.expr(f"{PRIOR * UNIT} * n div _all").alias("n"))
    each = own.select(*keys, "measure").distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on], F.col("measure") == F.col("_m"))
    return own.unionByName(each.join(w, same).select(*keys, "measure", "bucket", "n")).groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def adaptive_cutoffs(sketches: DataFrame, groups: tuple[str, str]) -> DataFrame:
    """(lang, source, measure, low, high): REACH spreads beyond the quartiles of
    each group's sketch.

    The spread is that between the quartiles, or what one unit (one symbol, one
    line) makes in a document of the group's median size, if that is more. To
    its own documents a group adds PRIOR ones of its language's sketch, and that
    PRIOR ones of all documents', so small groups lean on wider ones and large
    ones stand for themselves, without a size at which that changes.
    """
    lang, source = groups
    own = sketches.withColumn("n", F.col("n") * UNIT)
    langs = own.groupBy(lang, "measure", "bucket").agg(F.sum("n").alias("n"))
    every = own.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    h = _with_prior(own, _with_prior(langs, every, [lang], []), [lang, source], [lang])
    by = Window.partitionBy(lang, source, "measure")
    h = h.withColumn("_c", F.sum("n").over(by.orderBy("bucket"))).withColumn("_all", F.sum("n").over(by))
    q = h.groupBy(lang, source, "measure").agg(*[F.min(F.when(100 * F.col("_c") >= p * F.col("_all"), F.col("bucket"))).alias(f"q{p}") for p in (25, 50, 75)])
    size = q.where(F.col("measure").isin(*SIZES)).select(F.col(lang).alias("_g1"), F.col(source).alias("_g2"), F.col("measure").alias("_size"), F.col("q50").alias("_median"))
    name = F.col("measure")
    of = F.coalesce(*[F.when(name == m, F.lit(v[0])) for m, v in MEASURES.items()])
    both = F.coalesce(*[F.when(name == m, F.lit(v[1])) for m, v in MEASURES.items()])
    j = q.where(name.isin(*MEASURES)).withColumn("_of", of)
    j = j.join(size, j[lang].eqNullSafe(size["_g1"]) & j[source].eqNullSafe(size["_g2"]) & (F.col("_of") == F.col("_size")))
    reach = REACH * F.greatest(F.col("q75") - F.col("q25"), F.expr("1000 div greatest(_median, 1)"))
    return j.select(lang, source, "measure", F.when(both, F.col("q25") - reach).otherwise(F.lit(-1)).cast("long").alias("low"), (F.col("q75") + reach).cast("long").alias("high"))


def judge(measured: DataFrame, groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Adds kept (boolean) to rows of ``text_measures`` that were written or are
    cheap to read twice.

    Sketches are taken over the rows that pass the base rules; a row is kept if
    it passes them and each measure lies within its group's cutoffs. Null
    languages and sources are groups. If no row passes the base rules, none is
    kept.
    """
    lang, source = groups
    cut = adaptive_cutoffs(materialize(quantile_sketches(measured.where(~F.col("base_failed")), groups), "quality-sketches"), groups)
    wide = cut.groupBy(F.col(lang).alias("_g1"), F.col(source).alias("_g2")).agg(
        *[F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"_{m}_{e}") for m in MEASURES for e in ("low", "high")]
    )
    wide = sent_if_few(materialize(wide, "quality-cutoffs"))
    j = measured.join(wide, measured[lang].eqNullSafe(wide["_g1"]) & measured[source].eqNullSafe(wide["_g2"]), "left")
    ok = ~F.col("base_failed")
    for m, v in _thousandths().items():
        ok = ok & v.between(F.col(f"_{m}_low"), F.col(f"_{m}_high"))
    return j.withColumn("kept", F.coalesce(ok, F.lit(False))).drop("_g1", "_g2", *[f"_{m}_{e}" for m in MEASURES for e in ("low", "high")])


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged.

    Texts are measured once and written with the measures. An empty table gives
    an empty table; repeated rows are judged alike; a very long text is measured
    whole, by one task; columns of any other name may be there.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang", "source")
    measured = materialize(text_measures(inner).drop("text"), "quality")
    return judge(measured).where("kept").select("_row.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    measured = materialize(text_measures(docs).drop("text"), "quality")
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), x AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM w
), g AS (
  SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM x WHERE len(ws) >= 8)
), dup AS (
  SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(8)) AS k) GROUP BY rid
), m AS (
  SELECT x.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM x LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), v AS (
  SELECT rid, lang, source, base_failed, 'symbols' AS measure, 1000 * n_symbols // greatest(n_words, 1) AS v FROM b
  UNION ALL SELECT rid, lang, source, base_failed, 'word_length', 1000 * word_chars // greatest(n_words, 1) FROM b
  UNION ALL SELECT rid, lang, source, base_failed, 'dup_lines', 1000 * n_dup_lines // greatest(n_lines, 1) FROM b
  UNION ALL SELECT rid, lang, source, base_failed, 'n_words', n_words FROM b
  UNION ALL SELECT rid, lang, source, base_failed, 'n_lines', n_lines FROM b
), h AS (
  SELECT lang, source, measure, v - v % CAST(2 ** greatest(length(bin(v)) - 7, 0) AS BIGINT) AS bucket, 1000 * count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL
), ha AS (
  SELECT measure, bucket, 50000 * sum(n) // any_value(t) AS n FROM h JOIN (SELECT measure, sum(n) AS t FROM h GROUP BY measure) USING (measure) GROUP BY measure, bucket
), hl AS (
  SELECT lang, measure, bucket, sum(n) AS n FROM (SELECT lang, measure, bucket, n FROM h UNION ALL SELECT g.lang, g.measure, bucket, n FROM (SELECT DISTINCT lang, measure FROM h) g JOIN ha ON g.measure = ha.measure) GROUP BY ALL
), lt AS (
  SELECT lang, measure, sum(n) AS t FROM hl GROUP BY ALL
), lw AS (
  SELECT hl.lang, hl.measure, bucket, 50000 * n // t AS n FROM hl JOIN lt ON hl.lang IS NOT DISTINCT FROM lt.lang AND hl.measure = lt.measure
), hg AS (
  SELECT lang, source, measure, bucket, sum(n) AS n FROM (SELECT * FROM h UNION ALL
    SELECT g.lang, g.source, g.measure, bucket, n FROM (SELECT DISTINCT lang, source, measure FROM h) g JOIN lw ON g.lang IS NOT DISTINCT FROM lw.lang AND g.measure = lw.measure) GROUP BY ALL
), r AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS k, sum(n) OVER (PARTITION BY lang, source, measure) AS t FROM hg
), q AS (
  SELECT lang, source, measure, min(CASE WHEN 100 * k >= 25 * t THEN bucket END) AS q25,
         min(CASE WHEN 100 * k >= 50 * t THEN bucket END) AS q50, min(CASE WHEN 100 * k >= 75 * t THEN bucket END) AS q75
  FROM r GROUP BY ALL
), c AS (
  SELECT q.lang, q.source, q.measure, q.q25, q.q75, 4 * greatest(q.q75 - q.q25, 1000 // greatest(z.q50, 1)) AS reach
  FROM q JOIN q z ON q.lang IS NOT DISTINCT FROM z.lang AND q.source IS NOT DISTINCT FROM z.source AND z.measure = CASE q.measure WHEN 'dup_lines' THEN 'n_lines' ELSE 'n_words' END
  WHERE q.measure IN ('symbols', 'word_length', 'dup_lines')
), k AS (
  SELECT v.rid, bool_and(v.v <= q75 + reach AND (v.measure <> 'word_length' OR v.v >= q25 - reach)) AS ok
  FROM v JOIN c ON v.lang IS NOT DISTINCT FROM c.lang AND v.source IS NOT DISTINCT FROM c.source AND v.measure = c.measure GROUP BY v.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, false) AS kept
FROM b LEFT JOIN k USING (rid)
"""
