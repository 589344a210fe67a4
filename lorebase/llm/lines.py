"""Line dedup by winnowing over line hashes. Built of DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

#: Lines in a hashed gram.
GRAM = 2
#: Grams in a window; each window has its least gram selected, so a repeated
#: run of GRAM + WINDOW - 1 lines always shares a fingerprint with the first.
WINDOW = 3
#: Lines in the shortest run that is deleted.
LEAST = 1

HASHES = "array<struct<a:bigint,b:bigint>>"


def line_hashes(docs: DataFrame, id_col: str) -> DataFrame:
    """(_null, _id, _key, _h): a document's place and 128 bits of hash (so that no
    two of 10**15 lines are taken for one) of each of its lines that is not blank."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    h = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    return docs.select(F.col(id_col).isNull().alias("_null"), F.col(id_col).alias("_id"), "_key", F.coalesce(h, F.array().cast(HASHES)).alias("_h"))


def _hash(i: Column, n: int, part: str) -> Column:
    """Half of the hash of the ``n`` lines from line ``i`` on."""
    return F.get(F.col("_h"), i)[part] if n == 1 else F.xxhash64(*[F.get(F.col("_h"), i + k)[part] for k in range(n)])


def _starts(n: int) -> Column:
    """Places where ``n`` lines in a row begin."""
    return F.when(F.size("_h") >= n, F.sequence(F.lit(0), F.size("_h") - n)).otherwise(F.array().cast("array<int>"))


def _minima(window: int) -> Column:
    """Places in array _g, of (hash, place negated), that are the last least value of some window."""
    least = F.transform(F.sequence(F.lit(0), F.size("_g") - window), lambda i: -F.array_min(F.slice("_g", i + 1, window))["at"])
    return F.when(F.size("_g") >= window, F.array_distinct(least)).otherwise(F.transform("_g", lambda g: -g["at"]))


def _marks(lines: DataFrame, at: Column, n: int, reach: int = 0) -> DataFrame:
    """One row for each place in array ``at``: the document's place, the line, the
    hash of the ``n`` lines from there and the hashes of ``reach`` lines before and after."""

    def mark(i: Column) -> Column:
        start = F.greatest(i - reach, F.lit(0))
        beside = [F.slice("_h", start + 1, i - start).alias("left"), F.slice("_h", i + n + 1, reach).alias("right")] if reach else []
        return F.struct(i.alias("_i"), _hash(i, n, "a").alias("gram"), _hash(i, n, "b").alias("gram2"), *beside)

    return lines.select("_null", "_id", "_key", F.inline(F.transform(at, mark)))


def line_fingerprints(lines: DataFrame, gram: int, window: int) -> DataFrame:
    """One row per selected gram, with the hashes of the ``window - 1`` lines on either
    side: a run that holds this gram goes no farther without holding another."""
    d = lines.withColumn("_g", F.transform(_starts(gram), lambda i: F.struct(_hash(i, gram, "a").alias("a"), _hash(i, gram, "b").alias("b"), (-i).alias("at"))))
    return _marks(d, _minima(window), gram, window - 1)


def _shared(depth: int, at) -> Column:
    """How many of the first ``depth`` comparisons ``at`` hold without a gap."""
    out = F.lit(depth)
    for k in reversed(range(depth)):
        out = F.when(F.coalesce(at(k), F.lit(False)), out).otherwise(F.lit(k))
    return out


def _repeats(marks: DataFrame, n: int, reach: int, tag: str) -> DataFrame:
    """(_id, _key, start, end): the runs of lines that ``marks`` shares with the
    first place of its hash by (id, key, line), for all marks but that.

    The first place is combined before the shuffle, so a passage that a third of
    all documents share costs one row per place and no pairs; the match is then
    extended both ways by up to ``reach`` lines.
    """
    marks = materialize(marks, tag)
    place = F.struct("_null", "_id", "_key", "_i", *(["left", "right"] if reach else []))
    first = marks.groupBy(F.col("gram").alias("_k"), F.col("gram2").alias("_k2")).agg(F.min(place).alias("f"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # Written: an aggregate that feeds the join would share its partitioning, so that a frequent line could not be split.
    first = materialize(first, f"{tag}-first")
    j = marks.join(first, (F.col("gram") == F.col("_k")) & (F.col("gram2") == F.col("_k2"))).where((F.col("_key") != F.col("f._key")) | (F.col("_i") != F.col("f._i")) | ~F.col("_id").eqNullSafe(F.col("f._id")))
    back = _shared(reach, lambda k: F.get(F.col("left"), F.size("left") - 1 - k) == F.get(F.col("f.left"), F.size("f.left") - 1 - k))
    ahead = _shared(reach, lambda k: F.get(F.col("right"), F.lit(k)) == F.get(F.col("f.right"), F.lit(k)))
    return j.select("_id", "_key", (F.col("_i") - back).alias("start"), (F.col("_i") + n + ahead).alias("end"))


def _by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("_id", "_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def winnowed_runs(lines: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(_id, _key, runs): per document with such, the runs [start, end) of lines
    around a fingerprint that an earlier place holds as well.

    ``lines`` is what ``line_hashes`` gives. Every repeated run of ``gram + window - 1``
    lines has a fingerprint and so a match; as each is compared with one earlier
    place only, and shorter runs may have none, ``remaining_runs`` finds the rest.
    """
    return _by_document(_repeats(line_fingerprints(lines, gram, window), gram, window - 1, "lines-marks"))


def remaining_runs(lines: DataFrame, runs: DataFrame, least: int = LEAST) -> DataFrame:
    """(_id, _key, start, end): the runs of ``least`` lines outside all ``runs``
    that an earlier place holds as well.

    What lies within one of ``runs`` repeats an earlier place, so the first place of
    any ``least`` lines never does: it is enough to compare those outside with each
    other, and none is missed.
    """
    d = lines.join(runs.select(F.col("_key").alias("_k"), F.col("_id").alias("_d"), "runs"), (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d")), "left")
    inside = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["end"] - least)))
    outside = F.array_except(_starts(least), F.coalesce(inside, F.array().cast("array<int>")))
    return _repeats(_marks(d, outside, least), least, 0, "lines-rest")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", gram: int = GRAM, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(_id, _key, runs): per document with repeats, its runs [start, end) of
    lines (blank ones not counted) that an earlier place holds as well; each
    ``least`` lines in a row that do so lie in one of them.

    ``docs`` has text, ``id_col`` and _key, a hash of both. Runs are found by
    winnowing and, outside of these, by comparing all that is left.
    """
    lines = materialize(line_hashes(docs, id_col), "lines")
    runs = materialize(winnowed_runs(lines, max(gram, least), window), "lines-runs")
    return _by_document(runs.select("_id", "_key", F.inline("runs")).union(remaining_runs(lines, runs, least)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", gram: int = GRAM, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(_doc, text, n_lines, dropped): each row of ``docs`` (its other columns in
    a struct) with its text after deletion, its number of lines that are not blank and the numbers of
    those deleted.

    A line is deleted if it lies in a run of ``least`` lines or more that repeats
    an earlier run (by id, nulls last); at 1 that is every line that stands
    earlier. ``gram`` (``least`` at the least) and ``window`` change the work and not the
    result. The first place of a run is never deleted.
    A null text gives null and no lines; empty texts stay; blank lines stay and
    do not break runs; very long lines are compared by their hash. Columns of any
    name stay as they are. Rows that repeat id and text are one document and get the
    same text; of different texts with one id the one with the lower hash counts
    as the earlier.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    kept = docs.select(F.struct(*rest).alias("_doc"), F.col("text").cast("string").alias("text"), F.col(id_col).alias(id_col)).withColumn("_key", F.xxhash64(id_col, "text"))
    runs = repeated_runs(kept, id_col, gram, window, least).select(F.col("_key").alias("_k"), F.col("_id").alias("_d"), "runs")
    j = kept.join(runs, (F.col("_key") == F.col("_k")) & F.col(id_col).eqNullSafe(F.col("_d")), "left")
    j = j.withColumn("_lines", F.split("text", "\n"))
    full = F.filter(F.transform("_lines", lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda s: F.regexp_like(s["x"], F.lit(r"[^\x20\x09-\x0D]")))
    j = j.withColumn("_at", F.transform(full, lambda s: s["k"]))
    gone = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["end"] - 1))))
    j = j.withColumn("dropped", F.coalesce(F.sort_array(gone), F.array().cast("array<int>")))
    j = j.withColumn("_stay", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.transform("dropped", lambda k: F.get(F.col("_at"), k))))
    text = F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(F.transform("_stay", lambda k: F.get(F.col("_lines"), k)), "\n"))
    return j.select("_doc", text.alias("text"), F.coalesce(F.size("_at"), F.lit(0)).alias("n_lines"), "dropped")


def drop_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with shortened texts, columns unchanged; documents that had
    lines and lost all of them are dropped. A column n_chars follows the text."""
    out = dedup_lines(docs, **how)
    out = out.where((F.col("n_lines") == 0) | (F.size("dropped") < F.col("n_lines")))
    size = F.length("text").cast("long")
    new = {"text": F.col("text"), "n_chars": F.when(F.size("dropped") > 0, size).otherwise(F.col("_doc.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"_doc.`{c}`") for c in docs.columns])


def op4_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    numbers = F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",")
    return out.select("_doc.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), numbers.alias("dropped"), F.md5("text").alias("text_md5"))
