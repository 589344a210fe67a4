"""Substring dedup: content-defined chunks that are deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .common import materialize

#: Bytes that the rolling hash sees, and the least distance of two cuts.
GEAR = 16
#: One place in so many is a candidate for a cut.
ONE_IN = 16
#: Words of a passage that counts as repeated, and of an anchor. Of the anchors in
#: a passage of MIN_WORDS that have at least GEAR bytes of it, WINDOW are in a row,
#: and each WINDOW in a row have their least gear hash selected.
MIN_WORDS, ANCHOR = 50, 20
WINDOW = MIN_WORDS - ANCHOR + 1
#: Odd base of the polynomial hash that tells byte strings.
BASE = 0x9E3779B97F4A7C15
#: Stands for a null id.
NO_ID = (1 << 63) - 1
SPACES = (9, 10, 11, 12, 13, 32)


def gear_table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """At each byte the gear hash h = 2h + gear[byte] of the GEAR bytes up to it.

    A hash of 2k bytes is that of the last k plus that of the k before, shifted
    by k, so four doublings make 16. The first GEAR - 1 places are unfinished.
    """
    h, k = gear[data], 1
    while k < GEAR:
        older = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += older
        k *= 2
    return h


def chunks(data: np.ndarray, offsets: np.ndarray, gear: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of each chunk of the documents data[offsets[i]:offsets[i + 1]].

    A place is a candidate by the GEAR bytes before it, and a cut if no other
    candidate lies in the GEAR bytes before. Cuts depend on the 2 * GEAR bytes
    before them and on nothing else, so they move with the text.
    """
    at = np.nonzero(gear_hash(data, gear) >> np.uint32(28) == 0)[0] if len(data) >= GEAR else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, at, "right") - 1
    full = at - offsets[doc] >= GEAR - 1
    at, doc = at[full], doc[full]
    near = np.zeros(len(at), bool)
    near[1:] = (np.diff(at) <= GEAR) & (doc[1:] == doc[:-1])
    cuts = np.unique(np.concatenate([at[~near] + 1, offsets]))
    starts, ends = cuts[:-1], cuts[1:]
    owner = np.searchsorted(offsets, starts, "right") - 1
    return owner, starts, ends


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, document) of each word of the documents data[offsets[i]:offsets[i + 1]]."""
    is_space = np.zeros(256, bool)
    is_space[list(SPACES)] = True
    space = is_space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends with its document
    inner = edge[:-1]
    begins = ~space & (inner | np.concatenate([[True], space[:-1]]))
    ends = ~space & (edge[1:] | np.concatenate([space[1:], [True]]))
    at = np.nonzero(begins)[0]
    return at, np.nonzero(ends)[0] + 1, np.searchsorted(offsets, at, "right") - 1


def anchors(data: np.ndarray, ends: np.ndarray, doc: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The last words of the selected anchors: of each WINDOW places in a row the
    one of the least gear hash, the last of equal ones.

    A place's hash sees the GEAR bytes before it, which ANCHOR words hold, so
    whatever text stands around it, however monotonous it is, two copies of a
    passage of MIN_WORDS words have an anchor in common.
    """
    if len(ends) < MIN_WORDS:
        return np.zeros(0, np.int64)
    h = gear_hash(data, gear)[ends - 1].astype(np.uint64) << np.uint64(32)
    h |= np.uint64((1 << 32) - 1) - np.arange(len(ends), dtype=np.uint64)
    low = np.arange(len(ends) - MIN_WORDS + 1)
    low = low[doc[low] == doc[low + MIN_WORDS - 1]]
    if not len(low):
        return low
    least = np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(1)[low + ANCHOR - 1]
    return np.unique(((1 << 32) - 1) - (least & np.uint64((1 << 32) - 1)).astype(np.int64))


def span_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[lo:hi]: a polynomial over random values of the bytes."""
    values = np.random.Generator(np.random.PCG64(20240301)).integers(0, 1 << 64, 256, dtype=np.uint64)
    with np.errstate(over="ignore"):

        def powers(base: int) -> np.ndarray:
            return np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), base, np.uint64)]), dtype=np.uint64)

        total = np.concatenate([[np.uint64(0)], np.cumsum(values[data] * powers(BASE)[:-1], dtype=np.uint64)])
        x = (total[hi] - total[lo]) * powers(pow(BASE, -1, 1 << 64))[lo]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))).view(np.int64)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = [t.as_py() or b"" for t in column.cast(pa.binary())]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def anchor_table(texts: DataFrame) -> DataFrame:
    """(gram, _same, at): hash and last word of each anchor of each whole text."""
    gear = gear_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                b = whole.slice(low, 500)
                data, offsets = _texts(b.column(1))
                if len(data) < GEAR:
                    continue
                begins, ends, doc = word_places(data, offsets)
                last = anchors(data, ends, doc, gear)
                if not len(last):
                    continue
                first = np.searchsorted(doc, np.arange(b.num_rows))
                gram = span_hashes(data, begins[last - ANCHOR + 1], ends[last])
                yield pa.RecordBatch.from_arrays([pa.array(gram), b.column(0).take(pa.array(doc[last])), pa.array((last - first[doc[last]]).astype(np.int32))], names=["gram", "_same", "at"])

    return texts.select("_same", "text").mapInArrow(run, "gram long, _same long, at int")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, _same, text), _same a hash of the text. Rows that repeat id and text are one document; a null
    id comes last, as the largest long. Ids are whole numbers."""
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is no column of whole numbers")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.col(id_col), text).alias("_key"), F.xxhash64(text).alias("_same"), text.alias("text"))


SPANS = "_id long, _key long, first_id long, lo int, hi int, words int"


def _spans(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] * 3
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in SPANS.split(", ")])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every MIN_WORDS words in a row that hold one of the document's repeated anchors."""
    for whole in batches:
        for low in range(0, whole.num_rows, 200):
            b = whole.slice(low, 200)
            data, offsets = _texts(b.column(3))
            begins, ends, doc = word_places(data, offsets)
            first = np.searchsorted(doc, np.arange(b.num_rows + 1))
            chosen = np.zeros(len(ends) + 1, np.int64)
            for i, places in enumerate(b.column(2)):
                last = np.array(places.as_py(), np.int64)
                from_ = np.maximum(last - MIN_WORDS + 1, 0)
                to = np.minimum(last - ANCHOR + 1, first[i + 1] - first[i] - MIN_WORDS) + 1
                np.add.at(chosen, first[i] + from_, 1)
                np.add.at(chosen, first[i] + np.maximum(to, from_), -1)
            at = np.nonzero(np.cumsum(chosen[:-1]) > 0)[0]
            if not len(at):
                continue
            lo, hi, owner = begins[at], ends[at + MIN_WORDS - 1], doc[at]
            rows, zero = pa.array(owner), offsets[owner]
            cols = [(at - first[owner]).astype(np.int32), (lo - zero).astype(np.int32), (hi - zero).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(span_hashes(data, lo, hi)), b.column(0).take(rows), b.column(1).take(rows), *map(pa.array, cols)], names=["win", "_id", "_key", "at", "lo", "hi"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring windows whose first places are neighbours as well."""
    for whole in batches:
        for low in range(0, whole.num_rows, 50):
            out = []
            for r in whole.slice(low, 50).to_pylist():
                last = None
                for p in sorted(r["parts"], key=lambda p: p["at"]):
                    f = p["f"]
                    now = (f["_id"], f["_key"], f["at"] - p["at"])
                    if last and last[1:] == (p["at"], now):
                        out[-1][4:] = [p["hi"], out[-1][5] + 1]
                    else:
                        out.append([r["_id"], r["_key"], f["_id"], p["lo"], p["hi"], MIN_WORDS])
                    last = (None, p["at"] + 1, now)
            if out:
                yield _spans(out)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The span of all words of each text, if it has MIN_WORDS."""
    for b in batches:
        out = []
        for id_, key, first, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3).cast(pa.binary()), strict=True):
            raw = text.as_py()
            inner = raw.strip(bytes(SPACES))
            lo, n = len(raw) - len(raw.lstrip(bytes(SPACES))), len(inner.translate(_BLANK).split())
            if n >= MIN_WORDS:
                out.append([id_, key, first, lo, lo + len(inner), n])
        if out:
            yield _spans(out)


_BLANK = bytes.maketrans(bytes(SPACES), b" " * len(SPACES))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _key, first_id, lo, hi, words): byte spans of each text that the
    document first_id, an earlier one (by id, nulls last), holds whole. Every
    MIN_WORDS words in a row that any earlier document holds lie in such a span.

    A text equal to an earlier one is one span. The other texts are cut at
    content-defined anchors (see ``anchors``), which are grouped by digest; all
    windows of MIN_WORDS words around those in two texts or more are then
    grouped in turn, and the first place of each is combined before the shuffle
    and joined back: one row per window and document and no pairs. Windows that
    follow one another in both documents form a run.

    Null texts are empty, rows that repeat id and text are one document and no
    copy of each other, very long texts are read whole, columns of any other name
    may be there, an empty table gives an empty result.
    """
    texts = keyed(docs, id_col, text_col)
    doc = F.struct("_id", "_key")
    ids = materialize(texts.select("_same", "_id", "_key").distinct(), "passages-ids")
    leaders = materialize(ids.groupBy("_same").agg(F.min(doc).alias("l"), F.count("*").alias("n")), "passages-leaders")

    marks = materialize(anchor_table(texts), "passages")
    twice = marks.groupBy(F.col("gram").alias("_g")).agg(F.min("_same").alias("a"), F.max("_same").alias("z")).where("a <> z").select("_g")
    # A document's anchors are bounded by its own text.
    places = marks.join(twice, F.col("gram") == F.col("_g")).groupBy(F.col("_same").alias("_s")).agg(F.collect_set("at").alias("places"))
    asked = places.join(leaders, F.col("_s") == F.col("_same")).select(F.col("l._id").alias("a_id"), F.col("l._key").alias("a_key"), "places")
    asked = materialize(asked, "passages-asked")
    mine = (F.col("a_key") == F.col("_key")) & (F.col("a_id") == F.col("_id"))
    windows = materialize(texts.join(asked, mine).select("_id", "_key", "places", "text").mapInArrow(_windows, "win long, _id long, _key long, at int, lo int, hi int"), "passages-windows")

    first = windows.groupBy(F.col("win").alias("_w")).agg(F.min(F.struct("_id", "_key", "at")).alias("f"), F.max(doc).alias("_l"))
    first = first.where((F.col("_l._id") != F.col("f._id")) | (F.col("_l._key") != F.col("f._key"))).drop("_l")
    later = windows.join(first, F.col("win") == F.col("_w")).where((F.col("_id") != F.col("f._id")) | (F.col("_key") != F.col("f._key")))
    runs = later.groupBy("_id", "_key").agg(F.collect_set(F.struct("at", "lo", "hi", "f")).alias("parts")).mapInArrow(_runs, SPANS)

    copies = ids.join(leaders.where("n > 1").withColumnRenamed("_same", "_s"), F.col("_same") == F.col("_s")).where((F.col("_id") != F.col("l._id")) | (F.col("_key") != F.col("l._key")))
    copies = copies.select(F.col("_id").alias("a_id"), F.col("_key").alias("a_key"), F.col("l._id").alias("first_id"))
    equal = texts.join(copies, mine).select("_id", "_key", "first_id", "text").mapInArrow(_whole, SPANS).distinct()
    return runs.unionByName(equal)


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its later repeats of passages cut out of the texts; the
    columns stay, and a text left with a cut inside a word's bytes cannot occur,
    as spans are widened to the next white space."""
    spans = repeated_passages(docs, id_col, text_col).groupBy("_id", "_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    place = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = place
            out = []
            for text, spans in zip(b.column(i).to_pylist(), b.column("_spans").to_pylist(), strict=True):
                raw, kept, at = (text or "").encode(), [], 0
                for s in sorted(spans or [], key=lambda s: s["lo"]):
                    lo, hi = s["lo"], s["hi"]
                    while lo > 0 and lo < len(raw) and raw[lo] not in SPACES and raw[lo - 1] not in SPACES:
                        lo += 1
                    while hi < len(raw) and hi > lo and raw[hi] not in SPACES and raw[hi - 1] not in SPACES:
                        hi -= 1
                    if hi > max(lo, at):
                        kept.append(raw[at : max(lo, at)])
                        at = hi
                out.append(text if at == 0 and not kept else b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == i else b.column(k) for k in range(b.num_columns - 1)], names=b.schema.names[:-1])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    d = docs.select(row, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_named"), F.xxhash64(F.col(id_col), text).alias("_hash"))
    j = d.join(spans.withColumnRenamed("spans", "_spans"), (F.col("_hash") == F.col("_key")) & (F.col("_named") == F.col("_id")), "left")
    at = [f"_{k}" for k in range(len(docs.columns))]  # any names, however alike
    flat = j.select(*[F.col(f"_doc.`{c}`").alias(a) for c, a in zip(docs.columns, at, strict=True)], "_spans")
    named = StructType([StructField(a, f.dataType, True) for a, f in zip(at, docs.schema.fields, strict=True)])
    out = flat.mapInArrow(cut, named)
    return out.select(*[F.col(a).alias(c) for c, a in zip(docs.columns, at, strict=True)])


def op6_passages(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = found.groupBy("_id", "_key", "lo", "hi").agg(F.min("first_id").alias("first_doc_id"), F.max("words").cast("long").alias("n_words"))
    return best.select(F.nullif(F.col("_id"), F.lit(NO_ID)).alias("doc_id"), F.col("lo").cast("long").alias("start_byte"), F.col("hi").cast("long").alias("end_byte"), "n_words", F.nullif("first_doc_id", F.lit(NO_ID)).alias("first_doc_id"))
