"""FTS-02: the stored search index: segments of posting blocks, of which a search
reads those that can hold one of the best hits."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from . import search

#: Units of a block. Blocks of all terms end at the same units, so bounds of a window's blocks add up.
WINDOW = 1024
#: Windows of a shard; a term of over HOT postings is split by these among buckets.
SHARD, HOT = 256, 1 << 20
#: Postings of a bucket, about.
BUCKET = 1 << 24
#: Windows that are read first, to learn what the best hits score at least.
FIRST = 32
BLOCKS = "term string, window long, n int, top_tf int, least_dl int, at array<int>, tfs array<int>, dls array<int>, bucket int"
#: Units whose words a task counts at once.
UNITS = 200
#: Segments that may pile up before they are merged.
SEGMENTS = 8


def _postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units with their words to a row per unit and distinct word."""
    for b in (whole.slice(at, UNITS) for whole in batches for at in range(0, whole.num_rows, UNITS)):
        words = b.column("words")
        coded = words.flatten().dictionary_encode()
        unit = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        if not len(coded):
            continue
        size = len(coded.dictionary)
        both, tf = np.unique(unit * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        at, term = pa.array(both // size), pa.array(both % size)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(term), b.column("ord").take(at), b.column("dl").take(at), pa.array(tf.astype(np.int32))], ["term", "ord", "dl", "tf"])


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings by bucket, term and ord to blocks: those of one term and window that follow one another."""
    for b in batches:
        if not b.num_rows:
            continue
        ord_, tf, dl, bucket = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "tf", "dl", "bucket"))
        window, term = ord_ // WINDOW, b.column("term").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (window[1:] != window[:-1]) | (bucket[1:] != bucket[:-1])])
        ends = pa.array(np.r_[first, b.num_rows].astype(np.int32))
        listed = lambda x: pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32)))  # noqa: E731, B023
        sizes = np.diff(np.r_[first, b.num_rows]).astype(np.int32)
        cols = [b.column("term").take(pa.array(first)), pa.array(window[first]), pa.array(sizes), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl, first)), listed(ord_ % WINDOW), listed(tf), listed(dl), pa.array(bucket[first])]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in BLOCKS.split(", ")])


class Index:
    """Segments under ``path``. Each has ``units`` (ord, dl, words, terms and the
    caller's columns but for title and body), ``blocks`` in buckets (term, window, n, top_tf,
    least_dl and, as arrays, the units' places in the window, tf and length), ``hot``
    (term) and ``gone``: units of earlier segments that it replaces, with their words.

    ``update`` writes a segment and touches no other; ``merge`` makes one of all.
    Segments are named in ``segments``, one version per change, written last.
    """

    def __init__(self, spark: SparkSession, path: str, segments: list[tuple[str, int, int, int, int]] | None = None, version: int = 0):
        self.spark, self.path, self.segments, self.version = spark, path.rstrip("/"), segments or [], version

    @classmethod
    def build(cls, units: DataFrame, path: str) -> Index:
        out = cls(units.sparkSession, path)
        out._add(cls._words(units), None)
        return out

    @staticmethod
    def _words(units: DataFrame) -> DataFrame:
        return search.spread(units).withColumn("words", tx.tokens(F.concat_ws(" ", "title", "body"))).drop("title", "body")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The index as its last finished change left it."""
        named = spark.read.parquet(f"{path.rstrip('/')}/segments")
        last = named.agg(F.max("version")).first()[0]
        rows = named.where(F.col("version") == last).orderBy("place").collect()
        return cls(spark, path, [(r["name"], r["buckets"], r["n"], r["words"], r["gone"]) for r in rows if r["name"]], last)

    def _add(self, units: DataFrame, gone: DataFrame | None, instead: bool = False) -> None:
        name = uuid.uuid4().hex
        at = f"{self.path}/{name}"
        numbered = units.withColumns({"ord": F.monotonically_increasing_id(), "dl": F.size("words"), "terms": F.size(F.array_distinct("words"))})
        numbered.write.parquet(f"{at}/units")
        own = self.spark.read.parquet(f"{at}/units")
        n, words, posted = own.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        buckets = max(1, math.ceil(posted / BUCKET))
        sizes = own.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n")) if buckets > 1 else self.spark.createDataFrame([], "term string, n long")
        sizes.where(F.col("n") > HOT).select("term").write.parquet(f"{at}/hot")
        hot = self.spark.read.schema("term string").parquet(f"{at}/hot").withColumn("hot", F.lit(True))
        posts = own.select("ord", "dl", "words").mapInArrow(_postings_of, "term string, ord long, dl int, tf int")
        shard = F.floor(F.col("ord") / (SHARD * WINDOW))
        bucket = F.pmod(F.when(F.col("hot"), F.xxhash64("term", shard)).otherwise(F.xxhash64("term")), F.lit(buckets)).cast("int")
        posts = posts.join(F.broadcast(hot), "term", "left").withColumn("bucket", bucket).drop("hot")  # one hot term per HOT postings
        each = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
        dealt = posts.repartitionById(buckets * each, (F.col("bucket") * each + F.pmod(F.xxhash64("term", F.lit(1)), F.lit(each))).cast("int"))
        blocks = dealt.sortWithinPartitions("bucket", "term", "ord").mapInArrow(_blocks_of, BLOCKS)
        blocks.write.partitionBy("bucket").parquet(f"{at}/blocks")
        lost = 0
        if gone is not None:
            gone.write.parquet(f"{at}/gone")
            lost = self.spark.read.parquet(f"{at}/gone").count()
        row = (name, buckets, n, int(words), lost)
        old, self.segments = self.segments, [row] if instead else [*self.segments, row]
        self._name_segments()
        if instead:
            for x in old:
                search.drop_folder(self.spark, f"{self.path}/{x[0]}")

    def _name_segments(self) -> None:
        self.version += 1
        rows = [(self.version, k, *x) for k, x in enumerate(self.segments)] or [(self.version, 0, None, 0, 0, 0, 0)]
        self.spark.createDataFrame(rows, "version int, place int, name string, buckets int, n long, words long, gone long").coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def update(self, units: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Adds ``units`` in place of those of the same unit_id, and takes away those
        of ``removed`` (unit_id). Writes one segment and rewrites none."""
        ids = [x.select("unit_id") for x in (units, removed) if x is not None]
        dead = self._live_units().join((ids[0] if len(ids) == 1 else ids[0].union(ids[1])).distinct(), "unit_id", "left_semi")
        words = self._live_units().drop("segment", "ord", "dl", "terms").limit(0) if units is None else self._words(units)
        self._add(words, dead.select("segment", "ord", "dl", F.array_distinct("words").alias("words")))
        if len(self.segments) > SEGMENTS:
            self.merge()

    def merge(self) -> None:
        """All segments as one, from the words that they keep."""
        self._add(self._live_units().drop("segment", "ord", "dl", "terms"), None, instead=True)

    def _every(self, what: str) -> DataFrame | None:
        out = None
        for name, *_, gone in self.segments:
            if what == "gone" and not gone:
                continue
            own = self.spark.read.parquet(f"{self.path}/{name}/{what}")
            own = own if what == "gone" else own.withColumn("segment", F.lit(name))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._every("gone")
        return rows if gone is None else rows.join(gone.select("segment", "ord"), ["segment", "ord"], "left_anti")

    def _live_units(self) -> DataFrame:
        return self._live(self._every("units"))

    def units(self) -> DataFrame:
        """The units that are there, without their title and body."""
        return self._live_units().drop("segment", "ord", "dl", "words", "terms")

    def blocks(self) -> DataFrame:
        """All blocks, those of units that are gone included."""
        return self._blocks(["*"])

    def _blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of ``terms``: from a term's own bucket, or all that a hot term or a prefix may be in."""
        wanted = F.lit(False)
        for t in terms:
            wanted = wanted | search._matches(t, F.col("term"))
        out = None
        for name, buckets, *_ in self.segments:
            own = self.spark.read.schema(BLOCKS).parquet(f"{self.path}/{name}/blocks").withColumn("segment", F.lit(name)).where(wanted)
            if buckets > 1 and not any(t.endswith("*") for t in terms):
                named = self.spark.createDataFrame([(t,) for t in terms], "term string")
                if self.spark.read.schema("term string").parquet(f"{self.path}/{name}/hot").join(named, "term", "left_semi").isEmpty():
                    places = named.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).collect()  # one per word of the query
                    own = own.where(F.col("bucket").isin(sorted({r["b"] for r in places})))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out

    def bm25(self, query: str, unit_types: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """As ``search.bm25``. With ``limit`` at least the best so many hits, by
        score and then unit_id, are among the result, and only windows of units are
        read whose greatest score can reach these."""
        every, without = search.match(query)
        none = self.units().where("false").withColumn("score", F.lit(0.0))
        n, words = sum(x[2] for x in self.segments), sum(x[3] for x in self.segments)
        terms = [*(t for x in every for t in x), *without]
        gone = self._every("gone")
        if gone is not None:
            lost = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), *[F.count_if(F.exists("words", search._is(t))) for t in terms]).first()
            n, words = n - lost[0], words - lost[1]
        if not every or not n:
            return none
        blocks, k = self._blocks(terms), len(terms) - len(without)
        of = lambda t: search._matches(t, F.col("term"))
        heads = blocks.select("segment", "window", "term", "n", "top_tf", "least_dl")
        single = [not t.endswith("*") for t in terms]
        held = heads.agg(*[F.coalesce(F.sum(F.when(of(t), F.col("n"))), F.lit(0)) for t in terms[:k]]).first()
        df = [held[i] - (lost[2 + i] if gone is not None else 0) for i in range(k)]
        if not all(single[:k]):  # a unit may hold several words of one prefix
            each = self._live(self._postings(blocks, terms)).agg(*[F.count_if(F.col(f"_tf{i}") > 0) for i in range(k)]).first()
            df = list(each)
        idf = [math.log((n - d + 0.5) / (d + 0.5)) if d <= n / 2 else 0.0 for d in df]
        idf = [x if x > 0 else search.LEAST_IDF for x in idf]

        def score(tf: list[Column], dl: list[Column]) -> Column:
            out = F.lit(0.0)
            for i in range(k):
                t = tf[i].cast("double")
                out = out + F.coalesce(F.lit(idf[i]) * t * (search.K1 + 1) / (t + search.K1 * (1 - search.B + search.B * dl[i] / F.lit(words / n))), F.lit(0.0))
            return out

        def matched(tf: list[Column]) -> Column:
            out, at = F.lit(True), 0
            for x in every:
                out = out & (F.greatest(F.lit(0), *tf[at : at + len(x)]) > 0)
                at += len(x)
            return out

        tfs = [F.col(f"_tf{i}") for i in range(len(terms))]

        def hits(own: DataFrame) -> DataFrame:
            found = self._live(self._postings(own, terms)).where(matched(tfs))
            for i in range(k, len(terms)):
                found = found.where(tfs[i] == 0)
            found = found.select("segment", "ord", score(tfs, [F.col("_dl")] * k).alias("score"))
            if unit_types:
                found = found.join(self._every("units").where(F.col("unit_type").isin(unit_types)).select("segment", "ord"), ["segment", "ord"], "left_semi")
            return found

        chosen = blocks
        if limit is not None:
            top = [F.coalesce(F.sum(F.when(of(t), F.col("top_tf"))), F.lit(0)).alias(f"_tf{i}") for i, t in enumerate(terms)]
            low = [F.min(F.when(of(t), F.col("least_dl"))).alias(f"_low{i}") for i, t in enumerate(terms[:k])]
            windows = heads.groupBy("segment", "window").agg(*top, *low).where(matched(tfs)).select("segment", "window", score(tfs, [F.col(f"_low{i}") for i in range(k)]).alias("bound"))
            first = windows.orderBy(F.desc("bound")).limit(FIRST).collect()
            if not first:
                return none
            if len(first) == FIRST:
                seen = self.spark.createDataFrame([(r["segment"], r["window"]) for r in first], "segment string, window long")
                best = hits(blocks.join(F.broadcast(seen), ["segment", "window"], "left_semi")).orderBy(F.desc("score")).limit(limit).select("score").collect()
                if len(best) == limit:
                    least = best[-1]["score"] * (1 - 1e-9)  # sums of doubles may differ in their last places
                    chosen = blocks.join(windows.where(F.col("bound") >= least).select("segment", "window"), ["segment", "window"], "left_semi")
        return hits(chosen).join(self._every("units"), ["segment", "ord"]).select(*none.columns)

    def _postings(self, blocks: DataFrame, terms: list[str]) -> DataFrame:
        """(segment, ord, _dl, _tf0, ...) of the units that hold any of ``terms``."""
        p = blocks.select("segment", "window", "term", F.explode(F.arrays_zip("at", "tfs", "dls")).alias("p"))
        p = p.select("segment", (F.col("window") * WINDOW + F.col("p.at")).alias("ord"), F.col("p.dls").alias("_dl"), "term", F.col("p.tfs").alias("tf"))
        tf = [F.coalesce(F.sum(F.when(search._matches(t, F.col("term")), F.col("tf"))), F.lit(0)).alias(f"_tf{i}") for i, t in enumerate(terms)]
        return p.groupBy("segment", "ord").agg(F.max("_dl").alias("_dl"), *tf)
