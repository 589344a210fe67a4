"""Exact dedup through an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import CLEAN_UP, drop_table, materialize, new_path, sent_if_few, shuffle_partitions

#: Distinct texts in a bucket before it is split.
CAPACITY = 4096
#: Bits of a directory beyond those that evenly filled buckets need.
SPARE_BITS = 6
#: Bytes of text that a task holds at once: of rows that it compares, and of repeated texts it gathers.
BYTES = 8 << 20


def _slot(h: Column, bits: int | Column) -> Column:
    """The first ``bits`` (1 to 63) bits of a hash, in the order of hashes."""
    return F.call_function("shiftright", h, (F.lit(64) - bits).cast("int"))


def _owner_bits(spark: SparkSession) -> int:
    """Owner tasks are two to this power; each has one range of hashes."""
    return max(1, math.ceil(math.log2(shuffle_partitions(spark))))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))


def _lo(h: Column, bits: Column) -> Column:
    """The least hash with the first ``bits`` bits of h."""
    return F.call_function("shiftleft", _slot(h, bits), (F.lit(64) - bits).cast("int"))


def grown_directory(hashes: DataFrame, starts: DataFrame, capacity: int) -> DataFrame:
    """(lo, depth, entries): the buckets that become of ``starts`` (lo, depth) when
    distinct ``hashes`` (h, start: the depth of the bucket that holds it) are in them.

    An overfull bucket gives way to the two of one bit more, which doubles the
    directory where it has no such bit yet. Only counts per slot take part. Hashes
    that share more bits than the deepest directory can tell apart stay in one
    bucket, whatever their number.
    """
    n, least = hashes.count(), starts.agg(F.max("depth")).first()[0] or 1
    deepest = min(63, max(least, math.ceil(math.log2(max(1, n / capacity)))) + SPARE_BITS)
    slots = hashes.groupBy(_slot(F.col("h"), F.lit(deepest)).alias("slot"), "start").agg(F.count("*").alias("n"))
    slots = materialize(slots, "exact-slots")
    depths = slots.select("slot", "n", F.explode(F.sequence("start", F.lit(deepest))).alias("depth"))
    lo = F.call_function("shiftleft", F.call_function("shiftright", "slot", (F.lit(deepest) - F.col("depth")).cast("int")), (F.lit(64) - F.col("depth")).cast("int"))
    levels = depths.groupBy("depth", lo.alias("lo")).agg(F.sum("n").alias("entries"))
    full = (F.col("entries") > capacity) & (F.col("depth") < deepest)
    upper = F.col("lo") + F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(63) - F.col("depth")).cast("int"))
    halves = levels.where(full).select(F.explode(F.array("lo", upper)).alias("lo"), (F.col("depth") + 1).alias("depth"))
    buckets = starts.select("lo", "depth").unionByName(halves).join(levels, ["lo", "depth"], "left")
    return buckets.select("lo", "depth", F.coalesce("entries", F.lit(0)).cast("long").alias("entries")).where(~full)


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some BYTES each, one row at least."""
    ends, low = np.cumsum(lengths), 0
    while low < len(lengths):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + BYTES, "right")))
        yield low, high
        low = high


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def _combined(keyed: DataFrame) -> DataFrame:
    """(h, text, keep, n): the rows of ``keyed`` with equal texts of one task
    joined, as far as they fit in memory, with their largest id and number."""
    kind = dict(keyed.dtypes)["id"]
    schema = f"h long, text string, keep {kind}, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated: dict[bytes, list] = {}  # texts met more than once, of BYTES at most
        held, id_type = 0, None

        def release() -> pa.RecordBatch:
            rows = [(x[0], t, x[1], x[2]) for t, x in repeated.items()]
            h, text, keep, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(keep, id_type), pa.array(n, pa.int64())], ["h", "text", "keep", "n"])

        for whole in batches:
            id_type = whole.schema.field("id").type
            sizes = np.asarray(pa.compute.binary_length(whole.column("text")).to_numpy(zero_copy_only=False), np.int64)
            for low, high in _slices(sizes):
                b = whole.slice(low, high - low)
                h = b.column("h").to_numpy(zero_copy_only=False)
                _, at, times = np.unique(h, return_inverse=True, return_counts=True)
                often = times[at] > 1
                for i in np.flatnonzero(often):
                    text, key = b.column("text")[i].as_buffer().to_pybytes(), b.column("id")[i].as_py()
                    x = repeated.get(text)
                    if x is None:
                        repeated[text] = [int(h[i]), key, 1]
                        held += len(text) + 64
                    else:
                        x[1], x[2] = _larger(x[1], key), x[2] + 1
                if held > BYTES:
                    yield release()
                    repeated, held = {}, 0
                alone = b.filter(pa.array(~often))
                if alone.num_rows:
                    yield pa.RecordBatch.from_arrays([alone.column("h"), alone.column("text"), alone.column("id"), pa.array(np.ones(alone.num_rows, np.int64))], ["h", "text", "keep", "n"])
        if repeated:
            yield release()

    return keyed.select("h", "text", "id").mapInArrow(run, schema)


def _chained(rows: DataFrame, kind: str) -> DataFrame:
    """What an owner task does: ``rows`` (its buckets and entries in the order of
    their hashes) to one entry per distinct text. Entries of one hash are a chain,
    along which the bytes of each text are compared with those before."""
    schema = f"bucket long, depth int, h long, link int, text string, text_sha256 string, keep {kind}, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, last, chain, id_type = (0, 0), None, [], None
        out: list[tuple] = []
        size = 0

        def flush() -> None:
            nonlocal size
            digests = set()
            for link, (text, keep, n) in enumerate(chain):
                digest = hashlib.sha256(text).hexdigest()
                if digest in digests:  # rows are told apart by their digests, so these must differ as the bytes do
                    raise ValueError(f"two texts share the SHA-256 {digest}")
                digests.add(digest)
                out.append((*bucket, last, link, text, digest, keep, n))
                size += len(text) + 128

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), id_type, pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            arrays[4] = arrays[4].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, ["bucket", "depth", "h", "link", "text", "text_sha256", "keep", "n"])

        for b in batches:
            id_type = b.schema.field("keep").type
            hs, depths, keeps, ns = (b.column(c).to_pylist() for c in ("h", "depth", "keep", "n"))
            texts = b.column("text")
            for i, h in enumerate(hs):
                if ns[i] is None:  # a bucket begins
                    flush()
                    chain, last, bucket = [], None, (h, depths[i])
                    continue
                if h != last:
                    flush()
                    chain, last = [], h
                    if size > BYTES:
                        yield batch()
                        out.clear()
                        size = 0
                text = texts[i].as_buffer().to_pybytes()
                for x in chain:
                    if x[0] == text:
                        x[1], x[2] = _larger(x[1], keeps[i]), x[2] + ns[i]
                        break
                else:
                    chain.append([text, keeps[i], ns[i]])
        flush()
        if out:
            yield batch()

    return rows.mapInArrow(run, schema)


class ExactIndex:
    """Every distinct text of the documents added, once: its bytes, digest, largest
    id and number of rows, in buckets of CAPACITY texts by the first bits of a hash.

    ``directory`` (lo, depth, entries, generation) says which buckets there are; the
    texts lie in Parquet files under ``path``, sorted by hash, a file per owner task
    and generation. ``add`` rewrites only the buckets that get texts.
    """

    def __init__(self, spark: SparkSession, path: str, capacity: int = CAPACITY):
        self.spark, self.path, self.capacity, self.generation = spark, path, capacity, 0

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> ExactIndex:
        spark = docs.sparkSession
        out = cls(spark, path or new_path(spark, "exact-index"), capacity)
        keyed = _keyed(docs, id_col, text_col)
        bits = _owner_bits(spark)
        hashes = materialize(keyed.select("h").distinct().withColumn("start", F.lit(bits)), "exact-hashes")
        first = spark.range(-(1 << bits >> 1), 1 << bits >> 1).select(F.call_function("shiftleft", "id", F.lit(64 - bits)).alias("lo"), F.lit(bits).alias("depth"))
        out._write(grown_directory(hashes, first, capacity), _combined(keyed), bits)
        drop_table(hashes)
        return out

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds documents. Buckets without new texts stay as they are."""
        keyed, old = _keyed(docs, id_col, text_col), self.directory()
        depths = [r[0] for r in old.select("depth").distinct().collect()]  # 63 at most
        new = keyed.select("h").distinct().withColumn("depth", F.explode(F.lit(depths))).withColumn("lo", _lo(F.col("h"), F.col("depth")))
        new = materialize(new.join(old.select("lo", "depth"), ["lo", "depth"]), "exact-hashes")  # every hash has its bucket
        touched = materialize(old.join(new, ["lo", "depth"], "left_semi"), "exact-touched")
        stored = self.entries().join(touched.select(F.col("lo").alias("bucket"), "depth"), ["bucket", "depth"], "left_semi")
        every = new.select("h", F.col("depth").alias("start")).union(stored.select("h", "depth")).distinct()
        grown = grown_directory(every, touched.select("lo", "depth"), self.capacity)
        self._write(grown, _combined(keyed).unionByName(stored.select("h", "text", "keep", "n")), min(depths), old.join(touched, ["lo", "depth"], "left_anti"))
        for t in (new, touched):
            drop_table(t)

    def _write(self, directory: DataFrame, entries: DataFrame, bits: int, rest: DataFrame | None = None) -> None:
        """Writes a generation: each owner task has the hashes of the same first ``bits`` bits."""
        g = self.generation + 1
        self.spark.conf.set(CLEAN_UP, "true")
        kind = dict(entries.dtypes)["keep"]
        directory = materialize(directory, "exact-directory")
        none = lambda t: F.lit(None).cast(t)
        marks = directory.select(F.col("lo").alias("h"), none("string").alias("text"), none(kind).alias("keep"), none("long").alias("n"), F.col("depth").cast("int").alias("depth"))
        rows = marks.unionByName(entries.withColumn("depth", none("int")))
        owner = (_slot(F.col("h"), F.lit(bits)) + F.lit(1 << bits >> 1)).cast("int")
        dealt = rows.repartitionById(1 << bits, owner).sortWithinPartitions("h", F.col("n").isNotNull())
        _chained(dealt, kind).write.parquet(f"{self.path}/{g}/entries")
        now = directory.select("lo", "depth", "entries", F.lit(g).alias("generation"))
        (now if rest is None else now.unionByName(rest)).write.parquet(f"{self.path}/{g}/directory")
        drop_table(directory)
        self.generation = g

    def directory(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.generation}/directory")

    def entries(self) -> DataFrame:
        """bucket, depth, h, link (its place in the chain), text, text_sha256, keep, n."""
        first = self.spark.read.parquet(f"{self.path}/1/entries")
        if self.generation == 1:
            return first
        every = first.withColumn("generation", F.lit(1))
        for g in range(2, self.generation + 1):
            every = every.unionByName(self.spark.read.parquet(f"{self.path}/{g}/entries").withColumn("generation", F.lit(g)))
        live = self.directory().select(F.col("lo").alias("bucket"), "depth", "generation")
        return every.join(live, ["bucket", "depth", "generation"], "left_semi").drop("generation")

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, keep_id, group_size, kept and text_sha256 of each row of ``docs``,
        which must have been added. Only texts of several rows are joined; they are
        written first, so that a text that many rows share can be dealt to many tasks."""
        several = self.entries().where("n > 1").select(F.col("h").alias("_h"), F.col("text_sha256").alias("_sha"), "keep", "n")
        several = materialize(several, "exact-several")
        rows = _keyed(docs, id_col, text_col).select("id", "h", F.sha2("text", 256).alias("text_sha256"))
        j = rows.join(sent_if_few(several), (F.col("h") == F.col("_h")) & (F.col("text_sha256") == F.col("_sha")), "left")
        keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
        return j.select(F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    Texts are equal if their bytes are; a null text is empty. Of equal texts the
    rows of the largest id stay. A null id is smaller than any; rows that repeat id
    and text all say the same and count each; texts may be of any length (a task
    holds some of them at once); other columns don't matter, whatever their names;
    an empty table gives an empty one.
    """
    return ExactIndex.build(docs, id_col, text_col, capacity=capacity).lookup(docs, id_col, text_col)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, the one of the largest id; of rows that
    repeat both, any one. Nulls and empty tables as in ``exact_groups``."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{id_col}`").alias("_id"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("_sha"))
    stay = materialize(exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_of")).distinct(), "exact-stay")
    kept = named.join(stay, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_sha") == F.col("_of")), "left_semi")
    return kept.dropDuplicates(["_id", "_sha"]).select("_doc.*")


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
