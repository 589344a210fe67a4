"""Helpers that several corpus operators share: shared-folder tables, word
rules, distributed ranks and connected components."""

from __future__ import annotations

import atexit
import functools
import gc
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a maximal run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A
    session in one local process may go without; a cluster may not."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_all() -> None:
    for spark, path in _written:
        try:
            drop_folder(spark, path)
        except Exception:  # the session is gone: the folder's owner clears it
            return


atexit.register(_delete_all)


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/lorebase-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Spark deletes the shuffle files of an execution at its end. Operators leave it
#: set in the session, so that those of the execution that writes their result go as well.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage and survives lost executors, unlike a cache. The shuffles
    behind it go once it is written, itself when ``drop_table`` is called, its
    ``Consumed`` block ends or the driver does.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    spark.conf.set(CLEAN_UP, "true")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lorebase_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote, once nothing reads it any more."""
    path = df._lorebase_path
    _written[:] = [x for x in _written if x[1] != path]
    drop_folder(df.sparkSession, path)


class Consumed:
    """Deletes what the operators wrote in the shared folder within its block,
    but for the tables given to ``keep``: for use where the block's result was
    written, so that nothing refers to its intermediates any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def __enter__(self) -> Consumed:
        self.before = {path for _, path in _written}
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._lorebase_path)
        return df

    def drop(self) -> None:
        """Deletes the kept tables too, once they are read for the last time."""
        for path in self.kept:
            drop_folder(self.spark, path)
        _written[:] = [x for x in _written if x[1] not in self.kept]

    def __exit__(self, *error) -> None:
        mine = [x for x in _written if x[1] not in self.before and x[1] not in self.kept]
        _written[:] = [x for x in _written if x not in mine]
        for spark, path in mine:
            drop_folder(spark, path)


class Stages:
    """Remembers what each stage of a chain wrote in the shared folder, so that
    the next one can delete it: its own input was written by then, and the
    folders it would otherwise leave till the driver's end add up."""

    def __init__(self):
        self.wrote: dict[str, list[str]] = {}

    def after(self, before: str | None):
        """Makes a stage of a function of (spark, docs, sf_dir), which follows that named."""

        def wrap(f):
            @functools.wraps(f)
            def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
                if before is not None:
                    self.release(spark, before, docs)
                known = {path for _, path in _written}
                out = f(spark, docs, sf_dir)
                self.wrote[f.__name__] = [path for _, path in _written if path not in known]
                return out

            return stage

        return wrap

    def release(self, spark: SparkSession, stage: str, docs: DataFrame) -> None:
        """Deletes what the last call of ``stage`` wrote, unless ``docs`` still reads it, as it
        does where that call's result was not written."""
        wrote = self.wrote.pop(stage, [])
        read = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()} if wrote else set()
        gone = {path for path in wrote if path.rsplit("/", 1)[1] not in read}
        for path in gone:
            drop_folder(spark, path)
        _written[:] = [x for x in _written if x[1] not in gone]
        free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver notice that finished jobs' shuffles are garbage, so that
    their files go before the next ones come: first Python lets go of the plans,
    then the JVM; the second pass meets what the first has only marked."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Most bytes of a table that may be sent to every executor, and its rows' width beside their texts.
FEW_BYTES, ROW_BYTES = 16 << 20, 64


def sent_if_few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its values take at most FEW_BYTES; measured first.
    Give it a table that was written or is made of literals: it is read twice."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    width = sum(texts, F.lit(ROW_BYTES)).cast("long")
    size = df.select(width.alias("w")).limit(FEW_BYTES // ROW_BYTES + 1).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= FEW_BYTES else df


def word_count(text: Column) -> Column:
    """Words in ``text`` as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, group: str, order: list[Column], tag: str) -> DataFrame:
    """Adds ``_rank``, each row's 0-based place within ``group`` by ``order``.

    A range shuffle on (group, order) spreads a hot group over many tasks; the
    sorted rows are written, and per task and group only a first position and a
    count are summed, so no task ever sees a whole group. Null is a group.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    placed = (
        df.repartitionByRange(n, F.col(group).asc_nulls_last(), *order)
        .sortWithinPartitions(F.col(group).asc_nulls_last(), *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = materialize(placed, tag)
    # At most (tasks + groups) rows: a group that spans tasks fills all but its first and last.
    runs = placed.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    from pyspark.sql import Window

    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    out = placed.join(sent_if_few(runs), placed[group].eqNullSafe(runs["_g"]) & (placed["_part"] == runs["_p"]))
    return out.withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_g", "_p", "_part", "_at", "_shift")


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(id, component) for every node of ``edges`` (columns u and v, of one
    ordered type); component is the smallest node reachable.

    Alternating large-star and small-star rounds. Each round is two groupings
    whose minima are combined before the shuffle, and is written to the shared
    folder; nothing but two numbers per round reaches the driver.
    """

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    # Kept as (u > v).
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, tag)
    last = state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("k")).select("u", "v", "m")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        old, e = e, materialize(small, tag)
        drop_table(old)
        now = state(e)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
