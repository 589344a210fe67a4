"""Tables in the folder that driver and executors share, and graph components."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, functions as F


_written: list = []


def drop_folder(spark, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_all() -> None:
    for spark, path in _written:
        try:
            drop_folder(spark, path)
        except Exception:  # the session is gone: the folder's owner clears it
            return


atexit.register(_delete_all)


def new_folder(spark, tag: str) -> str:
    """A folder of its own under ``spark.checkpoint.dir``, deleted when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(top or 'file:///tmp/checkpoints').rstrip('/')}/lorebase-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir``: cuts the lineage
    of loops and outlives lost executors. Deleted when the driver ends."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_states(df: DataFrame) -> tuple[tuple[str, int, int], ...]:
    """Path, size and time of change of the files that ``df`` reads, at any store."""
    spark, out = df.sparkSession, []
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in sorted(df.inputFiles()):
        s = path(name).getFileSystem(conf).getFileStatus(path(name))
        out.append((name, s.getLen(), s.getModificationTime()))
    return tuple(out)


def min_labels(nodes: DataFrame, hubs: DataFrame) -> DataFrame:
    """(id, root): the smallest node id of each node's component.

    ``nodes`` has id; ``hubs`` has id and hub: nodes that share a hub are
    connected. Labels pass through hubs, then each label takes its own label
    (pointer jumping), so rounds grow with the logarithm of a chain's length.
    """
    labels = written(nodes.select("id", F.col("id").alias("root")).distinct(), "labels")
    hubs = written(hubs.select("id", "hub").distinct(), "hubs")
    while True:
        of_hub = hubs.join(labels, "id").groupBy("hub").agg(F.min("root").alias("least"))
        of_node = hubs.join(of_hub, "hub").groupBy("id").agg(F.min("least").alias("least"))
        lower = labels.join(of_node, "id", "left").select("id", "root", F.least("root", F.coalesce("least", "root")).alias("next"))
        jump = lower.select(F.col("id").alias("next"), F.col("next").alias("far")).distinct()
        moved = lower.join(jump, "next", "left").select("id", F.col("root").alias("old"), F.least("next", F.coalesce("far", "next")).alias("root"))
        moved = written(moved, "labels")
        if moved.where("old <> root").isEmpty():
            return moved.select("id", "root")
        labels = moved.select("id", "root")
