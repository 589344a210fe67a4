"""DML-08: the registry of projects."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from .engine import KnowledgeEngine

ROW = "id string, name string, slug string, root_path string, status string, change long"


class Projects:
    """Projects by id, slug and folder, kept as a log of changes under ``path`` that is
    only added to; the last change of an id holds. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        kinds = f"{ROW}, at timestamp"
        return self.spark.read.schema(kinds).parquet(self.path) if there else self.spark.createDataFrame([], kinds)

    def _note(self, *values: str) -> None:
        change = (self._log().agg(F.max("change")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(*values, change)], ROW).withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        """The projects that are there, those changed last first."""
        last = self._log().groupBy("id").agg(F.max_by(F.struct("name", "slug", "root_path", "status", "change"), "change").alias("x"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
        return last.select("id", "x.*", "created_at", "updated_at").where("status <> 'deleted'").orderBy(F.desc("change")).drop("change")

    def create(self, name: str, root_path: str, slug: str | None = None) -> str:
        """A new project's id. The slug, made of the name if not given, must be new and not empty."""
        slug = self.spark.createDataFrame([(name,)], "n string").select(tx.slugify(F.col("n"))).first()[0] if slug is None else slug
        if not slug:
            raise ValueError("a project needs a slug")
        if not self.all().where(F.col("slug") == slug).isEmpty():
            raise ValueError(f"there is a project {slug} already")
        project = uuid.uuid4().hex
        self._note(project, name, slug, root_path.rstrip("/"), "active")
        return project

    def get(self, project: str) -> dict:
        row = self.all().where(F.col("id") == project).first()
        if row is None:
            raise KeyError(project)
        return row.asDict()

    def open(self, project: str, **how) -> KnowledgeEngine:
        """The project's tables; it moves to the top of the list."""
        p = self.get(project)
        self._note(p["id"], p["name"], p["slug"], p["root_path"], p["status"])
        return KnowledgeEngine.open(self.spark, p["root_path"], **how)

    def save(self, project: str, engine: KnowledgeEngine) -> None:
        engine.save(self.get(project)["root_path"])

    def delete(self, project: str) -> dict:
        """Takes a project from the registry; its folder stays."""
        p = self.get(project)
        self._note(p["id"], p["name"], p["slug"], p["root_path"], "deleted")
        return p
