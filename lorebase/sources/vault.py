"""SNK-03/04/05/08/09: a project's files, written by tasks and committed as one."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = ".staging"


class ConflictError(Exception):
    """The file is not the one that the caller has read."""


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: a folder, and how many files it holds."""

    folder: str
    files: int


def _store(path: str):
    """The file system of ``path``, which driver and executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _digest(store, path: str) -> str | None:
    from pyarrow import fs

    if store.get_file_info(path).type != fs.FileType.File:
        return None
    h = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


class _Writer(DataSourceWriter):
    """Rows (file_path, body and, if there, expected_sha256) to files. Rows of one path
    that follow one another are one file. Files are staged beside their place and moved
    when all tasks have ended; if one fails, none is."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        from pyspark import TaskContext

        store, root = _store(self.root)
        folder = f"{root}/{STAGING}/{self.job}/{TaskContext.get().taskAttemptId()}"
        name, out, h, expected, files = None, None, None, None, 0

        def close() -> int:
            if out is None:
                return 0
            out.close()
            there = _digest(store, f"{root}/{name}")
            if expected is not None and (there or "") != expected:
                raise ConflictError(name)
            if there == h.hexdigest():
                store.delete_file(f"{folder}/{name}")  # the file is as it should be
                return 0
            return 1

        for row in iterator:
            if row["file_path"] is None:
                raise ValueError("a file without a path")
            if row["file_path"] != name:
                files += close()
                name = row["file_path"]
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"a file outside the vault: {name}")
                store.create_dir(f"{folder}/{name}".rsplit("/", 1)[0], recursive=True)
                out, h = store.open_output_stream(f"{folder}/{name}"), hashlib.sha256()
                expected = row["expected_sha256"] if "expected_sha256" in row else None
            data = (row["body"] or "").encode()
            out.write(data)
            h.update(data)
        files += close()
        return Staged(folder, files)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root = _store(self.root)
        for m in messages:
            if m is None or not m.files:
                continue
            for info in store.get_file_info(fs.FileSelector(m.folder, recursive=True)):
                if info.type == fs.FileType.File:
                    to = f"{root}/{info.path[len(m.folder) + 1:]}"
                    store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                    store.move(info.path, to)
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.root))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{STAGING}/{self.job}")
        left = store.get_file_info(fs.FileSelector(f"{root}/{STAGING}", allow_not_found=True))
        if not left and store.get_file_info(f"{root}/{STAGING}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{STAGING}")


class VaultSource(DataSource):
    """``df.write.format("vault").mode("append").save(folder)``; see ``write_files``."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "file_path string, body string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("files are written beside those that are there: mode append")
        return _Writer(dict(self.options))


def write_files(rows: DataFrame, folder: str, *order: Column | str) -> None:
    """Writes ``rows`` (file_path, body and, if there, expected_sha256) as files under
    ``folder``, all or none. The rows of one path are one file, in ``order``, and go
    through one task, which holds one row at a time. With an expected digest ('' for
    no file) a file must still have it. A file that has its text already stays as it
    is. A null body is empty; paths must lie within the folder."""
    rows.sparkSession.dataSource.register(VaultSource)
    kept = rows.repartition("file_path").sortWithinPartitions("file_path", *order)
    kept.select("file_path", "body", *[c for c in ("expected_sha256",) if c in rows.columns]).write.format("vault").mode("append").save(folder)


def digests(spark, folder: str) -> DataFrame:
    """(file_path, sha256) of the Markdown and JSON files under ``folder`` that are not empty."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,json}").load(folder)
    top = folder if folder.startswith("file:") or "://" in folder else f"file:{folder}"
    at = F.regexp_replace(F.col("path"), r"^file:/+", "file:/")
    root = F.regexp_replace(F.lit(top.rstrip("/") + "/"), r"^file:/+", "file:/")
    return found.select(F.substring(at, F.length(root) + 1, F.length(at)).alias("file_path"), F.sha2("content", 256).alias("sha256"))
