"""Files from tasks: a sink that commits in two phases, and the file systems behind paths.

``df.write.format("files").mode("append").save(folder)`` writes rows (name string, content binary):
consecutive rows of a partition that have the same name become one file. A task writes below
``folder/_attempts/<job>/<attempt>``; when all have succeeded, the driver gives each counted
attempt's folder its final name, ``folder/part-<job>-<partition>``, and clears the attempts, so
that a task which failed, was run twice or lost its executor leaves each file once. A job that
fails leaves nothing. Only folder names and counts reach the driver. Mode ``overwrite`` removes
the parts that were there before.

Names may have folders of their own; an absolute name or ``..`` is an error, and so is a null
name. A row of null content makes no file, an empty table leaves an empty folder.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ATTEMPTS = "_attempts"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and what is in it."""

    partition: int
    attempt: str
    files: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _attempts(self) -> str:
        return f"{located(self.path)[1]}/{ATTEMPTS}/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, _ = located(self.path)
        context = TaskContext.get()
        attempt = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        folder, files, out, last, inside = f"{self._attempts()}/{attempt}", 0, None, None, None
        try:
            for row in (row for batch in iterator for row in zip(batch.column("name"), batch.column("content"), strict=True)):
                name, content = (value.as_py() for value in row)
                if content is None:
                    continue
                if name is None or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a name for a file: {name}")
                if out is None or name != last:
                    if out is not None:
                        out.close()
                    target = f"{folder}/{name}"
                    if target.rsplit("/", 1)[0] != inside:
                        inside = target.rsplit("/", 1)[0]
                        where.create_dir(inside, recursive=True)
                    if where.get_file_info(target).type != fs.FileType.NotFound:
                        raise ValueError(f"rows of {name} do not follow one another")
                    out, last, files = where.open_output_stream(target), name, files + 1
                out.write(content)
        except BaseException:
            if files:
                where.delete_dir(folder)
            raise
        finally:
            if out is not None:
                out.close()
        return Written(context.partitionId(), attempt, files)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = located(self.path)
        where.create_dir(folder, recursive=True)
        if self.overwrite:
            for part in where.get_file_info(fs.FileSelector(folder)):
                if part.base_name.startswith("part-"):
                    where.delete_dir(part.path)
        for done in messages:
            if done and done.files:
                where.move(f"{self._attempts()}/{done.attempt}", f"{folder}/part-{self.job[:8]}-{done.partition:06d}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, folder = located(self.path)
        if where.get_file_info(self._attempts()).type == fs.FileType.Directory:
            where.delete_dir(self._attempts())
        attempts = f"{folder}/{ATTEMPTS}"
        if where.get_file_info(attempts).type == fs.FileType.Directory and not where.get_file_info(fs.FileSelector(attempts)):
            where.delete_dir(attempts)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if {"name", "content"} - set(schema.names):
            raise ValueError("files are rows of name and content")
        return FilesWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Writes rows (name, content) as files below a folder that driver and executors share."""
    register(rows.sparkSession)
    rows.select("name", "content").write.format("files").mode("overwrite" if overwrite else "append").save(folder)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesSource)
