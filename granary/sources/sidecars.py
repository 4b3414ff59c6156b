"""A sink of one small text file a row, of which none is seen before all are written."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: int


class SidecarWriter(DataSourceArrowWriter):
    """Tasks write to a pending folder beside the target; the driver gives it the target's name once all have ended.

    A task that runs again, or twice, writes the same names anew: each file is moved to its name when it is whole.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def folders(self) -> tuple[FileSystem, str, str]:
        files, root = FileSystem.from_uri(self.path)
        return files, root, f"{root}.pending-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, pending = self.folders()
        files.create_dir(pending)
        attempt, n = uuid.uuid4().hex, 0
        for batch in iterator:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"{name!r} is no name of a file")
                with files.open_output_stream(f"{pending}/.{attempt}") as out:
                    out.write((text or "").encode())
                files.move(f"{pending}/.{attempt}", f"{pending}/{name}")
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root, pending = self.folders()
        files.create_dir(pending)
        there = files.get_file_info(root).type != FileType.NotFound
        rows, found = sum(m.files for m in messages if m), sum(not x.base_name.startswith(".") for x in files.get_file_info(FileSelector(pending)))
        if there and not self.overwrite or rows != found:
            self.abort(messages)
            raise FileExistsError(root) if rows == found else ValueError(f"{rows} rows have {found} names")
        if there:
            files.move(root, f"{root}.old-{self.job}")
        files.move(pending, root)
        if there:
            files.delete_dir(f"{root}.old-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        files, _, pending = self.folders()
        if files.get_file_info(pending).type != FileType.NotFound:
            files.delete_dir(pending)


class Sidecars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sidecars"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> SidecarWriter:
        return SidecarWriter(self.options["path"], overwrite)


def write_sidecars(rows: DataFrame, path: str, name: str, text: str, overwrite: bool = False) -> None:
    """A file a row in the folder `path`: all of them at once, or none if a task fails, a name repeats or isn't one.

    An existing folder raises FileExistsError unless it is to be replaced. Null texts give empty files. The folder must lie
    where driver and executors reach it by the same address.
    """
    rows.sparkSession.dataSource.register(Sidecars)
    files = rows.select(F.col(name).alias("name"), F.col(text).alias("text"))
    files.write.format("sidecars").mode("overwrite" if overwrite else "append").save(path)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """name and text of the files of a folder; scans pass over empty files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("text"))
