"""A sink for one JSON array in one file, as a Spark data source with a commit.

Spark renders rows to JSON; each task writes its rows to a part of its own, and the commit puts the
parts together in the order of partitions and renames the whole into place. Parts are copied from file to file;
no row passes the driver. Attempts that fail, are killed or lose a race leave nothing behind,
and until the commit no reader sees a file.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "peakloom_json_array"


@dataclass
class Part(WriterCommitMessage):
    """What a finished task tells the commit."""

    partition: int
    file: str
    rows: int


class JsonArraySource(DataSource):
    """Writes a table of one string column, each value a JSON element, to option `path`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> JsonArrayWriter:
        return JsonArrayWriter(self.options["path"], overwrite)


class JsonArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = os.path.abspath(path)
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.staging = f"{self.path}.{uuid.uuid4().hex}.parts"
        os.makedirs(self.staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        partition = TaskContext.get().partitionId()
        file = os.path.join(self.staging, f"{partition}-{uuid.uuid4().hex}")
        rows = 0
        try:
            with open(file, "xb") as out:
                for batch in iterator:
                    for element in batch.column(0):
                        out.write((",\n" if rows else "").encode() + element.as_buffer().to_pybytes())
                        rows += 1
        except BaseException:
            if os.path.exists(file):
                os.remove(file)
            raise
        return Part(partition, file, rows)

    def commit(self, messages: list) -> None:
        try:
            whole = os.path.join(self.staging, "whole")
            with open(whole, "xb", buffering=0) as out:
                between = b"["
                for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
                    out.write(between)
                    _append(part.file, out)
                    between = b",\n"
                out.write(b"[]" if between == b"[" else b"]")
                os.fsync(out.fileno())
            os.replace(whole, self.path)
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def _append(file: str, out) -> None:
    """Append a file, by the file system itself where it can."""
    with open(file, "rb", buffering=0) as part:
        left = os.fstat(part.fileno()).st_size
        try:
            while left and (n := os.copy_file_range(part.fileno(), out.fileno(), left)):
                left -= n
        except OSError:
            pass
        if left:  # what the file system would not copy; both files stand where the copy ended
            shutil.copyfileobj(part, out, 1 << 20)


def write_json_array(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """df as one JSON array in the file `path`, in the order of its partitions and of the rows in them.

    path lies in a folder that driver and executors share. Nulls are written; an empty table is [].
    An existing file is an error unless overwrite is set, and stays as it is until the commit.
    """
    df.sparkSession.dataSource.register(JsonArraySource)
    element = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    df.select(element.alias("element")).write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", path).save()
