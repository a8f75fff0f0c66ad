"""A writer of binary COPY files, as a Python data source."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .copy_format import SIGNATURE, binary_value, small_batches

FILE = 64 << 20  # bytes from which a task goes on in another file: a reader takes a file as one value


@dataclass
class _Done(WriterCommitMessage):
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, kinds: list) -> None:
        self.path, self.kinds = path, kinds

    def write(self, rows: Iterator) -> _Done:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        n, number, more = 0, 0, True
        rows = iter(rows)
        while more:  # file by file
            name, size, more = f"{root}/part-{task.partitionId():05d}-{number:05d}.bin", 0, False
            with fs.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
                out.write(SIGNATURE + struct.pack(">ii", 0, 0))
                for row in rows:
                    cells = [binary_value(v, k) for v, k in zip(row, self.kinds, strict=True)]
                    size += out.write(struct.pack(">h", len(cells)) + b"".join(struct.pack(">i", -1) if c is None else struct.pack(">i", len(c)) + c for c in cells))
                    n += 1
                    if size >= FILE:
                        more = True
                        break
                out.write(struct.pack(">h", -1))
            fs.move(f"{name}.{task.taskAttemptId()}", name)
            number += 1
        return _Done(n)


class BinaryCopy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgcopy"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], [f.dataType for f in schema.fields])


def write_binary(df: DataFrame, path: str, kinds: list) -> int:
    spark = df.sparkSession
    small_batches(spark)
    spark.dataSource.register(BinaryCopy)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("pgcopy").mode("append").option("path", path if "://" in path or path.startswith("file:") else f"file://{path}").save()
    return seen.get["n"]
