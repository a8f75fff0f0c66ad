"""Versioned manifests with compare-and-swap, and ids that are unique across writers.

A revision is a file that is created exclusively: of two writers of one revision one wins, and
the other reads the winner. Files live in a folder of any file system that the JVM's Hadoop
client opens.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ID = 2**63 - 1
ATTEMPTS = 64


class Conflict(RuntimeError):
    """Another writer published this revision first."""


class ManifestStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[int]:
        base = self._path(f"{self.folder}/{kind}")
        if not self._fs.exists(base):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(base)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self, kind: str) -> tuple[int, dict | None]:
        """The newest revision and its content; 0 and None before the first.

        A revision whose writer died inside is void: its number is used up, the content is that
        of the one before.
        """
        found = self._names(kind)
        for revision in reversed(found):
            content = self.read(kind, revision)
            if content is not None:
                return found[-1], content
        return (found[-1] if found else 0), None

    def read(self, kind: str, revision: int, patience: float = 3.0) -> dict | None:
        """The content; a file that is still being written is awaited, None if it stays unfinished."""
        end = time.monotonic() + patience
        while True:
            stream = self._fs.open(self._path(f"{self.folder}/{kind}/{revision}.json"))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):
                return json.loads(text)
            if time.monotonic() > end:
                return None
            time.sleep(0.02)

    def publish(self, kind: str, revision: int, content: dict) -> None:
        """Create the revision; Conflict if it exists."""
        path = self._path(f"{self.folder}/{kind}/{revision}.json")
        try:
            out = self._fs.create(path, False)
        except Exception as e:
            if self._fs.exists(path):
                raise Conflict(f"{kind} revision {revision}") from e
            raise
        out.write(bytearray(json.dumps(content, sort_keys=True).encode() + b"\n"))
        out.close()

    def update(self, kind: str, change: Callable[[dict | None], dict]) -> tuple[int, dict]:
        """Publish change(newest) as the next revision, again on conflict; no revision if nothing changes."""
        for _ in range(ATTEMPTS):
            revision, now = self.latest(kind)
            new = change(now)
            if new == now:
                return revision, new
            try:
                self.publish(kind, revision + 1, new)
            except Conflict:
                continue
            return revision + 1, new
        raise Conflict(f"{kind}: no turn in {ATTEMPTS} attempts")


class IdAllocator:
    """Ids of a table, unique across all writers; a block is reserved by one compare-and-swap."""

    def __init__(self, store: ManifestStore) -> None:
        self.store, self.held = store, []

    def reserve(self, name: str, count: int) -> int:
        """The first of count new consecutive ids; unused ones are gaps."""
        first = 0

        def change(now: dict | None) -> dict:
            nonlocal first
            first = (now or {"last": 0})["last"] + 1
            if first + count - 1 > MAX_ID:
                raise OverflowError(f"{name}: ids are used up")
            return {"last": first + count - 1}

        if count:
            self.store.update(f"sequence-{name}", change)
        return first

    def numbered(self, df: DataFrame, name: str, column: str, *order: str) -> DataFrame:
        """df with new ids in column: consecutive in the given order.

        The rows are written once in range partitions (a second evaluation could cut the ranges
        elsewhere); a row's id is its file's base, a prefix sum of the files' counts, plus its
        place in the file. No single task numbers all rows. close() removes the written rows.
        """
        spark = df.sparkSession
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        path = f"{self.store.folder}/numbered-{uuid.uuid4().hex}"
        self.held.append(path)
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(path)
        back = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        counts = sorted(tuple(r) for r in back.groupBy("__file").count().collect())  # a row for each file
        first = self.reserve(name, sum(n for _, n in counts))
        bases = [(f, first + before) for (f, _), before in zip(counts, accumulate((n for _, n in counts), initial=0), strict=False)]
        base = spark.createDataFrame(bases, "__file string, __base long")
        return back.join(F.broadcast(base), "__file").withColumn(column, F.col("__base") + F.col("__row")).select(*df.columns, column)

    def close(self) -> None:
        for path in self.held:
            self.store._fs.delete(self.store._path(path), True)
        self.held.clear()
