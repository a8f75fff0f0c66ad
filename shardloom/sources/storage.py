"""The sharded layout: Parquet by shard and slot bucket, published by manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.hashing import modulo_owner, vshard
from .registry import Registry, table_name
from .store import Conflict, ManifestStore
from .topology import Topology

BUCKET = 4_096  # slots of one directory
SMALL = 16 << 20  # bytes by the optimizer's estimate; up to here a table is shuffled into one file a directory
WRITERS, ROW_GROUP = 64, 16 << 20  # open directories of a task, and the bytes that each may hold back
SHARD, BUCKET_DIR, SLOT = "_shard", "_vb", "_vshard"
PLACEMENT = (SHARD, BUCKET_DIR, SLOT)
VERSION, MARKS = "_v", "#marks"  # a directory level, and a key that is no table's name


def placed(df: DataFrame, table: str, registry: Registry, topology: Topology) -> DataFrame:
    """df with _vshard, _vb and _shard of each row; a null key part is an error.

    Owners under the modulo rule are an expression of the slot; those of any other distribution
    come from its table, which has 65,536 rows whatever the data.
    """
    spec = registry.sharded(table)
    d = topology.distribution(table_name(table))
    slot = vshard(list(spec.key), list(spec.types))
    checked = F.when(slot.isNull(), F.raise_error(F.lit(f"23502: null or invalid shard key in {table_name(table)}")).cast("int")).otherwise(slot)
    out = df.withColumn(SLOT, checked.cast("int")).withColumn(BUCKET_DIR, (F.col(SLOT) / BUCKET).cast("int"))
    order = tuple(sorted(d.owners))
    if d.owners == order and all(d.slots[i] == (i % len(order) - 1) % len(order) for i in range(len(d.slots))):
        owner = F.element_at(F.array(*[F.lit(o) for o in order]), modulo_owner(F.col(SLOT), len(order)))
        return out.withColumn(SHARD, owner)
    owners = d.to_dataframe(df.sparkSession).select(F.col("vshard").alias(SLOT), F.col("shard").alias(SHARD))
    return out.join(F.broadcast(owners), SLOT, "left").select(*df.columns, SLOT, BUCKET_DIR, SHARD)  # 65,536 rows


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting for the block alone."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


Change = Callable[[dict], dict]  # of the manifest's content


class ShardedStorage:
    """Tables below one folder. One manifest lists, for all tables, the live version folders.

    Writers fill new version folders and publish them by one compare-and-swap of the manifest, so
    that a write to several shards or tables is seen whole or not at all; a failed one leaves only
    unlisted files, and there is no state in doubt. A version is a partition of the table's folder:
    however many there are, a table is one scan. compact() makes them one, vacuum() removes the
    folders that no revision lists any more.
    """

    KIND = "tables"
    MANY = 64  # versions from which load() compacts

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store = ManifestStore(spark, f"{self.folder}/_catalog")

    def _content(self, table: str) -> dict | None:
        _, now = self.store.latest(self.KIND)
        return (now or {}).get(table_name(table))

    def stage(self, df: DataFrame, table: str) -> dict:
        """Write rows into new files, by their placement if they have one; nothing is visible yet.

        Small placed tables are rebalanced by directory, so that one task writes many small ones.
        All others are written where they are read: a task holds a writer for each directory, so
        that rows are neither shuffled nor sorted (beyond WRITERS directories Spark sorts the rest).
        """
        version = f"v{uuid.uuid4().hex}"
        path = f"{self.folder}/{table_name(table)}/{VERSION}={version}"
        if SHARD in df.columns:
            if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL:
                df.hint("rebalance", F.col(SHARD), F.col(BUCKET_DIR)).sortWithinPartitions(SHARD, BUCKET_DIR, SLOT).write.partitionBy(SHARD, BUCKET_DIR).parquet(path)
            else:
                with _setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(WRITERS)):
                    df.write.partitionBy(SHARD, BUCKET_DIR).option("parquet.block.size", ROW_GROUP).parquet(path)
        else:
            df.write.parquet(path)
        return {"version": version, "schema": df.schema.json()}

    # --- changes of the manifest; several of them are published together

    @staticmethod
    def appended(table: str, new: dict) -> Change:
        """The staged rows join the table; a shape that differs is an error."""
        full = table_name(table)

        def change(now: dict) -> dict:
            old = now.get(full, {"schema": new["schema"], "versions": [], "revision": 0})
            if _shape(old["schema"]) != _shape(new["schema"]):
                raise ValueError(f"42804: rows for {full} have another shape")
            return now | {full: {"schema": old["schema"], "versions": [*old["versions"], {"version": new["version"], "hidden": []}], "revision": old["revision"] + 1}}

        return change

    @staticmethod
    def replaced(table: str, new: dict, seen: int | None = None) -> Change:
        """The staged rows are the table, whatever its shape was; Conflict if it is not at the revision seen."""
        full = table_name(table)

        def change(now: dict) -> dict:
            before = now.get(full, {"revision": 0})["revision"]
            if seen is not None and before != seen:
                raise Conflict(f"{full} was changed meanwhile")
            return now | {full: {"schema": new["schema"], "versions": [{"version": new["version"], "hidden": []}], "revision": before + 1}}

        return change

    @staticmethod
    def rewritten(table: str, new: dict, touched: list[tuple[str, int]], seen: int) -> Change:
        """The staged rows take the place of the touched directories; Conflict if the table is not at the revision seen."""
        full, hide = table_name(table), [list(t) for t in touched]

        def change(now: dict) -> dict:
            old = now.get(full, {"revision": 0})
            if old["revision"] != seen:
                raise Conflict(f"{full} was changed meanwhile")
            versions = [v | {"hidden": v["hidden"] + [h for h in hide if h not in v["hidden"]]} for v in old["versions"]]
            return now | {full: {"schema": old["schema"], "versions": [*versions, {"version": new["version"], "hidden": []}], "revision": seen + 1}}

        return change

    @staticmethod
    def marked(key: str, number: int) -> Change:
        """A number that is published with rows, such as a stream's batch; Conflict if it is not above the last one."""

        def change(now: dict) -> dict:
            if now.get(MARKS, {}).get(key, -1) >= number:
                raise Conflict(f"{key} {number} was published before")
            return now | {MARKS: now.get(MARKS, {}) | {key: number}}

        return change

    def publish(self, changes: list[Change]) -> None:
        """All of the changes in one revision, or none."""

        def change(now: dict | None) -> dict:
            now = dict(now or {})
            for c in changes:
                now = c(now)
            return now

        self.store.update(self.KIND, change)

    def replace(self, df: DataFrame, table: str, seen: int | None = None) -> None:
        """Publish df as the whole table."""
        self.publish([self.replaced(table, self.stage(df, table), seen)])

    def staged_rewrite(self, change, table: str, touched: list[tuple[str, int]], seen: int) -> Change:
        """Copy on write of some directories: change(df) of their rows is staged.

        seen: the table's revision that the change is computed from.
        """
        inside = F.lit(False)
        for shard, bucket in touched:
            inside = inside | ((F.col(SHARD) == shard) & (F.col(BUCKET_DIR) == bucket))
        return self.rewritten(table, self.stage(change(self.read(table).where(inside)), table), touched, seen)

    def revision(self, table: str) -> int:
        return (self._content(table) or {"revision": 0})["revision"]

    def versions(self, table: str) -> list[dict]:
        """What the table's rows are made of; equal lists are equal rows."""
        return (self._content(table) or {"versions": []})["versions"]

    def mark(self, key: str) -> int:
        """The number that marked() published last; -1 before the first."""
        _, now = self.store.latest(self.KIND)
        return (now or {}).get(MARKS, {}).get(key, -1)

    def drop(self, table: str) -> None:
        """The table leaves the manifest; its files are unlisted."""
        self.store.update(self.KIND, lambda now: {k: v for k, v in (now or {}).items() if k != table_name(table)})

    def compact(self, table: str) -> int:
        """Write the live rows as one version; returns how many there were. Conflict if another writer came."""
        now = self._content(table)
        if now is None or len(now["versions"]) < 2:
            return len(now["versions"]) if now else 0
        self.replace(self.read(table), table, now["revision"])
        return len(now["versions"])

    def vacuum(self, table: str) -> int:
        """Remove the version folders that the newest revision does not list; returns their number.

        Readers of older revisions lose their files, and writers that have staged but not
        published theirs: to be run when there are none.
        """
        full = table_name(table)
        live = {v["version"] for v in (self._content(full) or {"versions": []})["versions"]}
        fs, path = self.store._fs, self.store._path
        base = path(f"{self.folder}/{full}")
        gone = [s.getPath() for s in (fs.listStatus(base) if fs.exists(base) else []) if s.getPath().getName().startswith(f"{VERSION}=") and s.getPath().getName().removeprefix(f"{VERSION}=") not in live]
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    def read(self, table: str) -> DataFrame:
        """The live rows with their placement columns, in one scan; filters on these prune directories."""
        now = self._content(table)
        if now is None:
            raise LookupError(f"42P01: no table {table_name(table)}")
        schema = StructType.fromJson(json.loads(now["schema"]))
        base = f"{self.folder}/{table_name(table)}"
        if not now["versions"]:
            return self.spark.createDataFrame([], schema)
        paths = [f"{base}/{VERSION}={v['version']}" for v in now["versions"]]
        df = self.spark.read.schema(StructType([*schema.fields, StructField(VERSION, StringType())])).option("basePath", base).parquet(*paths)
        hidden: dict[tuple[str, int], list[str]] = {}
        for v in now["versions"]:
            for shard, bucket in v["hidden"]:
                hidden.setdefault((shard, bucket), []).append(v["version"])
        for (shard, bucket), versions in hidden.items():
            df = df.where(~((F.col(SHARD) == shard) & (F.col(BUCKET_DIR) == bucket) & F.col(VERSION).isin(versions)))
        return df.select(*schema.names)


def _shape(schema: str) -> list[tuple]:
    return [(f["name"], json.dumps(f["type"])) for f in json.loads(schema)["fields"]]
