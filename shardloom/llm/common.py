"""Shared plumbing of the training-data operators: scratch tables, row grouping, hashing."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one on a single machine."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    own = f"file://{tempfile.mkdtemp(prefix='shardloom-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    _scratch.append((spark, own))
    return own


def _delete(spark: SparkSession, uri: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    for spark, uri in _scratch:
        try:
            _delete(spark, uri)
        except Exception:  # the session may be gone already; what is left is scratch  # noqa: BLE001, S110
            pass


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about 4 MB of text, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's default: 64 MB, which both sides of a worker hold
        spark.conf.set(key, "4m")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one; removed when the driver ends."""
    uri = f"{shared_folder(spark)}/shardloom-{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, uri))
    return uri


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def plain(df: DataFrame) -> list:
    """df's own columns, whatever is in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    Lost executors recompute from that table, not from the source, and a hot join on it
    keeps both its sides as plain shuffles, which adaptive execution can split.
    """
    spark = df.sparkSession
    uri = scratch_path(spark, label)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table from written() that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/shardloom-" in folder:
            _delete(spark, folder)


def scratch_mark() -> int:
    """The scratch so far, for drop_since()."""
    return len(_scratch)


def drop_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Remove the scratch made since the mark but for the tables that later plans read."""
    names = {f.rpartition("/")[0].rpartition("/shardloom-")[2] for df in keep for f in df.inputFiles()}
    for at, uri in _scratch[mark:]:
        if at is spark and uri.rpartition("/shardloom-")[2] not in names:
            _delete(spark, uri)
    _scratch[mark:] = [x for x in _scratch[mark:] if x[1].rpartition("/shardloom-")[2] in names or x[0] is not spark]


def release() -> None:
    """Give a worker's freed memory back: workers stay for later tasks of other operators."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_kept: dict[str, dict] = {}  # of a worker process


def kept_by(operator: str) -> dict:
    """What a worker keeps for later tasks of this operator; what another operator kept is given back."""
    if operator not in _kept:
        if any(_kept.values()):
            _kept.clear()
            release()
        _kept.clear()
        _kept[operator] = {}
    return _kept[operator]


def listed(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A small table of the driver's. A list of Python rows would go through Python workers of their own, which stay for a minute."""
    return spark.createDataFrame(pa.table(columns))


def groups_by(key: str, pick: Callable[[pa.RecordBatch | pa.Table], object]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """From a key-sorted batch stream, yield pick(table) for each run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            keys = t.column(key).to_pylist()
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                part = t.slice(start, i - start)
                if held and keys[start] != last:
                    yield pick(pa.concat_tables(held))
                    held = []
                held.append(part)
                last = keys[start]
                start = i
        if held:
            yield pick(pa.concat_tables(held))

    return run


class Forest:
    """Union-find over arbitrary integers."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> bool:
        """True if a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def components(edges: DataFrame, label: str = "cc", rounds: int = 40) -> DataFrame:
    """Connected components of edges (a long, b long): node long, component long (its smallest node).

    Each partition first replaces its edges by a spanning forest (as many rows as nodes at
    most); then alternating large-star and small-star rounds (Kiveris et al. 2014) hook every
    node to smaller neighbours until nothing changes. Neighbour minima are partial aggregates
    and come back by a join whose sides are plain shuffles, so that a hub is no bottleneck.
    Nulls and self loops are ignored; a node without edges has no row.
    """
    spark = edges.sparkSession

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f.join(a, b)
        child = list(f.up)
        step = 50_000
        for i in range(0, len(child), step):
            part = child[i : i + step]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([f.root(x) for x in part], pa.int64())], ["a", "b"])

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))).first())

    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = written(clean.mapInArrow(forest, "a long, b long"), label)  # a > b
    was = state(now)
    for _ in range(rounds):
        if not was[0]:
            break
        few = 1 + was[0] // 200_000  # tasks that write, in step with the edges
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(few), label)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large.coalesce(few), label)
        low = written(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(few), label)
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        after = written(small.where("a <> b").distinct().coalesce(few), label)
        for old in (now, least, large, low):
            drop_written(old)
        now, state_after = after, state(after)
        if state_after == was:
            break
        was = state_after
    else:
        raise RuntimeError("components did not settle")
    every = now.select(F.col("a").alias("node"), "b").union(now.select("b", "b"))
    return every.groupBy("node").agg(F.min("b").alias("component"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the public splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
