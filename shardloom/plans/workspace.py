"""Engines over the tables of a folder, kept for the session."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

from .engine import Engine

SHARDED = {
    "lineitem": (["l_orderkey"], ["bigint"], "a"),
    "orders": (["o_orderkey"], ["bigint"], "a"),
    "customer": (["c_custkey"], ["bigint"], "a"),
    "events": (["user_id", "event_type"], ["bigint", "text"], "a"),
    "part": (["p_partkey"], ["bigint"], "b"),
    "supplier": (["s_suppkey"], ["bigint"], "b"),
}
UNSHARDED = {"nation": "replicated", "region": "replicated"}

_engines: dict[tuple, Engine] = {}
_folders: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, uri in _folders:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone; what is left is scratch  # noqa: BLE001, S110
            pass


def folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share; removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='shardloom-')}"
        _folders.append((spark, base))
    uri = f"{base.rstrip('/')}/shardloom-{label}-{uuid.uuid4().hex}"
    _folders.append((spark, uri))
    return uri


def engine(spark: SparkSession, sf_dir: str, *, layout: bool = False) -> Engine:
    """The tables of sf_dir as a logical database.

    layout=False backs them by the plain files; layout=True stores each sharded table in the
    sharded layout, once a session, when a statement first names it.
    """
    key = (spark.sparkContext.applicationId, sf_dir, layout)
    if key in _engines:
        return _engines[key]
    e = Engine(spark, folder(spark, "tables"), shards=["shard1", "shard2"])
    for name, (columns, types, distribution) in SHARDED.items():
        e.register(name, columns, types, distribution=distribution)
    for name, policy in UNSHARDED.items():
        e.register_unsharded(name, policy)
    for name in (*SHARDED, *UNSHARDED):
        plain = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if layout and name in SHARDED:
            e.defer(name, plain)
        else:
            e.attach(name, plain)
    _engines[key] = e
    return e
