"""COPY from a growing folder: rows of new files go to their shards, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.engine import Engine
from ..sources.store import Conflict
from ..sources.copy_format import CopyPlan, decoded


def copied_stream(engine: Engine, path: str, plan: CopyPlan, schema: StructType) -> DataFrame:
    """The rows of text or CSV files as a stream, in the types of schema."""
    return decoded(engine.spark.readStream.text(path, wholetext=True), plan, schema)


def copy_stream(engine: Engine, table: str, path: str, plan: CopyPlan, checkpoint: str) -> StreamingQuery:
    """Load what is in the folder and stop; run again for later files.

    Each micro-batch is one publication, so readers see its rows together, and its number is part
    of that revision: a batch that is repeated after a crash is passed over, whenever it came.
    """
    schema = engine.table(table).schema
    stream = f"{table} {checkpoint}"

    def load(rows: DataFrame, number: int) -> None:
        if number <= engine.storage.mark(stream):
            return
        try:
            with engine.batch() as b:
                b.insert(table, rows)
                b.mark(stream, number)
        except Conflict:
            if number > engine.storage.mark(stream):
                raise

    return copied_stream(engine, path, plan, schema).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
