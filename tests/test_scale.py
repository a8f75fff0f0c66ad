"""What tasks hold and shuffle does not grow with a table."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.plans.engine import Engine
from shardloom.sources import copy_format, storage
from shardloom.sources.copy_format import SIGNATURE, CopyError, binary_records, copy_in, copy_out, csv_records, plan_copy, text_records

PLANS = [plan_copy("t", ["a", "b", "c"], True, [("format", "csv"), *more]) for more in ([], [("delimiter", ";"), ("null", "N")], [("quote", "'"), ("escape", "\\")])]


def test_large_tables_are_placed_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "SMALL", -1, raising=False)
    e = Engine(spark, f"file://{tmp_path}/db", shards=["shard1", "shard2"])
    e.register("t", ["k"], ["bigint"])
    df = spark.range(20_000, numPartitions=3).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    spark.sparkContext.setJobGroup(f"{tmp_path}", "load")
    try:
        e.load("t", df)
        status = spark.sparkContext.statusTracker()
        stages = {s for j in status.getJobIdsForGroup(f"{tmp_path}") for s in status.getJobInfo(j).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) == 1
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == before
    assert e.table("t").exceptAll(df).count() == 0 and e.table("t").count() == 20_000
    assert [tuple(r) for r in e.sql("select k, v from t where k = 4242").collect()] == [(4242, 0)]
    wrong = e.placed_table("t").where((F.col("_vshard") / storage.BUCKET).cast("int") != F.col("_vb"))
    assert wrong.count() == 0


@pytest.mark.parametrize("plan", PLANS)
def test_csv_in_parts_equals_csv_at_once(plan):
    deal = random.Random(1)
    q, d = plan.quote, plan.delimiter
    for _ in range(300):
        cells = ["", "x", "N", f"{q}{q}", f"{q}a{d}b{q}", f"{q}a\r\nb{q}", f"{q}{plan.escape}{q}{q}", f"{q}\n{q}", f"{q}{plan.escape}{plan.escape}{q}", "é😀"]
        data = "".join(d.join(deal.choices(cells, k=3)) + deal.choice(["\n", "\r\n", "\r"]) for _ in range(deal.randrange(5)))
        data = data + deal.choice(["", "\\.\nrest", "a,b"])
        size = deal.randrange(1, 5)
        parts = [data[i : i + size] for i in range(0, len(data), size)]
        assert list(csv_records(parts, plan)) == list(csv_records(data, plan))


def test_decoders_take_no_more_of_a_file_than_they_need():
    def endless(part):
        while True:
            yield part

    rows = csv_records(endless('1,"a\nb",\n'), PLANS[0])
    assert [next(rows) for _ in range(3)] == [["1", "a\nb", None]] * 3
    lines = text_records(endless("a\\\nb\nc"))
    assert [next(lines) for _ in range(2)] == ["a\\\nb", "ca\\\nb"]
    binary = binary_records(iter([SIGNATURE + bytes(8)[:5], bytes(3) + b"\0\1\0", b"\0\0\2a", b"b\xff", b"\xff"]), 1)
    assert list(binary) == [[b"ab"]]


def test_a_record_without_end_is_refused(monkeypatch):
    monkeypatch.setattr(copy_format, "MAX_ROW", 100)
    monkeypatch.setattr(copy_format, "CHUNK", 100, raising=False)
    for read in (lambda p: csv_records(p, PLANS[0]), text_records):
        with pytest.raises(CopyError, match="54000"):
            list(read(iter(['"' + "x" * 50] + ["y" * 50] * 1_000)))


@pytest.mark.parametrize("options", [[("header", "true")], [("format", "csv")], [("format", "csv"), ("header", "match")], [("format", "binary")]])
def test_files_of_many_pieces(spark, tmp_path, monkeypatch, options):
    monkeypatch.setattr(copy_format, "CHUNK", 7, raising=False)
    schema = T.StructType.fromDDL("k long, v string")
    rows = [(i, None if i % 5 == 0 else f"é😀 \"{i}\"\n,\\\t" * (i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, schema).coalesce(2)
    path = f"file://{tmp_path}/out"
    assert copy_out(df, path, plan_copy("t", schema.names, False, options)) == 200
    back = copy_in(spark, f"{path}/part-*", plan_copy("t", schema.names, True, options), schema)
    assert "explode" in back._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_binary_files_end_at_a_size(tmp_path, monkeypatch):
    import pyspark
    from pyspark.sql.types import LongType

    from shardloom.sources import _binary_sink

    monkeypatch.setattr(_binary_sink, "FILE", 100, raising=False)
    task = type("Task", (), {"partitionId": lambda s: 3, "taskAttemptId": lambda s: 9})()
    monkeypatch.setattr(pyspark, "TaskContext", type("Tasks", (), {"get": staticmethod(lambda: task)}))
    assert _binary_sink._Writer(f"file://{tmp_path}/b", [LongType()]).write(iter([(i,) for i in range(25)])).rows == 25
    files = sorted((tmp_path / "b").iterdir())
    assert len(files) == 4 and [int.from_bytes(r[0], "big") for f in files for r in binary_records(f.read_bytes(), 1)] == list(range(25))
