from datetime import datetime, timedelta

from shardloom.streaming import telemetry

NOW = datetime(2024, 1, 1, 12, 0, 11)


def events(spark, rows):
    return spark.createDataFrame(rows, telemetry.SCHEMA)


def test_windows_reach_back_from_now(spark):
    rows = [(NOW - timedelta(seconds=11), "select 1", True, 10, ["a"], None), (NOW, "select 2", False, 5, ["a", "b"], "sql_error"), (NOW + timedelta(seconds=5), "late", True, 1, ["a"], None)]
    got = {r["window_name"]: r for r in telemetry.rolling(events(spark, rows), NOW).collect()}
    assert (got["10 seconds"]["queries"], got["1 minute"]["queries"]) == (1, 2)
    m = got["1 minute"]
    assert (m["failed"], m["scattered"], m["single"], m["total_ms"], m["average_ms"]) == (1, 1, 1, 15, 7)
    assert got["10 minutes"]["queries"] == 2
    assert telemetry.error_ratio(events(spark, rows), NOW).first()["ratio"] == 0.5


def test_histogram_and_quantile(spark):
    e = events(spark, [(NOW, "q", True, 7, ["a"], None)] * 100)
    got = {r["le"]: r["queries"] for r in telemetry.histogram(e).collect()}
    assert got[0.005] == 0 and got[0.01] == 100 and got[float("inf")] == 100
    assert abs(telemetry.quantile(e).first()["seconds"] - (0.005 + 0.005 * 0.95)) < 1e-9
    assert telemetry.quantile(events(spark, [])).count() == 0
    late = events(spark, [(NOW, "q", True, 60_000, ["a"], None)])
    assert telemetry.quantile(late).first()["seconds"] == 10


def test_shapes_and_counts(spark):
    rows = [(NOW, "select 1", True, 4, ["a"], None), (NOW, "select  2", True, 5, ["a"], None), (NOW, "insert into t values ('x')", False, 1, ["b"], "data_error")]
    e = events(spark, rows)
    top = telemetry.shapes(e).collect()
    assert (top[0]["shape"], top[0]["queries"], top[0]["average_ms"], top[0]["operation"]) == ("select ?", 2, 4, "SELECT")
    assert telemetry.shapes(e, 1).count() == 1
    assert {tuple(r) for r in telemetry.operations(e).collect()} == {("SELECT", "success", 2), ("INSERT", "failure", 1)}
    assert {tuple(r) for r in telemetry.failures(e).collect()} == {("data_error", 1)}
    assert telemetry.imbalance(e).first()["ratio"] == 2.0
    lines = [r["line"] for r in telemetry.openmetrics(telemetry.failures(e), "failures", "failures", "category").collect()]
    assert lines == ['failures{category="data_error"} 1']


def test_late_events_are_dropped_and_windows_come_once(spark, tmp_path):
    """Files come one by one; a window leaves the stream when the watermark has passed it."""
    at = lambda minutes: NOW + timedelta(minutes=minutes)
    batches = [[(at(0), "a", True, 1, ["s"], None), (at(1), "b", True, 2, ["s"], None)], [(at(30), "c", True, 3, ["s"], None)], [(at(0), "late", True, 9, ["s"], None), (at(31), "d", True, 4, ["s"], None)], [(at(90), "e", True, 5, ["s"], None)]]
    for i, rows in enumerate(batches):
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(telemetry.SCHEMA).parquet(f"{tmp_path}/in")
        telemetry.start_files(stream, f"{tmp_path}/out", f"{tmp_path}/state", "1 minute").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    got = {int((r["second"] - NOW.replace(second=0)).total_seconds() // 60): (r["queries"], r["total_ms"]) for r in out}
    assert len(out) == len(got) and got == {0: (1, 1), 1: (1, 2), 30: (1, 3), 31: (1, 4)}


def test_labels_are_cut_at_300_bytes(spark):
    from shardloom.functions.sqltext import normalize_sql

    texts = ["x" * 300, "x" * 301, "é" * 150, "é" * 151, "x" + "é" * 200, "x" * 299 + "日", "x" * 298 + "\U0001f600z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "q string").select(normalize_sql("q")).collect()]
    want = [t if len(t.encode()) <= 300 else t.encode()[:300].decode("utf-8", "ignore") + "…" for t in texts]
    assert got == want
