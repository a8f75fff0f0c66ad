import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from shardloom.sources.copy_format import SIGNATURE, CopyError, binary_records, copy_in, copy_out, csv_records, decode_text, encode_csv, encode_text, numeric_from_binary, numeric_to_binary, plan_copy, split_text, text_records
from shardloom.sources.registry import Registry

REGISTRY = Registry().with_sharded("t", ["region", "tenant_id"], ["text", "bigint"]).with_sharded("n", ["k"], ["numeric"])
COLUMNS = ["tenant_id", "region", "payload"]
CSV = plan_copy("t", COLUMNS, True, [("format", "csv"), ("delimiter", ";"), ("header", "true")], REGISTRY)
TEXT = plan_copy("t", COLUMNS, True, [], REGISTRY)


@pytest.mark.parametrize(("columns", "options"), [
    (COLUMNS, [("format", "csv"), ("FORMAT", "text")]), (COLUMNS, [("delimiter", "ab")]), (COLUMNS, [("delimiter", "\n")]), (COLUMNS, [("quote", "'")]),
    (COLUMNS, [("format", "binary"), ("header", "true")]), (COLUMNS, [("format", "csv"), ("delimiter", '"')]), (COLUMNS, [("encoding", "latin1")]),
    (COLUMNS, [("freeze", "true")]), ([], []), (["tenant_id", "payload"], []), (["tenant_id", "region", "region"], []), (COLUMNS, [("header", "perhaps")]), (COLUMNS, [("format", "xml")]),
])
def test_refused_options(columns, options):
    with pytest.raises(CopyError):
        plan_copy("t", columns, True, options, REGISTRY)


def test_binary_numeric_key_is_refused():
    with pytest.raises(CopyError):
        plan_copy("n", ["k"], True, [("format", "binary")], REGISTRY)
    assert plan_copy("other", [], False, []).delimiter == "\t"


def test_csv_quotes_and_nulls():
    data = '"0001";"eu;west";"a\nb"\n2;;""\n3;x;"say ""hi"""\r\n'
    assert list(csv_records(data, CSV)) == [["0001", "eu;west", "a\nb"], ["2", None, ""], ["3", "x", 'say "hi"']]
    for bad in ('"a', '"a"b;c', 'a"b'):
        with pytest.raises(CopyError, match="22P04"):
            list(csv_records(bad, CSV))


def test_text_escapes():
    assert split_text("hello\\tworld\teu\\\twest\t0007", TEXT) == ["hello\tworld", "eu\twest", "0007"]
    assert split_text("\\N\t\\\\N\t", TEXT) == [None, "\\N", ""]
    assert decode_text("\\x41\\101\\q\\b") == "AAq\b"
    assert list(text_records("a\\\nb\tc\n\\.\nrest")) == ["a\\\nb\tc"]
    with pytest.raises(CopyError):
        decode_text("a\\")


@settings(max_examples=200, deadline=None)
@given(st.text(), st.one_of(st.none(), st.text()))
def test_formats_give_texts_back(a, b):
    line = ";".join(encode_csv(x, CSV) for x in (a, b, "z")) + "\n"
    assert list(csv_records(line, CSV)) == [[a, b, "z"]]
    line = "\t".join("\\N" if x is None else encode_text(x, "\t") for x in (a, b, "z"))
    assert split_text(line, TEXT) == [a, b, "z"]


def test_binary_frames():
    row = b"\x00\x02\x00\x00\x00\x03abc\xff\xff\xff\xff"
    data = SIGNATURE + bytes(8) + row + row + b"\xff\xff"
    assert list(binary_records(data, 2)) == [[b"abc", None]] * 2
    for bad in (data[1:], data[:-2], data + b"x"):
        with pytest.raises(CopyError):
            list(binary_records(bad, 2))
    with pytest.raises(CopyError, match="columns"):
        list(binary_records(data, 3))


@pytest.mark.parametrize("options", [[], [("header", "true")], [("format", "csv")], [("format", "csv"), ("header", "match"), ("quote", "'"), ("escape", "\\")], [("format", "binary")]])
def test_round_trip(spark, tmp_path, options):
    schema = T.StructType.fromDDL("tenant_id long, region string, payload string, ok boolean, x double")
    rows = [(1, "eu", "plain", True, 1.5), (2, "us", "tab\tnew\nline \"q\" 'p' \\ back", False, None), (3, "", None, None, -2.25), (4, "\\N", "", True, 0.0)]
    df = spark.createDataFrame(rows, schema).repartition(2)
    path = f"file://{tmp_path}/out"
    assert copy_out(df, path, plan_copy("t", schema.names, False, options)) == 4
    back = copy_in(spark, f"{path}/part-*", plan_copy("t", schema.names, True, options, REGISTRY), schema)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_binary_round_trip_of_other_types(spark, tmp_path):
    import datetime
    from decimal import Decimal

    schema = T.StructType.fromDDL("tenant_id long, region string, d date, t timestamp, u timestamp_ntz, n decimal(20,5)")
    at = datetime.datetime(1999, 12, 31, 23, 59, 59, 999_999)
    rows = [(1, "a", datetime.date(1970, 1, 1), at, at, Decimal("-12345678.90001")), (2, "b", None, None, None, None), (3, "c", datetime.date(2026, 2, 28), datetime.datetime(2026, 1, 1), None, Decimal("0.00000")), (4, "d", None, None, None, Decimal("10000.00000"))]
    df = spark.createDataFrame(rows, schema)
    path = f"file://{tmp_path}/out"
    assert copy_out(df, path, plan_copy("t", schema.names, False, [("format", "binary")])) == 4
    back = copy_in(spark, f"{path}/part-*", plan_copy("t", schema.names, True, [("format", "binary")], REGISTRY), schema)
    assert sorted(back.collect(), key=lambda r: r[0]) == df.orderBy("tenant_id").collect()


@settings(max_examples=300, deadline=None)
@given(st.decimals(allow_nan=False, allow_infinity=False, places=7, min_value=-(10**25), max_value=10**25))
def test_numerics_in_binary(value):
    assert numeric_from_binary(numeric_to_binary(value)) == value


def test_known_numerics():
    from decimal import Decimal

    # the bytes that the server sends
    assert numeric_to_binary(Decimal("1234567.89")).hex() == "0003000100000002007b11d722c4"
    assert numeric_to_binary(Decimal("-0.001")).hex() == "0001ffff40000003000a" and numeric_to_binary(Decimal("0")).hex() == "0000000000000000"
    assert numeric_to_binary(Decimal("20000")).hex() == "00010001000000000002"
    with pytest.raises(CopyError):
        numeric_from_binary(b"123")


def test_text_files_with_end_marker_or_continued_records(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\teu\tx\n2\tus\ty\\\\\n")
    (tmp_path / "b.txt").write_text("3\teu\tone\\\ntwo\n4\tus\tz\n\\.\n5\tus\tbehind the end\n")
    schema = T.StructType.fromDDL("tenant_id long, region string, payload string")
    got = sorted(tuple(r) for r in copy_in(spark, f"{tmp_path}/*.txt", TEXT, schema).collect())
    assert got == [(1, "eu", "x"), (2, "us", "y\\"), (3, "eu", "one\ntwo"), (4, "us", "z")]


def test_long_rows_are_refused_in_every_format(spark, tmp_path, monkeypatch):
    from shardloom.sources import copy_format

    monkeypatch.setattr(copy_format, "MAX_ROW", 4)
    row = b"\x00\x01\x00\x00\x00\x05abcde"
    with pytest.raises(CopyError):
        list(binary_records(SIGNATURE + bytes(8) + row + b"\xff\xff", 1))
    with pytest.raises(CopyError, match="54000"):
        copy_format.checked(["abc", None, "de"])


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab;\"'\\\n\r\t.N", max_size=8)), min_size=1, max_size=20))
def test_cells_equal_the_plain_encoders(spark, values):
    from pyspark.sql import functions as F

    from shardloom.sources.copy_format import csv_cell, text_cell

    other = plan_copy("t", COLUMNS, False, [("format", "csv"), ("quote", "'"), ("escape", "\\"), ("null", "N")])
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", text_cell(F.col("v"), TEXT).alias("t"), csv_cell(F.col("v"), CSV).alias("c"), csv_cell(F.col("v"), other).alias("o")).collect():
        assert r["t"] == ("\\N" if r["v"] is None else encode_text(r["v"], "\t"))
        assert r["c"] == encode_csv(r["v"], CSV) and r["o"] == encode_csv(r["v"], other)
