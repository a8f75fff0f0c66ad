import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.functions import pg
from shardloom.functions.canonical import UnsupportedShardKeyType, canonical, decimal_text, float_text, literal_text, spark_type, type_family
from shardloom.functions.hashing import LOW_OFFSET, fnv1a64, literal_vshard, modulo_owners, vshard
from shardloom.functions.sqltext import first_keyword, merged_tag, normalize_sql, redacted_dsn, row_count_tag, sqlstate_category, statement_name


@pytest.mark.parametrize(("value", "kind", "text"), [
    ("01", "bigint", "1"), ("+5", "int4", "5"), (" -7 ", "pg_catalog.int8", "-7"), ("x", "integer", None),
    ("1.50", "numeric(18,2)", "1.5"), ("-0.00", "numeric", "0"), ("1e3", "decimal", "1000"), (".5", "numeric", "0.5"), ("12e-3", "numeric", "0.012"), ("1.2.3", "numeric", None),
    ("YES", "bool", "true"), ("off", "boolean", "false"), ("maybe", "bool", None),
    ("{A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11}", "uuid", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"), ("a0ee", "uuid", None),
    ("ab  ", "char(4)", "ab"), ("ab  ", "text", "ab  "), ("2024-01-01", "date", None), ("7", None, "7"),
    ("1000000", "float8", "1e+06"), ("0.00001", "float8", "1e-05"), ("1.0", "real", "1"), ("0.1", "float4", "0.1"), ("123456.5", "float8", "123456.5"),
])
def test_literal_text(value, kind, text):
    assert literal_text(value, kind) == text


def test_types():
    assert type_family("VARCHAR(20)") == "text"
    with pytest.raises(UnsupportedShardKeyType):
        type_family("int4[]")
    with pytest.raises(UnsupportedShardKeyType):
        type_family("timestamptz")
    assert spark_type("numeric(18,2)").simpleString() == "decimal(18,2)"
    assert spark_type("smallint").simpleString() == "smallint"
    assert spark_type("timestamptz").simpleString() == "timestamp"


@pytest.mark.parametrize(("key", "slot"), [("", 8997), ("a", 60556), ("42", 37411), ("eu-west\x0042", 45977), ("日本", 52881)])
def test_hash_anchors(spark, key, slot):
    assert fnv1a64(key.encode()) % 65536 == slot
    row = spark.createDataFrame([(key,)], "k string").select(vshard(["k"], ["text"]).alias("v")).first()
    assert row["v"] == slot


def test_vshard_null_and_compound(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (2, None)], "x long, y string")
    got = [r["v"] for r in df.select(vshard(["x", "y"], ["bigint", "text"]).alias("v")).collect()]
    assert got == [literal_vshard(["1", "a"], ["bigint", "text"]), None, None]
    assert LOW_OFFSET == 8997


@settings(max_examples=60, deadline=None)
@given(st.decimals(allow_nan=False, allow_infinity=False, places=4, min_value=-10**9, max_value=10**9))
def test_decimal_text_is_canonical(d):
    a = decimal_text(str(d))
    assert decimal_text(a) == a == decimal_text(f"{d:f}00") and "e" not in a.lower()


def test_canonical_columns_match_literals(spark):
    from decimal import Decimal

    rows = [(1, Decimal("1.50"), "t", 0.1), (-3, Decimal("-0.25"), "f", 1e7), (0, Decimal("0.00"), "1", 2.0), (7, Decimal("100.00"), "x", 1e-9)]
    df = spark.createDataFrame(rows, "i long, d decimal(18,2), b string, f double")
    got = df.select(canonical("i", "bigint").alias("i"), canonical("d", "numeric").alias("d"), canonical("b", "bool").alias("b"), canonical("f", "float8").alias("f")).collect()
    for (i, d, b, f), g in zip(rows, got, strict=True):
        assert tuple(g) == (literal_text(str(i), "bigint"), literal_text(str(d), "numeric"), literal_text(b, "bool"), float_text(f))


def test_modulo_owners():
    assert modulo_owners(["b", "a"])[:4] == ["b", "a", "b", "a"]
    assert modulo_owners(["c", "a", "b"])[:4] == ["c", "a", "b", "c"]


def test_sql_text(spark):
    cases = {
        "SELECT 'it''s', 42 /* c */ FROM t -- x": "SELECT ?, ? FROM t",
        "select $1::int4 as value": "select $?::int4 as value",
        "  \n ": "<empty query>",
        "select 1e5": "select 1e5",
    }
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    assert [r[0] for r in df.select(normalize_sql("q")).collect()] == list(cases.values())
    long = spark.createDataFrame([("select " + "a" * 400,)], "q string").select(normalize_sql("q")).first()[0]
    assert len(long) == 301 and long.endswith("…")
    words = spark.createDataFrame([("/* a */ -- b\n  insert into t",), ("",)], "q string")
    assert [r[0] for r in words.select(first_keyword("q")).collect()] == ["INSERT", ""]


def test_tags_and_codes(spark):
    assert merged_tag(["INSERT 0 2", "INSERT 0 3"]) == "INSERT 0 5"
    assert merged_tag(["UPDATE 1", "DELETE 1"]) == "FANOUT"
    assert merged_tag(["CREATE TABLE", "CREATE TABLE"]) == "CREATE TABLE"
    df = spark.createDataFrame([("COPY 4", "23505"), ("BEGIN", "")], "t string, c string")
    got = df.select(row_count_tag("t").alias("r"), sqlstate_category("c").alias("c")).collect()
    assert (got[0]["r"]["command"], got[0]["r"]["rows"], got[0]["c"]) == ("COPY", 4, "data_error")
    assert (got[1]["r"]["rows"], got[1]["c"]) == (None, "postgres_error")
    assert len(statement_name("select $1", [23])) == 5 + 24 and statement_name("a", [23]) != statement_name("a", [25])
    assert redacted_dsn("postgres://u:secret@h:5432/db?x=1")[0] == "h:5432/db"
    assert redacted_dsn("host=h password=p")[0] == "configured-endpoint"


def test_pg_aggregates(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, None, 1), (1, "a", 3), (2, None, 1)], "g int, v string, o int")
    got = {r["g"]: r for r in df.groupBy("g").agg(pg.array_agg("v", "o").alias("a"), pg.string_agg("v", "-", "o").alias("s"), pg.json_agg_strict("v", "o").alias("j"), pg.json_object_agg("o", "v", strict=True).alias("m")).collect()}
    assert got[1]["a"] == [None, "b", "a"] and got[1]["s"] == "b-a" and got[1]["j"] == '["b","a"]' and got[1]["m"] == '{"2":"b","3":"a"}'
    assert got[2]["a"] == [None] and got[2]["s"] is None and got[2]["j"] is None
    with pytest.raises(Exception, match="22030"):
        df.groupBy("g").agg(pg.json_object_agg("g", "v", unique=True)).collect()


def test_range_agg(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 10, 11), (1, 3, 3), (2, None, 4)], "g int, lo int, hi int")
    got = sorted(tuple(r) for r in pg.range_agg(df, ["g"], "lo", "hi").collect())
    assert got == [(1, 0, 7), (1, 9, 12)]


def test_with_ties_and_distinct_on(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, None), (5, None), (6, 9)], "k int, v int")
    assert sorted(r["k"] for r in pg.with_ties(df, 2, (F.col("v"), False)).collect()) == [1, 2, 3]
    assert sorted(r["k"] for r in pg.with_ties(df, 1, (F.col("v"), True)).collect()) == [4, 5]
    assert sorted(r["k"] for r in pg.with_ties(df, 5, (F.col("v"), False)).collect()) == [1, 2, 3, 4, 5, 6]
    assert pg.with_ties(df, 0, (F.col("v"), False)).count() == 0
    assert {(r["v"], r["k"]) for r in pg.distinct_on(df, ["v"], pg.desc("k")).collect()} == {(5, 2), (4, 3), (None, 5), (9, 6)}


def test_band_join_and_frames(spark):
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from shardloom.functions import pg

    rnd = random.Random(2)
    bands = [(i, rnd.uniform(-30, 30), rnd.uniform(0, 9)) for i in range(60)] + [(90, None, 1.0), (91, 5.0, -1.0), (92, 10.0, 0.0)]
    points = [(i, round(rnd.uniform(-40, 40), 1)) for i in range(150)] + [(900, None), (901, 10.0)]
    left, right = spark.createDataFrame(bands, "b int, low double, length double"), spark.createDataFrame(points, "p int, x double")
    got = pg.band_join(left, right, F.col("low"), F.col("low") + F.col("length"), F.col("x"), 4.0)
    want = {(b, p) for b, low, n in bands for p, x in points if low is not None and x is not None and low <= x <= low + n}
    assert got.columns == ["b", "low", "length", "p", "x"] and sorted((r["b"], r["p"]) for r in got.collect()) == sorted(want) and (92, 901) in want
    rows = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), ("a", 2, 1), ("a", 4, None), ("b", 1, None)], "g string, o int, v int")
    numbered, w = pg.groups_frame(rows, ["g"], [F.col("o")], -1, 0)
    assert sorted((r["g"], r["o"], r["s"]) for r in numbered.select("g", "o", F.sum("v").over(w).alias("s")).where("s is not null").collect()) == [("a", 1, 12), ("a", 1, 12), ("a", 2, 13), ("a", 4, 1)]
    rest = pg.exclude_current_row("v", Window.partitionBy("g"))
    got = {(r["o"], r["v"]): (r["s"], r["n"]) for r in rows.where("g = 'a'").select("o", "v", rest["sum"].alias("s"), rest["count"].alias("n")).collect()}
    assert got == {(1, 5): (8, 2), (1, 7): (6, 2), (2, 1): (12, 2), (4, None): (13, 3)}
    assert rows.where("g = 'b'").select(rest["sum"].alias("s")).first()["s"] is None
