import pytest
from pyspark.sql import functions as F

from shardloom.operators.ddl import FeatureNotSupported
from shardloom.plans.dialect import parse_copy, to_spark
from shardloom.plans.engine import Engine
from shardloom.sources.copy_format import plan_copy
from shardloom.streaming.ingest import copy_stream


@pytest.mark.parametrize(("sql", "out"), [
    ("select a from t fetch first row only", "select a from t limit 1"),
    ("select a from t where b ~ 'x' and c !~* 'y'", "select a from t where b rlike 'x' and c not rlike '(?i)y'"),
    ("select string_agg(a, ', ' order by b desc) from t", "select listagg(a, ', ') within group (order by b desc) from t"),
    ("select string_agg(upper(a), ',') from t", "select listagg(upper(a), ',') from t"),
    ("select p ->> 'k' from t where p -> 'j' = '1'", "select get_json_object(p, '$.k') from t where get_json_object(p, '$.j') = '1'"),
    ("select a from t where a = any (array(1, 2))", "select a from t where array_contains(array(1, 2), a)"),
    ("select '~ ''fetch first row only'' -> ' -- for update", "select '~ ''fetch first row only'' -> '  "),
])
def test_spellings(sql, out):
    assert to_spark(sql).strip() == out.strip()


@pytest.mark.parametrize("sql", ["select a from t for update", "select a from t for no key update nowait", "select a from t order by a fetch first 2 rows with ties"])
def test_refused_spellings(sql):
    with pytest.raises(FeatureNotSupported, match="0A000"):
        to_spark(sql)


def test_copy_statements():
    got = parse_copy("COPY s.t (A, \"B\") FROM STDIN WITH (FORMAT csv, DELIMITER ';', NULL 'it''s', HEADER)")
    assert got == {"table": "s.t", "query": None, "columns": ["a", "B"], "incoming": True, "place": None, "options": [("format", "csv"), ("delimiter", ";"), ("null", "it's"), ("header", "true")]}
    assert parse_copy("copy (select 1) to '/x'")["query"] == "select 1"
    with pytest.raises(FeatureNotSupported):
        parse_copy("copy t from program 'ls'" .replace("'ls'", ""))
    with pytest.raises(ValueError, match="42601"):
        parse_copy("copy (select 1) from stdin")


def engine(spark, path):
    e = Engine(spark, f"file://{path}", shards=["s1", "s2"])
    e.register("t", ["k"], ["bigint"])
    e.load("t", spark.range(3).selectExpr("id as k", "'a' as v"))
    return e


def test_copy_text_both_ways(spark, tmp_path):
    e = engine(spark, tmp_path / "e")
    assert e.copy(f"copy t to '{tmp_path}/out' with (format csv)").tag == "COPY 3"
    (tmp_path / "in.csv").write_text('k,v\n10,"x\ny"\n11,\n')
    assert e.copy(f"copy t (k, v) from '{tmp_path}/in.csv' with (format csv, header match)").tag == "COPY 2"
    assert {(r["k"], r["v"]) for r in e.table("t").where("k > 5").collect()} == {(10, "x\ny"), (11, None)}
    with pytest.raises(Exception, match="lists its columns"):
        e.copy(f"copy t from '{tmp_path}/in.csv'")
    (tmp_path / "bad.csv").write_text("20,ok\n,no key\n")
    with pytest.raises(Exception, match="23502"):
        e.copy(f"copy t (k, v) from '{tmp_path}/bad.csv' with (format csv)")
    assert e.table("t").where("k = 20").count() == 0  # nothing of a failed COPY is seen


def test_copy_to_follows_the_shards(spark, tmp_path):
    e = engine(spark, tmp_path / "e")
    e.load("t", spark.range(10, 400).selectExpr("id as k", "'a' as v"))
    assert e.copy(f"copy t to '{tmp_path}/out' with (format csv)").tag == "COPY 393"
    keys = [int(line.split(",")[0]) for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    owner = {r["k"]: r["_shard"] for r in e.placed_table("t").collect()}
    owners = [owner[k] for k in keys]
    assert sorted(keys) == sorted(owner) and owners == sorted(owners) and set(owners) == {"s1", "s2"}


def test_copy_stream(spark, tmp_path):
    e = engine(spark, tmp_path / "e")
    (tmp_path / "in").mkdir()
    plan = plan_copy("t", ["k", "v"], True, [("format", "csv")], e.registry)
    for name, text in (("a", "30,x\n31,y\n"), ("b", '32,"q\nz"\n')):
        (tmp_path / f"in/{name}.csv").write_text(text)
        copy_stream(e, "t", f"{tmp_path}/in", plan, f"{tmp_path}/ck").awaitTermination()
    assert {(r["k"], r["v"]) for r in e.table("t").where("k >= 30").collect()} == {(30, "x"), (31, "y"), (32, "q\nz")}


def test_batch_is_all_or_nothing(spark, tmp_path):
    e = engine(spark, tmp_path / "e")
    e.register("u", ["k"], ["bigint"])
    with pytest.raises(RuntimeError), e.batch() as b:
        b.insert("t", spark.range(50, 60).selectExpr("id as k", "'b' as v"))
        raise RuntimeError
    assert e.table("t").count() == 3
    with e.batch() as b:
        b.insert("t", spark.range(50, 60).selectExpr("'b' as v", "id as k"))
        b.insert("u", spark.range(2).selectExpr("id as k"))
    assert (e.table("t").count(), e.table("u").count()) == (13, 2)
    with pytest.raises(ValueError, match="42804"):
        e.load("t", spark.range(1).selectExpr("id as k", "1 as v"))


def test_rewrites_leave_other_directories(spark, tmp_path):
    e = engine(spark, tmp_path / "e")
    e.load("t", spark.range(100, 400).selectExpr("id as k", "'a' as v"))
    e.execute("update t set v = 'z' where k = 150")
    versions = e.storage._content("t")["versions"]
    assert [len(v["hidden"]) for v in versions] == [1, 1, 0]
    assert e.table("t").where("v = 'z'").count() == 1 and e.table("t").count() == 303
    e.delete("t", F.col("k") >= 100)
    assert e.table("t").count() == 3


def test_temporary_tables_and_sessions(spark, tmp_path):
    e = engine(spark, tmp_path / "e")
    e.create_temporary("t", spark.range(1).selectExpr("id as k"))
    assert e.sql("select count(*) as n from t").first()["n"] == 1 and e.planner.analyze("select * from t").kind == "unsharded"
    e.discard_temporary()
    assert e.sql("select count(*) as n from t").first()["n"] == 3 and e.planner.analyze("select * from t").kind == "append_scatter"
    other = e.session()
    other.spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert spark.conf.get("spark.sql.shuffle.partitions") != "3" and other.sql("select count(*) as n from t").first()["n"] == 3
