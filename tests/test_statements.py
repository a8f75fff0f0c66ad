"""Statements whose text PostgreSQL reads otherwise than Spark."""

import pytest

from shardloom.operators.ddl import FeatureNotSupported
from shardloom.plans.clauses import grouping_sets, null_order, rewritten
from shardloom.plans.engine import Engine
from shardloom.plans.routing import UnsafeRouting


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('statements')}", shards=["s1", "s2"])
    e.register("t", ["id"], ["bigint"])
    e.load("t", spark.createDataFrame([(1, 10, "a"), (2, None, "a"), (3, 30, "b"), (4, 30, "b"), (5, None, "c"), (6, 7, "c")], "id long, x int, g string"))
    e.register_unsharded("nation")
    e.attach("nation", spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string"))
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_quoted_text_is_left_alone(engine):
    got = engine.sql("select 'rows from nation are few' as a, 'public.nation' as b, '(a,b) = (1,2)' as c, 'order by x, 7/2 $1' as d, 'from t \U0001f600' as e, n.k from public.nation n where name <> 'join nation' order by k")
    assert rows(got)[0] == ("rows from nation are few", "public.nation", "(a,b) = (1,2)", "order by x, 7/2 $1", "from t \U0001f600", 1)
    assert rows(engine.sql("select '\U0001f600' as s, public.nation.name from public.nation where k = 2")) == [("\U0001f600", "y")]
    assert rows(engine.sql("select nation.name, (select max(nation.k) from nation) as m from nation where nation.k in (select t.id from t) order by 1")) == [("x", 2), ("y", 2)]
    assert rows(engine.sql("select count(*) as n from t, nation where (id, name) = (k, 'x')")) == [(1,)]


def test_nulls_come_last_ascending(engine):
    ids = lambda q: [r[0] for r in engine.sql(q).collect()]
    assert ids("select id from t order by x, id") == [6, 1, 3, 4, 2, 5]
    assert ids("select id from t order by x desc, id limit 3") == [2, 5, 3]
    assert ids("select id from t order by x nulls first, id desc") == [5, 2, 6, 1, 4, 3]
    assert rows(engine.sql("select id, row_number() over (order by x, id) as r from t where id in (2, 6) order by id")) == [(2, 2), (6, 1)]


def test_integers_divide_to_integers(engine):
    got = engine.sql("select 7/2 as a, -7/2 as b, id/2 as c, id/2/2 as d, 7/2.0 as e, cast(7 as double)/2 as f, (id + 8) / (1 + 1) * 2 as g, '7/2' as h, sum(id)/2 as i from t where id = 5 group by id")
    a, b, c, d, e, f, g, h, i = rows(got)[0]
    assert (a, b, c, d, float(e), f, g, h, i) == (3, -3, 2, 1, 3.5, 3.5, 12, "7/2", 2)
    assert rows(engine.sql("select id from t where id / 4 = 1 order by id")) == [(4,), (5,), (6,)]
    assert rows(engine.sql("select k from nation where k in (select id / 3 from t) order by k")) == [(1,), (2,)]


def test_distinct_on(engine):
    assert rows(engine.sql("select distinct on (g) g, id, x from t order by g, x desc, id")) == [("a", 2, None), ("b", 3, 30), ("c", 5, None)]
    assert rows(engine.sql("select count(*) as n from (select distinct on (g, x) id from t) q")) == [(5,)]
    assert rows(engine.sql("select distinct on (h) upper(g) as h, id from t order by h, id desc limit 2")) == [("A", 2), ("B", 4)]
    with pytest.raises(ValueError, match="42P10"):
        engine.sql("select distinct on (g) g from t order by id")


def test_fetch_with_ties(engine):
    ids = lambda q: sorted(r[0] for r in engine.sql(q).collect())
    assert ids("select id from t order by x fetch first 3 rows with ties") == [1, 3, 4, 6]
    assert ids("select id from t order by x desc fetch first row with ties") == [2, 5]
    assert ids("select id from t order by x desc, id offset 1 fetch next 2 rows with ties") == [3, 5]
    assert ids("select distinct g from t order by g fetch first 2 rows with ties") == ["a", "b"]
    assert rows(engine.sql("select count(*) as n from (select id from t order by g fetch first 3 rows with ties) q")) == [(4,)]
    with pytest.raises(ValueError, match="42601"):
        engine.sql("select id from t fetch first 2 rows with ties")
    with pytest.raises(FeatureNotSupported):
        engine.sql("select id from t union select 1 order by id fetch first 2 rows with ties")


def test_group_by_distinct(engine):
    assert grouping_sets("rollup(a, (b, c))") == [("a", "b", "c"), ("a",), ()]
    assert grouping_sets("grouping sets ((a), cube(b, c), ())") == [("a",), ("b", "c"), ("b",), ("c",), (), ()]
    got = rows(engine.sql("select g, x, count(*) as n from t group by distinct rollup(g, x), rollup(g) order by g, x, n"))
    assert got == rows(engine.sql("select g, x, count(*) as n from t group by grouping sets ((g, x), (g), ()) order by g, x, n"))
    assert len(rows(engine.sql("select g, count(*) as n from t group by all rollup(g), rollup(g)"))) > len(rows(engine.sql("select g, count(*) as n from t group by distinct rollup(g), rollup(g)"))) == 4


def test_hints_reach_the_plan(engine):
    plan = engine.sql("select /*+ merge(n) */ count(*) as c from t join nation n /* not a hint */ on t.id = n.k -- end")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_rewriting_is_local():
    for q in ("select a from t where b is distinct from c", "select extract(year from d) from t", "select * except (a) from t"):
        assert rewritten(q) == q == null_order(q)
    assert null_order("select listagg(a) within group (order by b) from t order by f(a, b) desc;") == "select listagg(a) within group (order by b asc nulls last) from t order by f(a, b) desc nulls first;"


def test_numbered_parameters(engine):
    q = "select id from t where id = $2 and x > $1"
    assert rows(engine.sql(q, [5, 3])) == [(3,)]
    assert engine.prepare(q).route([5, 3]).kind == "single_shard"
    p = "select id from t where x > ? and id = ?"
    assert rows(engine.sql(p, [5, 3])) == [(3,)] and engine.planner.analyze(p, [5, 3]).kind == "single_shard"
    assert engine.planner.analyze(p, [5]).kind == "append_scatter"


def test_merge_text(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/m", shards=["s1", "s2"])
    e.ddl("create table d (k int, v text, n int)")
    e.load("d", spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "when matched then", 4)], "k int, v string, n int"))
    e.register_unsharded("s")
    e.attach("s", spark.createDataFrame([(1, "A"), (2, None), (9, "new"), (10, "skip")], "k int, v string"))
    said = e.execute("merge into d using s on d.k = s.k when matched and s.v is null then delete when matched then update set v = s.v || ' when not matched', n = d.n + 10 when not matched and s.v <> 'skip' then insert (k, v) values (s.k, s.v)")
    assert said.tag == "MERGE 3"
    assert sorted(rows(e.table("d")), key=str) == [(1, "A when not matched", 11), (3, "c", 3), (4, "when matched then", 4), (9, "new", None)]
    with pytest.raises(ValueError, match="21000"):
        e.execute("merge into d as x using (select 1 as k from s) as y on x.k = y.k when matched then update set n = 0")
    e.execute("merge into d as x using (select k from s where k > 9) as y on x.k = y.k when not matched then insert values (y.k, 'z', 0)")
    assert e.table("d").count() == 5
    assert e.execute("merge into d using s on d.k = s.k when matched then do nothing when not matched and s.k = 2 then insert values (2, 'back', null) when not matched then do nothing").rows == 1
    assert e.table("d").count() == 6
    with pytest.raises(UnsafeRouting):
        e.register("h", ["k"], ["bigint"])
        e.execute("merge into h using s on h.k = s.k when matched then delete")


def test_create_as_and_refusals(engine):
    assert engine.execute("create table counts as select g, count(*) as n from t group by g").tag == "SELECT 3"
    assert rows(engine.sql("select g, n from counts order by g")) == [("a", 2), ("b", 2), ("c", 2)]
    assert engine.execute("select id, 'into x' as s into few from t where id < 3").rows == 2 and engine.table("few").columns == ["id", "s"]
    with pytest.raises(ValueError, match="42P07"):
        engine.execute("create table counts as select 1 as a")
    assert engine.execute("create table if not exists counts as select 1 as a").rows == 0
    with pytest.raises(FeatureNotSupported, match="0A000"):
        engine.execute("insert into t (id) values (1) on conflict (id) do nothing")
    with pytest.raises(FeatureNotSupported):
        engine.sql("select id from t for update")


def test_batches_change_tables_together(spark, tmp_path):
    from pyspark.sql import functions as F

    from shardloom.sources.store import Conflict

    e = Engine(spark, f"file://{tmp_path}/b", shards=["s1", "s2"])
    e.register("a", ["k"], ["bigint"])
    e.register_unsharded("u")
    e.load("a", spark.range(20).selectExpr("id as k", "0 as v"))
    e.load("u", spark.range(3).selectExpr("id as k"))
    before = e.storage.revision("a")
    with e.batch() as b:
        assert b.update("a", {"v": F.lit(1)}, F.col("k") < 5) == 5
        b.insert("u", spark.range(3, 4).selectExpr("id as k"))
    assert e.storage.revision("a") == before + 1 and e.sql("select sum(v) as s from a").first()["s"] == 5 and e.table("u").count() == 4
    with pytest.raises(Conflict), e.batch() as b:
        assert b.delete("u", F.col("k") > 0) == 3
        b.update("a", {"v": F.lit(9)}, F.col("k") == 3)
        e.load("a", spark.range(100, 101).selectExpr("id as k", "0 as v"))  # another writer is first
    assert e.table("u").count() == 4 and e.sql("select max(v) as m from a").first()["m"] == 1
    assert e.delete("u", F.col("k") > 0).rows == 3 and e.table("u").count() == 1


def test_versions_are_one_scan_and_compact(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/v", shards=["s1", "s2"])
    e.register("a", ["k"], ["bigint"])
    e.storage.MANY = 5
    for i in range(4):
        e.load("a", spark.range(10 * i, 10 * i + 10).selectExpr("id as k", "0 as v"))
    e.execute("update a set v = 7 where k = 12")
    plan = e.table("a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Union" not in plan
    assert len(e.storage._content("a")["versions"]) == 5 and e.table("a").count() == 40
    e.load("a", spark.range(40, 41).selectExpr("id as k", "0 as v"))  # many: compacted
    assert len(e.storage._content("a")["versions"]) == 1 and e.sql("select sum(v) as s, count(*) as n from a").first() == (7, 41)
    assert e.storage.vacuum("a") == 6 and e.table("a").count() == 41
    e.load("a", spark.range(41, 42).selectExpr("id as k", "0 as v"))
    assert e.compact("a", vacuum=True) == 2 and e.sql("select v from a where k = 41").first()["v"] == 0


def test_a_stream_batch_is_published_once(spark, tmp_path):
    from shardloom.sources.store import Conflict

    e = Engine(spark, f"file://{tmp_path}/s", shards=["s1"])
    e.register_unsharded("u")
    rows = spark.range(2).selectExpr("id as k")
    for number in (0, 1):
        with e.batch() as b:
            b.insert("u", rows)
            b.mark("stream", number)
    with pytest.raises(Conflict), e.batch() as b:
        b.insert("u", rows)
        b.mark("stream", 1)
    assert e.storage.mark("stream") == 1 and e.storage.mark("other") == -1 and e.table("u").count() == 4


def test_colocated_join_does_not_shuffle(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/j", shards=["s1", "s2"])
    for t in ("a", "b"):
        e.register(t, ["k"], ["bigint"])
    e.load("a", spark.range(500).selectExpr("id as k", "id % 7 as x"))
    e.load("b", spark.range(900).selectExpr("id % 450 as k", "id as y"))
    q = "select a.k, count(*) as n, sum(y) as s from a join b on a.k = b.k group by a.k"
    plan = lambda: e.sql(q)._jdf.queryExecution().executedPlan().toString()
    want = sorted(rows(e.sql(q)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" in plan()
        e.colocate("a", "b", buckets=6)
        assert "Exchange" not in plan() and "SortMergeJoin" in plan()
        assert sorted(rows(e.sql(q))) == want and len(want) == 450
        assert e.sql("select x from a where k = 9", strict=True).first()["x"] == 2
        e.execute("update b set y = 0 where k = 3")  # the copy is of an older revision
        assert "Exchange" in plan() and [r for r in rows(e.sql(q)) if r[0] == 3] == [(3, 2, 0)]
        e.colocate("b", buckets=6)
        assert "Exchange" not in plan() and [r for r in rows(e.sql(q)) if r[0] == 3] == [(3, 2, 0)]
        e.storage.drop("b")  # made anew by another writer
        e.load("b", spark.createDataFrame([(5, 50)], "k long, y long"))
        assert rows(e.sql(q)) == [(5, 1, 50)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_replicated_tables_are_not_broadcast(spark, tmp_path, monkeypatch):
    from shardloom.plans import engine as module

    e = Engine(spark, f"file://{tmp_path}/r", shards=["s1"])
    e.register_unsharded("d", "replicated")
    e.attach("d", spark.range(1000).selectExpr("id as k"))
    assert "ResolvedHint" in e.table("d")._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(module, "REPLICATED_MOST", 10)
    assert "ResolvedHint" not in e.table("d")._jdf.queryExecution().analyzed().toString()


def test_ordered_aggregates_as_text(engine):
    got = rows(engine.sql("select g, json_agg(x order by x desc, id) as a, json_agg_strict(x order by id) as b, json_object_agg(id, g order by id) as o, xmlagg('<' || g || '>' order by id) as m from t group by g order by g"))
    assert got == [("a", "[null,10]", "[10]", '{"1":"a","2":"a"}', "<a><a>"), ("b", "[30,30]", "[30,30]", '{"3":"b","4":"b"}', "<b><b>"), ("c", "[null,7]", "[7]", '{"5":"c","6":"c"}', "<c><c>")]
    got = rows(engine.sql("select array_agg(id order by x desc, id) as a, array_agg(id order by x, id desc) as b, array_agg(id order by x nulls first, id) filter (where id < 4) as c from t"))
    assert got == [([2, 5, 3, 4, 1, 6], [6, 1, 4, 3, 5, 2], [2, 1, 3])]
    assert rows(engine.sql("select json_agg('it''s, \"order by\" ' || g order by id) as a from t where id = 1")) == [('["it\'s, \\\\"order by\\\\" a"]'.replace("\\\\", "\\"),)]
    assert rows(engine.sql("select json_agg(id) filter (where id > 100) as a, string_agg(g, ',' order by id) filter (where x > 9) as s from t")) == [(None, "a,b,b")]


def test_a_schema_batch_is_all_or_nothing(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/x", shards=["s1", "s2"])
    e.ddl("create table kept (k bigint, v text); comment on column kept.k is 'app.shard_key'")
    e.load("kept", spark.range(5).selectExpr("id as k", "'a' as v"))
    before = e.registry, e.topology, e.storage.store.latest("tables")
    for bad in ("create table fresh (k int); create table kept (k int)", "alter table kept add column n int; truncate kept; drop table missing", "drop table kept; comment on column nowhere.k is 'app.shard_key'"):
        with pytest.raises((ValueError, LookupError)):
            e.ddl(bad)
        assert (e.registry, e.topology, e.storage.store.latest("tables")) == before and e.table("kept").columns == ["k", "v"] and e.table("kept").count() == 5
    revision = before[2][0]
    e.ddl("alter table kept add column n int; create table other (a int); drop table if exists missing")
    assert e.storage.store.latest("tables")[0] == revision + 1 and e.table("kept").count() == 5 and e.table("other").columns == ["a"]
    e.ddl("drop table kept; create table kept (z text)")
    assert e.table("kept").columns == ["z"] and e.registry.sharded("kept") is None
