import threading

import pytest

from shardloom.operators.ddl import FeatureNotSupported, check_ddl, classify, normalize_ddl, shard_key_comment, statements
from shardloom.operators.report import digest, missing, regressions, schedule, summary, tap_results
from shardloom.sources.registry import Registry, table_name
from shardloom.sources.store import Conflict, IdAllocator, ManifestStore
from shardloom.sources.topology import Shard, Topology, bootstrap


def registry():
    return Registry().with_sharded("accounts", ["tenant_id"], ["bigint"]).with_sharded("copy_e2e", ["region", "tenant_id"], ["text", "bigint"]).with_unsharded("dim", "replicated")


def test_names():
    assert table_name("Accounts") == table_name("public.accounts") == "public.accounts"
    assert table_name('"QuotedRoutes"') == "public.QuotedRoutes"
    assert table_name('s."T"') == "s.T"


def test_registry_round_trip_and_fingerprint():
    r = registry()
    assert Registry.from_json(r.to_json()) == r
    assert r.fingerprint() == r.with_unsharded("other").fingerprint()
    assert r.fingerprint() != r.with_sharded("t", ["a"], ["int"]).fingerprint()
    with pytest.raises(ValueError):
        r.with_sharded("t", ["a", "b"], ["int", "int"], generated=True)
    with pytest.raises(ValueError):
        Registry.from_json({"format": 3})


def test_bootstrap_and_transitions(spark):
    t = bootstrap(registry(), ["s2", "s1"])
    t.validate_schema(registry())
    assert t.distribution("public.accounts").owner(1) == "s1" and t.distribution("public.accounts").owner(2) == "s2"
    assert Topology.from_json(t.to_json()) == t
    new = t.with_shard(Shard("s3", "adding"), 1.0)
    t.validate_transition(new)
    with pytest.raises(ValueError, match="adding"):
        t.validate_transition(t.with_shard(Shard("s3", "ready"), 1.0))
    with pytest.raises(ValueError, match="can't go"):
        t.validate_transition(t.with_shard(Shard("s1", "removed"), 1.0))
    with pytest.raises(ValueError, match="another schema"):
        t.validate_schema(registry().with_sharded("x", ["a"], ["int"]))
    ready = new.with_shard(Shard("s3"), 2.0)
    moved = ready.distribution("public.accounts").moved([0, 5], "s3")
    assert moved.owner(5) == "s3" and moved.owner(6) == "s2"
    rows = {r["shard"]: r["count"] for r in moved.to_dataframe(spark).groupBy("shard").count().collect()}
    assert rows == {"s1": 32767, "s2": 32767, "s3": 2}


def test_manifests_swap_once(spark, tmp_path):
    store = ManifestStore(spark, f"file://{tmp_path}/c")
    assert store.latest("x") == (0, None)
    store.publish("x", 1, {"a": 1})
    with pytest.raises(Conflict):
        store.publish("x", 1, {"a": 2})
    assert store.update("x", lambda now: now) == (1, {"a": 1})
    assert store.update("x", lambda now: now | {"b": 2})[0] == 2
    (tmp_path / "c/x/3.json").write_text('{"a"')  # its writer died
    assert store.latest("x") == (3, {"a": 1, "b": 2})
    assert store.update("x", lambda now: now | {"c": 3}) == (4, {"a": 1, "b": 2, "c": 3})


def test_ids_are_unique_across_writers(spark, tmp_path):
    ids = [IdAllocator(ManifestStore(spark, f"file://{tmp_path}/ids")) for _ in range(2)]
    got: list[int] = []
    work = [threading.Thread(target=lambda a=a: got.extend(a.reserve("t", 1) for _ in range(8))) for a in ids]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert sorted(got) == list(range(1, 17))
    df = ids[0].numbered(spark.range(100).selectExpr("id as v"), "t", "key", "v")
    assert sorted((r["key"], r["v"]) for r in df.collect()) == [(17 + i, i) for i in range(100)]
    with pytest.raises(OverflowError):
        ids[0].reserve("t", 2**63)


@pytest.mark.parametrize(("sql", "out"), [
    ("CREATE TABLE t (id serial PRIMARY KEY, n text)", "CREATE TABLE t (id BIGINT PRIMARY KEY GENERATED BY DEFAULT AS IDENTITY, n text)"),
    ("CREATE TABLE t (id int GENERATED ALWAYS AS IDENTITY)", "CREATE TABLE t (id BIGINT GENERATED BY DEFAULT AS IDENTITY)"),
    ("ALTER TABLE t ADD COLUMN id bigserial", "ALTER TABLE t ADD COLUMN id BIGINT GENERATED BY DEFAULT AS IDENTITY"),
    ("ALTER TABLE t ALTER id SET GENERATED ALWAYS", "ALTER TABLE t ALTER id SET GENERATED BY DEFAULT"),
    ("ALTER TABLE t ALTER id ADD GENERATED ALWAYS AS IDENTITY", "ALTER TABLE t ALTER id ADD GENERATED BY DEFAULT AS IDENTITY"),
])
def test_normalize_ddl(sql, out):
    got = normalize_ddl(sql)
    assert (got.sql, got.changed, got.schema) == (out, True, True)
    assert not normalize_ddl(out).changed


@pytest.mark.parametrize("sql", ["CREATE TABLE t (id bigint, v numeric(18,2) DEFAULT 0)", "CREATE TABLE p OF kind (a WITH OPTIONS DEFAULT 0)", "SELECT 1"])
def test_ddl_left_alone(sql):
    assert normalize_ddl(sql).sql == sql


@pytest.mark.parametrize("sql", ["create database d", "DROP TABLESPACE x", "alter system set a = 1", "create or replace function f() returns int as $$ select 1; $$", "create index concurrently i on t (a)", "begin; create table t (a int)", "create temp table x (a int); create table y (a int)"])
def test_refused_ddl(sql):
    with pytest.raises(FeatureNotSupported, match="0A000"):
        check_ddl(sql)


def test_statement_classes():
    assert statements("select ';'; -- x;\n select $$;$$ ;") == ["select ';'", "select $$;$$"]
    for sql, kind in {"select 1": "query", "with x as (insert into t values (1)) select 1": "write", "create temp table a (b int)": "temporary", "drop table t": "ddl", "begin": "transaction", "copy t from stdin": "copy", "select * into n from t": "ddl", "vacuum": "utility"}.items():
        assert classify(sql) == kind, sql
    assert shard_key_comment("comment on column public.t.id is 'app.shard_key'") == ("public.t", "id")
    assert shard_key_comment("comment on column t.id is 'other'") is None


def test_report(spark):
    lines = spark.createDataFrame([(x,) for x in ("ok 1 - boolean 120 ms", "not ok 2 + char 5 ms", "ok 3 - text 1 ms # SKIP no locale", "1..3", "# note")], "value string")
    got = {r["test"]: (r["number"], r["status"], r["ms"]) for r in tap_results(lines).collect()}
    assert got == {"boolean": (1, "pass", 120), "char": (2, "fail", 5), "text": (3, "skip", 1)}
    plan = schedule(spark.createDataFrame([("test: boolean char",), ("# x",), ("test: money",)], "value string"))
    assert {r["test"] for r in missing(plan, tap_results(lines)).collect()} == {"money"}
    before = spark.createDataFrame([("char", "pass"), ("money", "pass"), ("text", "fail")], "test string, status string")
    assert {(r["test"], r["now"]) for r in regressions(before, tap_results(lines)).collect()} == {("char", "fail"), ("money", "missing")}
    assert {r["status"]: r["tests"] for r in summary(tap_results(lines)).collect()} == {"pass": 1, "fail": 1, "skip": 1}
    same = spark.createDataFrame([("at 12:01",), ("at 13:59",)], "t string").select(digest("t", (r"\d+:\d+", "TIME")).alias("d")).distinct()
    assert same.count() == 1
