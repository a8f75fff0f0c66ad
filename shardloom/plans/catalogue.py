"""The registered queries of the engine and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pg
from ..functions.canonical import canonical
from ..functions.hashing import modulo_owner, vshard
from ..functions.sqltext import fingerprint, normalize_sql, row_count_tag, sqlstate_category, statement
from ..sources.copy_format import copy_in, copy_out, plan_copy
from ..streaming import telemetry
from .workspace import engine, folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that it must equal."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def text(name: str, sql: str, oracle: str | None = None) -> None:
    """Register a query that is SQL over the sharded layout; oracle: the same for DuckDB, if it differs."""
    query(oracle or sql, name)(lambda spark, sf_dir: engine(spark, sf_dir, layout=True).sql(sql))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global aggregate over the sharded layout."""
    return engine(spark, sf_dir, layout=True).sql("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(avg(l_discount), 4) as avg_disc, count(*) as n from lineitem group by l_returnflag, l_linestatus")


FLAGSHIP_SQL = "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(avg(l_discount), 4) as avg_disc, count(*) as n from lineitem group by l_returnflag, l_linestatus"
query(FLAGSHIP_SQL, "global_aggregate_sharded_layout")(flagship)

# --- placement ------------------------------------------------------------------------------


def slot_sql(key: str) -> str:
    """The virtual shard of a key text, for DuckDB."""
    code = f"hex(encode({key}))"
    return f"coalesce(list_reduce(list_transform(range(0, octet_length(encode({key}))), lambda i: ('0x' || substr({code}, (i * 2 + 1)::bigint, 2))::int), lambda h, b: (xor(h, b) * 435) & 65535, 8997), 8997)"


_LINE = slot_sql("cast(l_orderkey as varchar)")
_PAIR = slot_sql("cast(l_orderkey as varchar) || chr(0) || l_returnflag")


@query(f"select l_orderkey, l_linenumber, cast({_LINE} as integer) as vshard from lineitem")
def vshard_single_key(spark, sf_dir):
    return engine(spark, sf_dir).table("lineitem").select("l_orderkey", "l_linenumber", vshard(["l_orderkey"], ["bigint"]).alias("vshard"))


@query(f"select cast({_PAIR} as integer) as vshard, count(*) as n from lineitem group by 1")
def vshard_compound_key(spark, sf_dir):
    return engine(spark, sf_dir).table("lineitem").groupBy(vshard(["l_orderkey", "l_returnflag"], ["bigint", "text"]).alias("vshard")).agg(F.count("*").alias("n"))


@query(f"select 'shard' || case when v % 2 = 0 then 2 else v % 2 end as shard, count(*) as n, sum(v)::bigint as slots from (select {_LINE} as v from lineitem) group by 1")
def vshard_owner_counts(spark, sf_dir):
    rows = engine(spark, sf_dir).placed_table("lineitem")
    return rows.groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("n"), F.sum("_vshard").alias("slots"))


@query(f"select case when v % 3 = 0 then 3 else v % 3 end::integer as owner, count(*) as n from (select {_LINE} as v from lineitem) group by 1")
def owner_three_shards(spark, sf_dir):
    slot = vshard(["l_orderkey"], ["bigint"])
    return engine(spark, sf_dir).table("lineitem").groupBy(modulo_owner(slot, 3).alias("owner")).agg(F.count("*").alias("n"))


@query(f"select round(max(n) / min(n), 6) as ratio from (select {_LINE} % 2 as o, count(*)::double as n from lineitem group by 1)")
def shard_skew_ratio(spark, sf_dir):
    n = engine(spark, sf_dir).placed_table("lineitem").groupBy("_shard").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.max("n") / F.min("n"), 6).alias("ratio"))


@query("select t as table_name, 'shard' || s as shard, 32768::bigint as slots from unnest(['public.customer', 'public.events', 'public.lineitem', 'public.orders', 'public.part', 'public.supplier']) as x(t), unnest([1, 2]) as y(s)")
def placements_distribution(spark, sf_dir):
    e = engine(spark, sf_dir)
    return e.topology.placements(spark).groupBy("table_name", "shard").agg(F.count("*").alias("slots"))


@query(f"select user_id, event_type, cast({slot_sql('cast(user_id as varchar) || chr(0) || event_type')} as integer) as vshard, count(*) as n from events group by 1, 2, 3")
def vshard_mixed_type_key(spark, sf_dir):
    return engine(spark, sf_dir).placed_table("events").groupBy("user_id", "event_type", F.col("_vshard").alias("vshard")).agg(F.count("*").alias("n"))


# --- scans ----------------------------------------------------------------------------------

_KEYED = "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where "
for _name, _where in {
    "keyed_read": "l_orderkey = 42",
    "reversed_equality_read": "42 = l_orderkey and l_quantity > 0",
    "tuple_equality_read": "(l_orderkey, l_linenumber) = (42, 1)",
    "keyed_cast_read": "l_orderkey = cast('0042' as bigint)",
}.items():
    query(_KEYED + _where, _name)(lambda spark, sf_dir, w=_where: engine(spark, sf_dir, layout=True).sql(_KEYED + w))
query("select count(*) as n, round(sum(l_quantity), 2) as qty from lineitem where l_orderkey = 42", "keyed_aggregate")(lambda spark, sf_dir: engine(spark, sf_dir, layout=True).sql("select count(*) as n, round(sum(l_quantity), 2) as qty from lineitem where l_orderkey = 42"))


@query(_KEYED + "l_orderkey = 77")
def prepared_bind_read(spark, sf_dir):
    return engine(spark, sf_dir, layout=True).prepare(_KEYED + "l_orderkey = :key").bind({"key": 77})


@query(_KEYED + "l_orderkey in (1, 42, 77, 1000)")
def multi_key_read(spark, sf_dir):
    return engine(spark, sf_dir, layout=True).keys_in("lineitem", [1, 42, 77, 1000]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("select shard, n from (select 'shard1' as shard, 1 as o union all select 'shard2', 2) join (select case when v % 2 = 0 then 2 else 1 end as o, count(*) as n from (select " + _LINE + " as v from lineitem) group by 1) using (o)")
def scatter_read(spark, sf_dir):
    """A full scan of the layout, counted by the directory that each row lies in."""
    return engine(spark, sf_dir, layout=True).placed_table("lineitem").groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("n"))


text("projection_filter", "select o_orderkey, o_totalprice * 2 as doubled, upper(o_orderstatus) as status from orders where o_totalprice > 1000 and o_orderpriority like '1%'")
text("or_keys_scatter", "select o_orderkey, o_custkey from orders where o_orderkey = 7 or o_orderkey = 9 or o_custkey = 3")
text("range_scatter", "select o_orderkey, o_custkey from orders where o_orderkey between 100 and 200")
text("unsharded_read", "select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 1")
text("relation_free", "select 1 + 1 as two, 'x' || 'y' as xy")
text("values_rows", "select k, v from (values (1, 'a'), (2, 'b'), (3, null)) as t(k, v)")
text("case_and_nulls", "select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 1000 then 'low' else 'high' end as band, nullif(c_mktsegment, 'BUILDING') as other, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'none') as segment from customer")
text("like_and_regex", "select p_partkey from part where p_name like '%1%' and p_brand ilike '%a%' and p_type is not null and p_name rlike '[0-9]'", "select p_partkey from part where p_name like '%1%' and p_brand ilike '%a%' and p_type is not null and regexp_matches(p_name, '[0-9]')")

# --- aggregates -----------------------------------------------------------------------------

text("agg_basic", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(avg(l_extendedprice), 4) as price, min(l_discount) as low, max(l_discount) as high from lineitem group by l_returnflag, l_linestatus")
text("agg_count_distinct", "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, sum(distinct l_linenumber) as numbers from lineitem group by l_returnflag", "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, sum(distinct l_linenumber)::bigint as numbers from lineitem group by l_returnflag")
text("agg_stats", "select l_linestatus, round(stddev(l_quantity), 6) as sd, round(stddev_pop(l_quantity), 6) as sdp, round(stddev_samp(l_tax), 8) as sds, round(variance(l_quantity), 5) as v, round(var_pop(l_quantity), 5) as vp, round(var_samp(l_quantity), 5) as vs from lineitem group by l_linestatus")
text("agg_regression", "select l_returnflag, round(corr(l_extendedprice, l_quantity), 8) as r, round(covar_pop(l_discount, l_tax), 10) as cp, round(covar_samp(l_discount, l_tax), 10) as cs, round(regr_avgx(l_tax, l_quantity), 6) as ax, round(regr_avgy(l_tax, l_quantity), 8) as ay, regr_count(l_tax, l_quantity) as c, round(regr_intercept(l_extendedprice, l_quantity), 4) as i, round(regr_r2(l_extendedprice, l_quantity), 8) as r2, round(regr_slope(l_extendedprice, l_quantity), 6) as s, round(regr_sxx(l_tax, l_quantity), 2) as sxx, round(regr_sxy(l_tax, l_quantity), 4) as sxy, round(regr_syy(l_tax, l_quantity), 6) as syy from lineitem group by l_returnflag")
text("agg_bool_bit", "select l_returnflag, bool_and(l_quantity > 0) as every_positive, bool_or(l_quantity > 49) as any_large, every(l_tax < 1) as taxed, bit_and(l_linenumber) as ba, bit_or(l_linenumber) as bo, bit_xor(l_partkey) as bx from lineitem group by l_returnflag", "select l_returnflag, bool_and(l_quantity > 0) as every_positive, bool_or(l_quantity > 49) as any_large, bool_and(l_tax < 1) as taxed, bit_and(l_linenumber) as ba, bit_or(l_linenumber) as bo, bit_xor(l_partkey) as bx from lineitem group by l_returnflag")
text("agg_filter", "select l_returnflag, count(*) filter (where l_quantity > 25) as large, round(sum(l_tax) filter (where l_linestatus = 'O'), 4) as tax from lineitem group by l_returnflag")
text("agg_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
text("agg_any_value", "select n_regionkey, any_value(n_regionkey * 2) as twice from nation group by n_regionkey")
for _kind in ("rollup", "cube"):
    text(f"agg_{_kind}", f"select l_returnflag, l_linestatus, cast(grouping(l_returnflag) as int) as gf, cast(grouping(l_linestatus) as int) as gs, count(*) as n from lineitem group by {_kind}(l_returnflag, l_linestatus)")
text("agg_grouping_sets", "select l_returnflag, l_linenumber, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linenumber), ())")
text("agg_percentiles", "select l_returnflag, round(percentile_cont(0.5) within group (order by l_quantity), 4) as median, percentile_disc(0.25) within group (order by l_quantity) as q1 from lineitem group by l_returnflag", "select l_returnflag, round(quantile_cont(l_quantity, 0.5), 4) as median, quantile_disc(l_quantity, 0.25) as q1 from lineitem group by l_returnflag")
text("agg_mode", "select l_suppkey, mode() within group (order by l_linenumber) as m from lineitem group by l_suppkey", "select l_suppkey, l_linenumber as m from (select l_suppkey, l_linenumber, row_number() over (partition by l_suppkey order by count(*) desc, l_linenumber) as rn from lineitem group by 1, 2) where rn = 1")
text("agg_group_by_distinct", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by distinct rollup(l_returnflag, l_linestatus), rollup(l_returnflag)", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())")


@query("select o_custkey, string_agg(o_orderstatus, '|' order by o_orderkey) as states from orders group by o_custkey")
def agg_string_agg(spark, sf_dir):
    return engine(spark, sf_dir).table("orders").groupBy("o_custkey").agg(pg.string_agg("o_orderstatus", "|", "o_orderkey").alias("states"))


@query("select o_custkey, string_agg(coalesce(p, 'null'), ',' order by o_orderkey) as prices from (select o_custkey, o_orderkey, case when o_orderkey % 3 = 0 then null else cast(o_orderkey as varchar) end as p from orders) group by o_custkey")
def agg_array_sorted(spark, sf_dir):
    """Ordered arrays keep nulls."""
    o = engine(spark, sf_dir).table("orders").withColumn("p", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")))
    values = pg.array_agg("p", "o_orderkey")
    return o.groupBy("o_custkey").agg(F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit("null"))), ",").alias("prices"))


@query("select o_custkey, '[' || string_agg('\"' || o_orderstatus || '\"', ',' order by o_orderkey) || ']' as states, '{' || string_agg('\"' || o_orderkey || '\":\"' || o_orderpriority || '\"', ',' order by cast(o_orderkey as varchar)) || '}' as keys from orders group by o_custkey")
def agg_json(spark, sf_dir):
    o = engine(spark, sf_dir).table("orders")
    return o.groupBy("o_custkey").agg(pg.json_agg("o_orderstatus", "o_orderkey").alias("states"), pg.json_object_agg("o_orderkey", "o_orderpriority", unique=True).alias("keys"))


_RANGES = "select user_id, epoch(date_trunc('hour', ts))::bigint as lo, epoch(date_trunc('hour', ts))::bigint + 5400 as hi from events"


@query(f"with r as ({_RANGES}), m as (select *, max(hi) over (partition by user_id order by lo, hi rows between unbounded preceding and 1 preceding) as seen from r), i as (select *, sum(case when seen is null or lo > seen then 1 else 0 end) over (partition by user_id order by lo, hi rows unbounded preceding) as island from m) select user_id, min(lo) as lo, max(hi) as hi from i group by user_id, island")
def agg_range_merge(spark, sf_dir):
    e = engine(spark, sf_dir).table("events")
    lo = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return pg.range_agg(e.select("user_id", lo.alias("lo"), (lo + 5400).alias("hi")), ["user_id"], "lo", "hi")


@query("select o_orderstatus, case when max(o_orderkey) < min(o_orderkey + 1000000) then max(o_orderkey) end as lo, case when max(o_orderkey) < min(o_orderkey + 1000000) then min(o_orderkey + 1000000) end as hi from orders group by o_orderstatus")
def agg_range_intersect(spark, sf_dir):
    o = engine(spark, sf_dir).table("orders")
    return o.groupBy("o_orderstatus").agg(pg.range_intersect_agg("o_orderkey", F.col("o_orderkey") + 1000000).alias("r")).select("o_orderstatus", "r.lo", "r.hi")


@query("select o_custkey, string_agg('<o>' || o_orderpriority || '</o>', '' order by o_orderkey) as doc from orders group by o_custkey")
def agg_xml(spark, sf_dir):
    return engine(spark, sf_dir).table("orders").groupBy("o_custkey").agg(pg.xml_agg(F.concat(F.lit("<o>"), "o_orderpriority", F.lit("</o>")), "o_orderkey").alias("doc"))


# --- joins ----------------------------------------------------------------------------------

text("join_inner_colocated", "select o_orderkey, count(*) as n, round(sum(l_extendedprice), 2) as price from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'F' group by o_orderkey")
_COLOCATED = "select o_orderkey, count(*) as n, round(sum(l_extendedprice), 2) as price from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey"


@query(_COLOCATED)
def join_colocated_buckets(spark, sf_dir):
    """Both tables in buckets of their shard key: neither the join nor the grouping shuffles."""
    from .engine import Engine

    e = engine(spark, sf_dir, layout=True)
    for t in ("orders", "lineitem"):
        e.table(t)  # stored by now
    own = Engine(spark, e.folder, e.registry, e.topology)
    own.colocate("orders", "lineitem")
    return own.sql(_COLOCATED)


text("join_broadcast_dim", "select n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey group by n_name")
text("join_sort_merge", "select /*+ merge(orders) */ count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey", "select count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey")
text("join_left", "select c_custkey, count(o_orderkey) as orders from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'O' group by c_custkey")
text("join_right", "select c_custkey, count(o_orderkey) as orders from orders right join customer on c_custkey = o_custkey group by c_custkey")
text("join_full", "select s_suppkey, p_partkey from supplier full join part on s_suppkey = p_partkey")
text("join_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
text("join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
text("join_not_in_null_aware", "select n_nationkey from nation where n_regionkey not in (select case when r_regionkey < 3 then r_regionkey end from region)")
text("join_not_in", "select n_nationkey from nation where n_regionkey not in (select r_regionkey from region where r_regionkey < 3)")
text("join_theta", "select r_regionkey, count(*) as n from region join nation on n_regionkey > r_regionkey group by r_regionkey")
text("join_cross", "select r_name, n_name from region cross join nation")
text("join_self", "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
text("join_lateral", "select r_regionkey, t.n from region, lateral (select count(*) as n from nation where n_regionkey = r_regionkey) t")
text("join_using", "select n_nationkey, count(*) as n from nation join (select c_nationkey as n_nationkey from customer) c using (n_nationkey) group by n_nationkey")
text("join_natural", "select n_nationkey, n_name from nation natural join (select n_nationkey from nation where n_regionkey = 2) x")
text("join_multi_star", "select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name")


@query("select s_suppkey, count(*) as n from supplier join part on p_retailprice between s_acctbal - 50 and s_acctbal + 50 group by s_suppkey")
def join_range(spark, sf_dir):
    """A band join through bins of the band's width."""
    e = engine(spark, sf_dir)
    near = pg.band_join(e.table("supplier"), e.table("part"), F.col("s_acctbal") - 50, F.col("s_acctbal") + 50, F.col("p_retailprice"), 100.0)
    return near.groupBy("s_suppkey").agg(F.count("*").alias("n"))


# --- windows --------------------------------------------------------------------------------

text("win_row_number", "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders")
text("win_rank_dense", "select o_orderkey, rank() over (partition by o_orderstatus order by o_orderpriority) as r, dense_rank() over (partition by o_orderstatus order by o_orderpriority) as d from orders")
text("win_lag_lead", "select o_orderkey, lag(o_orderkey) over w as before, lead(o_orderkey, 2, -1) over w as later from orders window w as (partition by o_custkey order by o_orderkey)", "select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before, lead(o_orderkey, 2, -1) over (partition by o_custkey order by o_orderkey) as later from orders")
text("win_rows_frame", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row), 2) as moving from orders")
text("win_range_frame", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderkey range between 1000 preceding and 1000 following) as near from orders")
text("win_ntile_dist", "select o_orderkey, ntile(4) over w as quarter, round(percent_rank() over w, 8) as pr, round(cume_dist() over w, 8) as cd from orders window w as (partition by o_orderstatus order by o_orderkey)", "select o_orderkey, cast(ntile(4) over w as integer) as quarter, round(percent_rank() over w, 8) as pr, round(cume_dist() over w, 8) as cd from orders window w as (partition by o_orderstatus order by o_orderkey)")
text("win_first_last_nth", "select o_orderkey, first_value(o_orderkey) over w as f, last_value(o_orderkey) over w as l, nth_value(o_orderkey, 2) over w as s from orders window w as (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following)")
text("win_aggregate_total", "select n_nationkey, count(*) over (partition by n_regionkey) as peers, max(n_name) over (partition by n_regionkey) as last_name from nation")


@query("select l_orderkey, l_linenumber, l_partkey, sum(l_linenumber) over (partition by l_orderkey order by l_quantity groups between 1 preceding and current row)::bigint as s from lineitem")
def win_groups_frame(spark, sf_dir):
    """A GROUPS frame: a RANGE frame over the dense rank of the peer groups."""
    rows, w = pg.groups_frame(engine(spark, sf_dir, layout=True).table("lineitem"), ["l_orderkey"], [F.col("l_quantity")], -1, 0)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.sum(F.col("l_linenumber").cast("long")).over(w).alias("s"))


@query("select o_orderkey, sum(o_orderkey) over w::bigint as others, count(*) over w as n from orders window w as (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following exclude current row)")
def win_exclude_current_row(spark, sf_dir):
    """A frame that leaves the current row out."""
    w = Window.partitionBy("o_custkey")
    rest = pg.exclude_current_row("o_orderkey", w)
    return engine(spark, sf_dir, layout=True).table("orders").select("o_orderkey", rest["sum"].alias("others"), rest["count"].alias("n"))


# --- order, limits, distinct ----------------------------------------------------------------

text("order_limit_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 10")
text("topk", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 25")
text("distinct_rows", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")


@query("select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey")
def distinct_on(spark, sf_dir):
    o = engine(spark, sf_dir).table("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return pg.distinct_on(o, ["o_custkey"], pg.desc("o_totalprice"), pg.asc("o_orderkey"))


@query("select o_orderkey, o_orderpriority from (select *, rank() over (order by o_orderpriority) as r from orders) where r <= 5")
def fetch_with_ties(spark, sf_dir):
    o = engine(spark, sf_dir).table("orders").select("o_orderkey", "o_orderpriority")
    return pg.with_ties(o, 5, (F.col("o_orderpriority"), False))


@query("select n_nationkey, row_number() over (order by x nulls last, n_nationkey) as up, row_number() over (order by x desc nulls first, n_nationkey) as down from (select n_nationkey, case when n_nationkey % 3 = 0 then null else n_regionkey end as x from nation)")
def nulls_ordering(spark, sf_dir):
    """Nulls come last ascending and first descending; ranks come from counts, not one sort."""
    n = engine(spark, sf_dir).table("nation").withColumn("x", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")))
    one = F.lit(1)  # 25 rows of a replicated table
    up = F.row_number().over(Window.partitionBy(one).orderBy(pg.asc("x"), "n_nationkey"))
    down = F.row_number().over(Window.partitionBy(one).orderBy(pg.desc("x"), "n_nationkey"))
    return n.select("n_nationkey", up.alias("up"), down.alias("down"))


# --- sets, common table expressions, subqueries ---------------------------------------------

_A, _B = "select o_custkey as k from orders where o_orderstatus = 'F'", "select o_custkey as k from orders where o_orderpriority like '1%'"
for _name, _op in {"union_all": "union all", "union_distinct": "union", "intersect": "intersect", "intersect_all": "intersect all", "except": "except", "except_all": "except all"}.items():
    text(f"set_{_name}", f"{_A} {_op} {_B}")
text("cte", "with big as (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey), top as (select * from big where total > 500000) select c_mktsegment, count(*) as n from top join customer on o_custkey = c_custkey group by c_mktsegment")
text("cte_recursive", "with recursive t(n, f) as (select 1, 1 union all select n + 1, f * (n + 1) from t where n < 10) select n, f from t")
text("scalar_subquery", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)")
text("in_subquery", "select count(*) as n from lineitem where l_partkey in (select p_partkey from part where p_size < 10)")
text("exists_correlated", "select o_orderkey from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_quantity > 49)")
text("correlated_scalar", "select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as top from customer")
text("derived_table", "select band, count(*) as n from (select case when l_quantity < 10 then 'low' else 'high' end as band from lineitem) t group by band")

# --- PostgreSQL spellings ---------------------------------------------------------------------

text("dialect_fetch_first", "select o_orderkey from orders order by o_orderkey fetch first 7 rows only", "select o_orderkey from orders order by o_orderkey limit 7")
text("dialect_regex", "select n_nationkey from nation where n_name ~ '[13]$' and n_name !~* '^xx' and n_name ~* 'n'", "select n_nationkey from nation where regexp_matches(n_name, '[13]$') and not regexp_matches(n_name, '^xx', 'i') and regexp_matches(n_name, 'n', 'i')")
text("dialect_string_agg", "select n_regionkey, string_agg(n_name, ', ' order by n_name desc) as names from nation group by n_regionkey")
text("dialect_any_array", "select n_nationkey from nation where n_regionkey = any (array(1, 3))", "select n_nationkey from nation where n_regionkey in (1, 3)")
text("dialect_json", "select event_id, cast(props ->> 'k' as int) as k from events where props -> 'k' is not null", "select event_id, cast(props ->> 'k' as int) as k from events where (props -> 'k') is not null")
text("dialect_casts", "select o_orderkey::string as k, '12'::int + 1 as n from orders where o_orderdate::date < '1995-01-01'::date", "select o_orderkey::varchar as k, '12'::int + 1 as n from orders where o_orderdate::date < '1995-01-01'::date")

text("text_json_agg", "select o_custkey, json_agg(o_orderstatus order by o_orderkey desc) as states, json_object_agg(o_orderkey, o_orderpriority order by o_orderkey) as keys, json_agg(o_orderkey order by o_orderkey) filter (where o_orderstatus = 'F') as f from orders group by o_custkey", "select o_custkey, '[' || string_agg('\"' || o_orderstatus || '\"', ',' order by o_orderkey desc) || ']' as states, '{' || string_agg('\"' || o_orderkey || '\":\"' || o_orderpriority || '\"', ',' order by o_orderkey) || '}' as keys, '[' || string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) filter (where o_orderstatus = 'F') || ']' as f from orders group by o_custkey")
text("text_xml_array_agg", "select o_custkey, xmlagg('<o>' || o_orderkey || '</o>' order by o_orderkey) as doc, array_join(array_agg(o_orderkey order by o_orderstatus desc, o_orderkey), ',') as keys from orders group by o_custkey", "select o_custkey, string_agg('<o>' || o_orderkey || '</o>', '' order by o_orderkey) as doc, string_agg(cast(o_orderkey as varchar), ',' order by o_orderstatus desc, o_orderkey) as keys from orders group by o_custkey")
text("text_distinct_on", "select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey")
text("text_with_ties", "select o_orderkey, o_orderpriority from orders order by o_orderpriority fetch first 5 rows with ties", "select o_orderkey, o_orderpriority from (select *, rank() over (order by o_orderpriority) as r from orders) where r <= 5")
text("text_null_order", "select o_orderkey, row_number() over (partition by o_custkey order by nullif(o_orderstatus, 'F') desc, o_orderkey) as down, row_number() over (partition by o_custkey order by nullif(o_orderstatus, 'F'), o_orderkey) as up from orders", "select o_orderkey, row_number() over (partition by o_custkey order by nullif(o_orderstatus, 'F') desc nulls first, o_orderkey) as down, row_number() over (partition by o_custkey order by nullif(o_orderstatus, 'F') nulls last, o_orderkey) as up from orders")
text("text_integer_division", "select l_orderkey, l_linenumber, l_partkey / 7 as a, -l_partkey / 7 as b, l_partkey / 2 / 3 as c, l_quantity / 4 as d from lineitem", "select l_orderkey, l_linenumber, l_partkey // 7 as a, -(l_partkey // 7) as b, l_partkey // 2 // 3 as c, l_quantity / 4 as d from lineitem")
text("text_quoted_names", "select n_nationkey, 'rows from nation, public.nation' as s, '(a, b) = (1, 2)' as t from public.nation where (n_nationkey, n_name) = (n_nationkey, n_name)", "select n_nationkey, 'rows from nation, public.nation' as s, '(a, b) = (1, 2)' as t from nation")

# --- scalar functions -----------------------------------------------------------------------

text("fn_string", "select n_nationkey, upper(n_name) as u, lower(n_name) as l, substr(n_name, 2, 3) as s, cast(position('A' in n_name) as int) as p, split_part(n_name, '_', 2) as sp, trim('  x ') || '|' as t, lpad(n_name, 12, '*') as lp, concat_ws('-', n_name, cast(n_nationkey as string)) as c, replace(n_name, 'N', 'n') as r, cast(length(n_name) as int) as len, reverse(n_name) as rev, regexp_replace(n_name, '[0-9]+', '#') as rx from nation", "select n_nationkey, upper(n_name) as u, lower(n_name) as l, substr(n_name, 2, 3) as s, cast(position('A' in n_name) as int) as p, split_part(n_name, '_', 2) as sp, trim('  x ') || '|' as t, lpad(n_name, 12, '*') as lp, concat_ws('-', n_name, cast(n_nationkey as varchar)) as c, replace(n_name, 'N', 'n') as r, cast(length(n_name) as int) as len, reverse(n_name) as rev, regexp_replace(n_name, '[0-9]+', '#', 'g') as rx from nation")
text("fn_date", "select o_orderkey, cast(extract(year from o_orderdate) as int) as y, cast(extract(month from o_orderdate) as int) as m, cast(date_trunc('month', o_orderdate) as string) as first_day, cast(cast(o_orderdate + interval 3 days as date) as string) as later, datediff(o_orderdate, date '1992-01-01') as days, date_format(o_orderdate, 'yyyy-MM') as ym from orders", "select o_orderkey, cast(extract(year from o_orderdate) as int) as y, cast(extract(month from o_orderdate) as int) as m, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') as first_day, strftime(o_orderdate + interval 3 days, '%Y-%m-%d') as later, cast(date_diff('day', timestamp '1992-01-01', date_trunc('day', o_orderdate)) as int) as days, strftime(o_orderdate, '%Y-%m') as ym from orders")
text("fn_math", "select p_partkey, abs(-p_size) as a, round(p_retailprice, 1) as r, cast(p_partkey div 7 as bigint) as d, mod(p_partkey, 7) as m, cast(floor(p_retailprice) as bigint) as f, cast(ceil(p_retailprice) as bigint) as c, round(power(p_size, 2), 4) as pw, round(sqrt(p_size), 8) as sq, sign(p_size - 10) as sg, greatest(p_size, 10) as g, cast(width_bucket(p_size, 0, 50, 5) as int) as wb from part", "select p_partkey, abs(-p_size) as a, round(p_retailprice, 1) as r, p_partkey // 7 as d, p_partkey % 7 as m, cast(floor(p_retailprice) as bigint) as f, cast(ceil(p_retailprice) as bigint) as c, round(power(p_size, 2), 4) as pw, round(sqrt(p_size), 8) as sq, cast(sign(p_size - 10) as double) as sg, greatest(p_size, 10) as g, cast(case when p_size < 0 then 0 when p_size >= 50 then 6 else floor(p_size / 10.0) + 1 end as int) as wb from part")
text("fn_json", "select event_id, cast(get_json_object(props, '$.k') as int) as k from events", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
text("fn_array", "select n_regionkey, size(a) as n, array_contains(a, 5) as has_five, cast(array_position(a, 7) as bigint) as at_seven, array_join(array_sort(a), ',') as joined from (select n_regionkey, collect_list(n_nationkey) as a from nation group by n_regionkey) t", "select n_regionkey, cast(len(a) as int) as n, list_contains(a, 5) as has_five, cast(coalesce(list_position(list_sort(a), 7), 0) as bigint) as at_seven, array_to_string(list_sort(a), ',') as joined from (select n_regionkey, list(n_nationkey) as a from nation group by n_regionkey) t")
text("fn_unnest", "select n_regionkey, v from (select n_regionkey, collect_list(n_nationkey) as a from nation group by n_regionkey) t lateral view explode(a) x as v", "select n_regionkey, n_nationkey as v from nation")
text("fn_map", "select n_nationkey, element_at(map('a', n_nationkey, 'b', n_regionkey), 'b') as b from nation", "select n_nationkey, n_regionkey as b from nation")
text("fn_generate_series", "select n_nationkey, s from nation lateral view explode(sequence(1, n_regionkey + 1)) x as s", "select n_nationkey, cast(s as int) as s from nation, lateral (select unnest(generate_series(1, n_regionkey + 1)) as s) t")

_SQLS = "case event_id % 4 when 0 then 'SELECT * FROM t WHERE id = ' || event_id || ' AND n = ''x''' when 1 then 'insert  into t /* c */ values (' || event_id || ', 1.5)' when 2 then '-- note' || chr(10) || 'update t set a = ''it''''s'' where b = 1' else '  ' end"
_NORMAL = r"case when trim(x) = '' then '<empty query>' else trim(x) end"
_NORMALIZED = rf"select event_id, {_NORMAL} as label from (select event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '/\*.*?\*/', ' ', 'gs'), '--[^\n]*', ' ', 'g'), '''(?:''''|[^''])*''', '?', 'g'), '\b\d+(?:\.\d+)?\b', '?', 'g'), '\s+', ' ', 'g') as x from (select event_id, {_SQLS} as q from events))"


def _sqls(spark, sf_dir) -> DataFrame:
    return engine(spark, sf_dir).table("events").select("event_id", F.expr(_SQLS.replace("chr(10)", "char(10)").replace("it''''s", "it\\'\\'s").replace("''x'''", "\\'x\\''").replace("''it", "\\'it").replace("s''", "s\\'")).alias("q"))


@query(_NORMALIZED)
def normalize_text(spark, sf_dir):
    return _sqls(spark, sf_dir).select("event_id", normalize_sql("q").alias("label"))


@query(f"select substr(sha256(label), 1, 16) as fingerprint, upper(split_part(label, ' ', 1)) as statement, count(*) as n from ({_NORMALIZED}) group by 1, 2")
def fingerprint_text(spark, sf_dir):
    label = _sqls(spark, sf_dir).select(normalize_sql("q").alias("label"))
    return label.groupBy(fingerprint("label").alias("fingerprint"), statement("label").alias("statement")).agg(F.count("*").alias("n"))


@query("select code, case when substr(code, 1, 2) = '08' then 'transport' when substr(code, 1, 2) in ('22', '23') then 'data_error' when substr(code, 1, 2) in ('25', '40') then 'transaction_error' when substr(code, 1, 2) = '42' then 'sql_error' when substr(code, 1, 2) = '53' then 'resource_exhausted' else 'postgres_error' end as category from (select unnest(['08006', '22P02', '23505', '25001', '40001', '42601', '53300', 'XX000', '']) as code)")
def sqlstate_classes(spark, sf_dir):
    codes = spark.createDataFrame([(c,) for c in ("08006", "22P02", "23505", "25001", "40001", "42601", "53300", "XX000", "")], "code string")
    return codes.select("code", sqlstate_category("code").alias("category"))


@query("select tag, command, n from (values ('INSERT 0 3', 'INSERT 0', 3::bigint), ('UPDATE 7', 'UPDATE', 7), ('COPY 12', 'COPY', 12), ('CREATE TABLE', 'CREATE TABLE', null)) as t(tag, command, n)")
def command_tags(spark, sf_dir):
    tags = spark.createDataFrame([("INSERT 0 3",), ("UPDATE 7",), ("COPY 12",), ("CREATE TABLE",)], "tag string")
    return tags.select("tag", row_count_tag("tag").alias("r")).select("tag", "r.command", F.col("r.rows").alias("n"))


@query("select o_orderkey, case when t like '%.%' then rtrim(rtrim(t, '0'), '.') else t end as key from (select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) as varchar) as t from orders)")
def canonical_decimal(spark, sf_dir):
    return engine(spark, sf_dir).table("orders").select("o_orderkey", canonical(F.col("o_totalprice").cast("decimal(18,2)"), "numeric(18,2)").alias("key"))


@query("select n_nationkey, u as uuid, case when n_nationkey % 2 = 0 then 'true' else 'false' end as flag from (select n_nationkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as u from (select n_nationkey, md5(n_name) as h from nation))")
def canonical_uuid_bool(spark, sf_dir):
    n = engine(spark, sf_dir).table("nation")
    raw = F.concat(F.lit("{"), F.upper(F.md5("n_name")), F.lit("}"))
    word = F.when(F.col("n_nationkey") % 2 == 0, F.lit(" YES")).otherwise(F.lit("off"))
    return n.select("n_nationkey", canonical(raw, "uuid").alias("uuid"), canonical(word, "bool").alias("flag"))


# --- COPY -----------------------------------------------------------------------------------

_COPY = "select doc_id, lang, n_chars, md5(text) as digest from documents"


def _copied(form: str, *options):
    def run(spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars", "text")
        path = folder(spark, f"copy-{form}")
        e = engine(spark, sf_dir)
        registry = e.registry.with_sharded("documents", ["doc_id"], ["bigint"])
        out = plan_copy("documents", docs.columns, False, [("format", form), *options], registry)
        copy_out(docs, path, out)
        back = plan_copy("documents", docs.columns, True, [("format", form), *options], registry)
        rows = copy_in(spark, f"{path}/part-*", back, docs.schema)
        return rows.select("doc_id", "lang", "n_chars", F.md5("text").alias("digest"))

    return run


query(_COPY, "copy_text_roundtrip")(_copied("text"))
query(_COPY, "copy_csv_roundtrip")(_copied("csv", ("header", "true"), ("delimiter", ";")))
query(_COPY, "copy_binary_roundtrip")(_copied("binary"))


@query(f"select case when v % 2 = 0 then 'shard2' else 'shard1' end as shard, count(*) as n from (select {slot_sql('cast(doc_id as varchar)')} as v from documents) group by 1")
def copy_route_counts(spark, sf_dir):
    """Rows of a CSV stream by the shard that each is routed to."""
    rows = _copied("csv", ("quote", '"'))(spark, sf_dir)
    slot = vshard(["doc_id"], ["bigint"])
    return rows.groupBy(F.concat(F.lit("shard"), modulo_owner(slot, 2).cast("string")).alias("shard")).agg(F.count("*").alias("n"))


# --- telemetry ------------------------------------------------------------------------------

_EVENTS = "select ts, 'SELECT ' || event_type || ' FROM t WHERE id = ' || user_id as sql, event_type <> 'error' and value >= 10 as success, cast(floor(value * 10) as bigint) as duration_ms, case when event_id % 3 = 0 then ['shard1', 'shard2'] when event_id % 3 = 1 then ['shard1'] else ['shard2'] end as shards, case when event_id % 2 = 0 then 'sql_error' else 'data_error' end as category from events"
_COUNT = "count(*) as queries, sum(case when success then 0 else 1 end)::bigint as failed, sum(case when len(shards) > 1 then 1 else 0 end)::bigint as scattered, sum(case when len(shards) = 1 then 1 else 0 end)::bigint as single, sum(duration_ms)::bigint as total_ms"


def query_events(spark, sf_dir) -> DataFrame:
    return engine(spark, sf_dir).table("events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("SELECT "), "event_type", F.lit(" FROM t WHERE id = "), "user_id").alias("sql"), F.expr("event_type <> 'error' and value >= 10").alias("success"), F.floor(F.col("value") * 10).alias("duration_ms"),
        F.expr("case when event_id % 3 = 0 then array('shard1', 'shard2') when event_id % 3 = 1 then array('shard1') else array('shard2') end").alias("shards"), F.expr("case when event_id % 2 = 0 then 'sql_error' else 'data_error' end").alias("category"),
    )


@query(f"with q as ({_EVENTS}), w(window_name, seconds) as (values ('10 seconds', 10), ('1 minute', 60), ('5 minutes', 300), ('10 minutes', 600)), l as (select max(epoch(date_trunc('second', ts)))::bigint as last from q), c as (select window_name, {_COUNT} from q, l, w where epoch(date_trunc('second', ts))::bigint > last - seconds group by window_name) select w.window_name, w.seconds, coalesce(queries, 0) as queries, coalesce(failed, 0) as failed, coalesce(scattered, 0) as scattered, coalesce(single, 0) as single, coalesce(total_ms, 0) as total_ms, coalesce(total_ms // queries, 0) as average_ms from w left join c using (window_name)")
def telem_windows(spark, sf_dir):
    return telemetry.rolling(query_events(spark, sf_dir))


@query(f"select strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as second, {_COUNT} from ({_EVENTS}) group by 1")
def telem_tumbling_1s(spark, sf_dir):
    return telemetry.tumbling(query_events(spark, sf_dir)).withColumn("second", F.date_format("second", "yyyy-MM-dd HH:mm:ss"))


@query(f"select le, (select count(*) from ({_EVENTS}) where duration_ms / 1000.0 <= le) as queries from (select unnest([0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 1e9])::double as le)")
def telem_histogram(spark, sf_dir):
    return telemetry.histogram(query_events(spark, sf_dir)).withColumn("le", F.when(F.col("le") == float("inf"), 1e9).otherwise(F.col("le")))


@query(f"select shard, count(*) as executions from (select unnest(shards) as shard from ({_EVENTS})) group by shard")
def telem_shard_exec(spark, sf_dir):
    return telemetry.shard_executions(query_events(spark, sf_dir))


@query(f"select round(max(n) / min(n), 8) as ratio from (select count(*)::double as n from (select unnest(shards) as shard from ({_EVENTS})) group by shard)")
def telem_imbalance(spark, sf_dir):
    return telemetry.imbalance(query_events(spark, sf_dir)).select(F.round("ratio", 8).alias("ratio"))


@query(f"select category, count(*) as failures from ({_EVENTS}) where not success group by category")
def telem_failures(spark, sf_dir):
    return telemetry.failures(query_events(spark, sf_dir))


@query(f"select 'SELECT' as operation, case when success then 'success' else 'failure' end as outcome, count(*) as queries from ({_EVENTS}) group by 1, 2")
def telem_operations(spark, sf_dir):
    return telemetry.operations(query_events(spark, sf_dir))


@query(f"select regexp_replace(sql, '\\d+', '?', 'g') as shape, {_COUNT}, (sum(duration_ms) // count(*))::bigint as average_ms from ({_EVENTS}) group by 1")
def telem_summary_top(spark, sf_dir):
    return telemetry.shapes(query_events(spark, sf_dir)).select("shape", "queries", "failed", "scattered", "single", "total_ms", "average_ms")


_BARS = f"select le, lag(le, 1, 0.0) over (order by le) as low, q, lag(q, 1, 0) over (order by le) as before, (select count(*) from ({_EVENTS})) as n from (select le, (select count(*) from ({_EVENTS}) where duration_ms / 1000.0 <= le) as q from (select unnest([0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 1e9])::double as le))"


@query(f"select round(case when le = 1e9 then low else low + (le - low) * (0.95 * n - before) / (q - before) end, 8) as seconds from ({_BARS}) where q >= 0.95 * n order by le limit 1")
def telem_p95_bucket(spark, sf_dir):
    return telemetry.quantile(query_events(spark, sf_dir)).select(F.round("seconds", 8).alias("seconds"))


@query(f"select 'shard_executions{{shard=\"' || shard || '\"}} ' || count(*) as line from (select unnest(shards) as shard from ({_EVENTS})) group by shard")
def telem_openmetrics(spark, sf_dir):
    return telemetry.openmetrics(telemetry.shard_executions(query_events(spark, sf_dir)), "shard_executions", "executions", "shard")


@query(f"select '{{\"category\":\"' || category || '\",\"failures\":' || count(*) || '}}' as line from ({_EVENTS}) where not success group by category")
def telem_json(spark, sf_dir):
    return telemetry.json_lines(telemetry.failures(query_events(spark, sf_dir)))


@query(f"select strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as second, {_COUNT} from ({_EVENTS}) group by 1")
def stream_tumbling_minutes(spark, sf_dir):
    """The same counters from a stream of files, complete after all that is there."""
    import uuid

    path, name = folder(spark, "events"), f"t{uuid.uuid4().hex}"
    query_events(spark, sf_dir).write.parquet(path)
    stream = spark.readStream.schema(telemetry.SCHEMA).parquet(path)
    q = telemetry.start(stream, name, folder(spark, "state"), "1 minute")
    q.awaitTermination()
    return spark.table(name).withColumn("second", F.date_format("second", "yyyy-MM-dd HH:mm:ss"))


# --- statements that write ------------------------------------------------------------------


def _fresh(spark, sf_dir):
    """An engine of its own with an account for each customer."""
    from .engine import Engine

    e = Engine(spark, folder(spark, "dml"), shards=["shard1", "shard2"])
    e.register("accounts", ["account_id"], ["bigint"], generated=True)
    e.load("accounts", spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as account_id", "c_name as name", "cast(c_nationkey * 10 as decimal(18,2)) as balance"))
    return e


_ACCOUNTS = "select c_custkey as account_id, c_name as name, cast(c_nationkey * 10 as double) as balance from customer"


@query(f"{_ACCOUNTS} union all select 1000000000, 'new', 5.5")
def dml_insert_keyed(spark, sf_dir):
    e = _fresh(spark, sf_dir)
    e.execute("insert into accounts (account_id, name, balance) values (1000000000, 'new', 5.5)")
    return e.table("accounts").withColumn("balance", F.col("balance").cast("double"))


@query(f"select account_id, name from ({_ACCOUNTS}) union all select row_number() over (order by s_suppkey), s_name from supplier")
def dml_insert_generated_ids(spark, sf_dir):
    e = _fresh(spark, sf_dir)
    e.load("accounts", spark.read.parquet(f"{sf_dir}/supplier.parquet").orderBy("s_suppkey").selectExpr("s_name as name", "cast(0 as decimal(18,2)) as balance"))
    return e.table("accounts").select("account_id", "name")


@query(f"select account_id, case when account_id = 7 then 999.0 else balance end as balance from ({_ACCOUNTS})")
def dml_update_keyed(spark, sf_dir):
    e = _fresh(spark, sf_dir)
    e.execute("update accounts set balance = 999 where account_id = 7")
    return e.table("accounts").select("account_id", F.col("balance").cast("double").alias("balance"))


@query("select c_custkey as account_id from customer where c_custkey <> 3")
def dml_delete_keyed(spark, sf_dir):
    e = _fresh(spark, sf_dir)
    e.execute("delete from accounts where account_id = 3")
    return e.table("accounts").select("account_id")


def _stock(spark, sf_dir):
    """An engine of its own with an unsharded table of parts and a source of changes for every third one."""
    from .engine import Engine

    e = Engine(spark, folder(spark, "merge"), shards=["shard1"])
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as k", "p_name as name", "p_size as size")
    e.register_unsharded("stock")
    e.load("stock", part)
    e.register_unsharded("changes")
    e.attach("changes", part.selectExpr("if(k % 3 = 0, k, k + 1000000000) as k", "concat(name, '!') as name", "size"))
    return e


_CHANGED = "select p_partkey as k, case when p_partkey % 3 = 0 then p_name || '!' else p_name end as name, p_size as size from part"


@query(f"{_CHANGED} union all select p_partkey + 1000000000, p_name || '!', p_size from part where p_partkey % 3 <> 0")
def dml_merge_unsharded(spark, sf_dir):
    e = _stock(spark, sf_dir)
    e.merge("stock", e.table("changes"), ["k"])
    return e.table("stock")


@query(f"select k, name, case when k % 3 = 0 then size + 100 else size end as size from ({_CHANGED}) where not (k % 3 = 0 and size > 40) union all select p_partkey + 1000000000, p_name || '!', null from part where p_partkey % 3 <> 0 and p_size < 10")
def dml_merge_text(spark, sf_dir):
    e = _stock(spark, sf_dir)
    e.execute("merge into stock as s using changes as c on s.k = c.k when matched and s.size > 40 then delete when matched then update set name = c.name, size = s.size + 100 when not matched and c.size < 10 then insert (k, name) values (c.k, c.name)")
    return e.table("stock")


@query("select n, t from (select count(*) as n, 'a' as t from nation union all select count(*), 'b' from region)")
def dml_atomic_batch(spark, sf_dir):
    """Two tables written together; a batch that fails leaves neither changed."""
    from .engine import Engine

    e = Engine(spark, folder(spark, "batch"), shards=["shard1", "shard2"])
    e.register("a", ["k"], ["bigint"])
    e.register("b", ["k"], ["bigint"])
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    with e.batch() as both:
        both.insert("a", nation.selectExpr("cast(n_nationkey as bigint) as k"))
        both.insert("b", region.selectExpr("cast(r_regionkey as bigint) as k"))
    try:
        with e.batch() as both:
            both.insert("a", nation.selectExpr("cast(n_nationkey + 100 as bigint) as k"))
            both.insert("b", region.selectExpr("cast(null as bigint) as k"))
    except Exception:  # noqa: BLE001, S110  the null key refuses the whole batch
        pass
    count = lambda t: e.table(t).agg(F.count("*").alias("n")).withColumn("t", F.lit(t))
    return count("a").union(count("b"))


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def copy_query_out(spark, sf_dir):
    """COPY (query) TO runs the query once, globally; COPY FROM routes its rows into a new table."""
    from .engine import Engine

    e = engine(spark, sf_dir)
    path = folder(spark, "copy-query")
    e.copy(f"copy (select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F') to '{path}' with (format csv, header true)")
    new = Engine(spark, folder(spark, "copied"), shards=["shard1", "shard2"])
    new.register("f_orders", ["o_orderkey"], ["bigint"])
    new.load("f_orders", e.sql("select o_orderkey, o_orderstatus from orders where false"))
    new.copy(f"copy f_orders (o_orderkey, o_orderstatus) from '{path}/part-*' with (format csv, header true)")
    return new.table("f_orders")


@query("select o_orderstatus, count(*) as n from orders group by o_orderstatus")
def create_table_as(spark, sf_dir):
    """CTAS into the sharded layout, read back."""
    e = engine(spark, sf_dir)
    from .engine import Engine

    new = Engine(spark, folder(spark, "ctas"), shards=["shard1", "shard2"])
    new.register("status_counts", ["o_orderstatus"], ["text"])
    new.load("status_counts", e.sql("select o_orderstatus, count(*) as n from orders group by o_orderstatus"))
    return new.table("status_counts")


@query("select o_custkey, count(*) as n, max(o_totalprice) as top from orders group by o_custkey")
def create_table_as_text(spark, sf_dir):
    """CREATE TABLE AS as text, and SELECT INTO from the new table."""
    from .engine import Engine

    new = Engine(spark, folder(spark, "ctas"), shards=["shard1", "shard2"])
    new.attach("orders", spark.read.parquet(f"{sf_dir}/orders.parquet"))
    new.register_unsharded("orders")
    new.execute("create table totals as select o_custkey, count(*) as n, max(o_totalprice) as top from orders group by o_custkey")
    new.execute("select o_custkey, n, top into copied from totals")
    return new.table("copied")


@query("select t as table_name, p as policy, k as shard_key from (values ('public.customer', 'sharded', 'c_custkey'), ('public.events', 'sharded', 'user_id,event_type'), ('public.lineitem', 'sharded', 'l_orderkey'), ('public.nation', 'replicated', ''), ('public.orders', 'sharded', 'o_orderkey'), ('public.part', 'sharded', 'p_partkey'), ('public.region', 'replicated', ''), ('public.supplier', 'sharded', 's_suppkey')) as x(t, p, k)")
def catalog_inventory(spark, sf_dir):
    return engine(spark, sf_dir).registry.inventory(spark).select("table_name", "policy", F.array_join("shard_key", ",").alias("shard_key"))


# --- routes, refusals, schema, reports ------------------------------------------------------

_ROUTES = (
    ("select * from orders where o_orderkey = 42", "single_shard"),
    ("select * from orders where o_orderkey = cast('0042' as bigint) and o_totalprice > 1", "single_shard"),
    ("select * from events where (event_type, user_id) = ('view', 7)", "single_shard"),
    ("select * from events where user_id = 7", "append_scatter"),
    ("select * from orders where o_orderkey = 42 or o_custkey = 1", "append_scatter"),
    ("select count(*) from orders", "global"),
    ("select * from orders order by o_orderkey", "global"),
    ("select * from orders join customer on o_custkey = c_custkey", "global"),
    ("select * from nation", "replicated"),
    ("select 1", "topology_independent"),
    ("create table x (a int)", "ddl"),
)


@query("select statement, kind from (values " + ", ".join("('{}', '{}')".format(q.replace("'", "''"), k) for q, k in _ROUTES) + ") as t(statement, kind)")
def explain_routes(spark, sf_dir):
    """What the planner proves of each statement, as EXPLAIN tells it."""
    e = engine(spark, sf_dir)
    told = [(q, e.planner.analyze(q).kind) for q, _ in _ROUTES]
    assert e.explain(_ROUTES[0][0]).startswith("route: single_shard")
    return spark.createDataFrame(told, "statement string, kind string")


_REFUSED = (
    ("insert into orders (o_orderkey) values (1) on conflict do nothing", "0A000"),
    ("select o_orderkey from orders for update", "0A000"),
    ("update orders set o_totalprice = 0 where o_custkey = 1", "0A000"),
    ("update orders set o_orderkey = 2 where o_orderkey = 1", "0A000"),
    ("delete from orders", "0A000"),
    ("merge into orders using nation on o_orderkey = n_nationkey when matched then delete", "0A000"),
    ("with gone as (delete from orders where o_orderkey = 1) select * from gone", "42601"),
    ("select distinct on (o_custkey) o_orderkey from orders order by o_orderkey", "42P10"),
    ("selec 1", "42601"),
    ("create function f() returns int as 'select 1'", "0A000"),
    ("create database other", "0A000"),
)


@query("select statement, code from (values " + ", ".join("('{}', '{}')".format(q.replace("'", "''"), k) for q, k in _REFUSED) + ") as t(statement, code)")
def refused_statements(spark, sf_dir):
    """The SQLSTATE of statements that are refused, before anything happens."""
    e = engine(spark, sf_dir)

    def code(sql: str) -> str:
        run = e.ddl if sql.startswith("create") else e.sql if sql.startswith(("sel", "with")) else e.execute
        try:
            run(sql)
        except Exception as x:  # noqa: BLE001  the code is what is asked for
            return str(x).partition(":")[0]
        return "00000"

    return spark.createDataFrame([(q, code(q)) for q, _ in _REFUSED], "statement string, code string")


@query("select c_custkey as id, c_name as name, cast(null as varchar) as note from customer")
def ddl_tables(spark, sf_dir):
    """A table made, keyed, filled, widened: schema statements over a sharded table with rows."""
    from .engine import Engine

    e = Engine(spark, folder(spark, "ddl"), shards=["shard1", "shard2", "shard3"])
    e.ddl("create table people (id bigserial primary key, name text not null); comment on column people.id is 'app.shard_key'")
    e.load("people", spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as id", "c_name as name"))
    e.ddl("alter table people add column note text")
    return e.sql("select id, name, note from people")


@query(f"select case when v < 20000 then 'shard3' when v % 2 = 0 then 'shard2' else 'shard1' end as shard, count(*) as n from (select {_LINE} as v from lineitem) group by 1")
def topology_moved_slots(spark, sf_dir):
    """Rows by owner after a new shard has joined and has been given some slots."""
    from dataclasses import replace

    from ..sources.storage import placed
    from ..sources.topology import Shard

    e = engine(spark, sf_dir)
    moved = e.topology.distribution("public.lineitem").moved(list(range(20_000)), "shard3")
    new = replace(e.topology.with_shard(Shard("shard3", "adding"), 1.0), distributions=e.topology.distributions | {e.topology.tables["public.lineitem"]: moved})
    return placed(e.table("lineitem"), "lineitem", e.registry, new).groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("n"))


_BEFORE = "case when o_orderkey % 7 = 0 then 'not ok ' else 'ok ' end || o_orderkey || ' - t' || o_orderkey || '   ' || (o_orderkey % 50) || ' ms' || case when o_orderkey % 11 = 0 then ' # SKIP none' else '' end"
_AFTER = "case when o_orderkey % 5 = 0 then 'not ok ' else 'ok ' end || o_orderkey || ' - t' || o_orderkey || '   ' || (o_orderkey % 50) || ' ms'"


@query("select 't' || o_orderkey as test, min(case when o_orderkey % 13 = 0 then 'missing' else 'fail' end) as now from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 and (o_orderkey % 5 = 0 or o_orderkey % 13 = 0) group by 1")
def report_regressions(spark, sf_dir):
    """Tests that passed in one TAP report and fail or are missing in the next, a test for each order."""
    from ..operators import report

    o = engine(spark, sf_dir).table("orders").select("o_orderkey").distinct()
    before = report.tap_results(o.select(F.expr(_BEFORE).alias("value")))
    after = report.tap_results(o.where("o_orderkey % 13 <> 0").select(F.expr(_AFTER).alias("value")))
    return report.regressions(before, after).select("test", "now")


@query("select p_partkey, 'shard-' || substr(sha256('shard' || chr(0) || p_name), 1, 20) as id from part")
def stable_ids(spark, sf_dir):
    from ..functions.sqltext import stable_shard_id

    return engine(spark, sf_dir).table("part").select("p_partkey", stable_shard_id("p_name").alias("id"))


@query("select tags, tag from (values ('INSERT 0 3,INSERT 0 4', 'INSERT 0 7'), ('UPDATE 1,UPDATE 0', 'UPDATE 1'), ('SELECT 5', 'SELECT 5'), ('CREATE TABLE,CREATE TABLE', 'CREATE TABLE'), ('UPDATE 1,DELETE 1', 'FANOUT')) as t(tags, tag)")
def merged_tags(spark, sf_dir):
    from ..functions.sqltext import merged_tag

    lists = ("INSERT 0 3,INSERT 0 4", "UPDATE 1,UPDATE 0", "SELECT 5", "CREATE TABLE,CREATE TABLE", "UPDATE 1,DELETE 1")
    return spark.createDataFrame([(x, merged_tag(x.split(","))) for x in lists], "tags string, tag string")


@query("select o_orderkey, o_custkey, o_orderstatus from orders")
def stream_copy(spark, sf_dir):
    """COPY from a folder as a stream: each micro-batch is one publication that holds the batch's number."""
    from ..streaming.ingest import copy_stream
    from .engine import Engine

    orders = engine(spark, sf_dir).table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = folder(spark, "stream-in")
    copy_out(orders, path, plan_copy("orders", orders.columns, False, [("format", "csv")]))
    e = Engine(spark, folder(spark, "stream-out"), shards=["shard1", "shard2"])
    e.register("orders", ["o_orderkey"], ["bigint"])
    e.load("orders", orders.limit(0))
    copy_stream(e, "orders", path, plan_copy("orders", orders.columns, True, [("format", "csv")], e.registry), folder(spark, "stream-state")).awaitTermination()
    return e.table("orders")


@query("select 'orders' as t, count(*) as n, round(sum(case when o_orderstatus = 'F' then 0 else o_totalprice end), 2) as total from orders union all select 'log', 1, 0")
def dml_batch_of_kinds(spark, sf_dir):
    """An update of one table and an insert into another, published by one revision."""
    from .engine import Engine

    e = Engine(spark, folder(spark, "kinds"), shards=["shard1", "shard2"])
    e.register("o", ["o_orderkey"], ["bigint"])
    e.register_unsharded("log")
    e.load("o", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    with e.batch() as b:
        b.update("o", {"o_totalprice": F.lit(0.0)}, F.col("o_orderstatus") == "F")
        b.insert("log", spark.createDataFrame([("zeroed",)], "what string"))
    totals = e.sql("select 'orders' as t, count(*) as n, round(sum(o_totalprice), 2) as total from o")
    return totals.union(e.sql("select 'log' as t, count(*) as n, cast(0 as double) as total from log"))
