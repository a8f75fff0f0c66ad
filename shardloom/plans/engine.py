"""One logical database over sharded and unsharded tables."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.canonical import spark_type
from ..functions.hashing import literal_vshard
from ..operators.ddl import FeatureNotSupported, check_ddl, normalize_ddl, parse_create, shard_key_comment, statements
from ..sources.copy_format import copy_in, copy_out, plan_copy
from ..sources.registry import Registry, table_name
from ..sources.storage import BUCKET, BUCKET_DIR, PLACEMENT, SHARD, SLOT, ShardedStorage, placed
from ..sources.store import Conflict, IdAllocator, ManifestStore
from ..sources.topology import Topology, bootstrap
from .clauses import split
from .dialect import hidden, parse_copy, postgres, shown
from .routing import Planner, RoutePlan, UnsafeRouting, integer_divisions

REPLICATED_MOST = 64 << 20  # bytes of a replicated table that joins may broadcast
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}


def numbered(args: dict | list | None, sql: str) -> dict | list | None:
    """Values of $1, $2, ... by the names that postgres() gives them."""
    return {f"p{i}": v for i, v in enumerate(args, 1)} if isinstance(args, list) and re.search(r"\$\d", hidden(sql)[0]) else args


@dataclass(frozen=True)
class CommandResult:
    tag: str
    rows: int


class Prepared:
    """A statement parsed once; each bind plans its own route."""

    def __init__(self, engine: Engine, sql: str) -> None:
        self.engine, self.sql = engine, sql
        engine.planner.prepare(postgres(sql))

    def route(self, args: dict | list | None = None) -> RoutePlan:
        return self.engine.planner.analyze(postgres(self.sql), numbered(args, self.sql))

    def bind(self, args: dict | list | None = None) -> DataFrame:
        return self.engine.sql(self.sql, args)


class Batch:
    """Staged changes; leaving the block publishes all of them by one compare-and-swap.

    A batch does not see its own changes. An update or delete of a table that another writer
    changed since, or that the batch changes twice, is a Conflict and nothing is published.
    """

    def __init__(self, engine: Engine) -> None:
        self.engine, self.changes, self.plain = engine, [], []

    def __enter__(self) -> Batch:
        return self

    def insert(self, name: str, df: DataFrame) -> None:
        e, full = self.engine, table_name(name)
        spec = e.registry.sharded(full)
        if full in e.attached:
            self.plain.append((full, df))
            return
        if spec and spec.generated and spec.key[0] not in df.columns:
            columns = df.columns
            df = e.ids.numbered(df, full, spec.key[0], *columns)
        known = e.storage._content(full)
        if known:  # the stored order of columns
            names = [f["name"] for f in json.loads(known["schema"])["fields"] if f["name"] not in PLACEMENT]
            df = df.select(*names) if set(names) == set(df.columns) else df
        self.changes.append(e.storage.appended(full, e.storage.stage(placed(df, full, e.registry, e.topology) if spec else df, full)))
        e.ids.close()

    def update(self, name: str, changes: dict[str, Column], where: Column, route: RoutePlan | None = None) -> int:
        """The number of rows that change."""
        e, full = self.engine, table_name(name)
        spec = e.registry.sharded(full)
        if spec and set(changes) & set(spec.key):
            raise UnsafeRouting("an update does not change the shard key")
        hit = F.coalesce(where, F.lit(False))
        return self._rewrite(full, lambda df: df.withColumns({c: F.when(hit, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()}), hit, route)

    def delete(self, name: str, where: Column, route: RoutePlan | None = None) -> int:
        hit = F.coalesce(where, F.lit(False))
        return self._rewrite(table_name(name), lambda df: df.where(~hit), hit, route)

    def mark(self, key: str, number: int) -> None:
        """A number that is published with the rest, once."""
        self.changes.append(self.engine.storage.marked(key, number))

    def _rewrite(self, full: str, change, hit: Column, route: RoutePlan | None) -> int:
        """Copy on write: of the directories that hold hit rows, or of an unsharded table."""
        e = self.engine
        n = e.table(full, route).where(hit).count()
        if not n:
            return 0
        if full not in e.registry.tables:
            seen = e.storage.revision(full)
            new = e.storage.stage(change(e.table(full)), full)
            self.changes.append(e.storage.replaced(full, new, seen))
            return n
        seen = e.storage.revision(full)
        if route is not None and route.vshard is not None:
            touched = [(route.shard, route.vshard // BUCKET)]
        else:  # a directory is one of at most 16 of each shard
            touched = [tuple(r) for r in e.storage.read(full).where(hit).select(SHARD, BUCKET_DIR).distinct().collect()]
        self.changes.append(e.storage.staged_rewrite(change, full, touched, seen))
        return n

    def __exit__(self, kind, value, trace) -> None:
        if kind is not None:
            return
        e = self.engine
        if self.changes:
            e.storage.publish(self.changes)
        for full, df in self.plain:  # tables that are backed from outside: this engine alone sees the rows
            now = e.attached[full]
            path = f"{e.folder}/{full}-{uuid.uuid4().hex}"
            df.select(*now.columns).write.parquet(path)
            e.attached[full] = now.union(e.spark.read.schema(now.schema).parquet(path))


class Engine:
    """Tables by name, with PostgreSQL's view of sharding.

    A sharded table is backed by the sharded layout, or by a plain DataFrame that gives the same
    rows (attach); results never show placement columns. strict refuses, like a router without
    a global executor, what needs more than an append of shards.
    """

    def __init__(self, spark: SparkSession, folder: str, registry: Registry | None = None, topology: Topology | None = None, *, shards: list[str] | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        self.storage = ShardedStorage(spark, folder)
        self.catalog = ManifestStore(spark, f"{self.folder}/_catalog")
        self.ids = IdAllocator(self.catalog)
        if registry is None:
            _, saved = self.catalog.latest("registry")
            registry = Registry.from_json(saved) if saved else Registry()
        if topology is None:
            _, saved = self.catalog.latest("topology")
            topology = Topology.from_json(saved) if saved else bootstrap(registry, shards or ["shard1", "shard2"], time.time())
        self.registry, self.topology = registry, topology
        self.attached: dict[str, DataFrame] = {}
        self.temporary: dict[str, tuple] = {}
        self.deferred: dict[str, DataFrame] = {}
        self.bucketed: dict[str, tuple[list, str]] = {}  # the versions that a copy is of, and its name
        self._plan()

    def _plan(self) -> None:
        self.planner = Planner(self.spark, self.registry, self.topology)

    def save(self) -> None:
        """Publish registry and topology as new revisions if they changed."""
        self.catalog.update("registry", lambda _: self.registry.to_json())
        self.catalog.update("topology", lambda _: self.topology.to_json())

    def register(self, name: str, key: list[str], types: list[str], *, generated: bool = False, distribution: str = "default") -> None:
        from ..sources.topology import Distribution

        self.registry = self.registry.with_sharded(name, key, types, generated)
        distributions = self.topology.distributions
        if distribution not in distributions:
            distributions = distributions | {distribution: Distribution.modulo(self.topology.routable())}
        self.topology = replace(self.topology, distributions=distributions, tables=self.topology.tables | {table_name(name): distribution}, schema_fingerprint=self.registry.fingerprint(), revision=self.topology.revision + 1, updated=time.time())
        self._plan()

    def register_unsharded(self, name: str, policy: str = "primary") -> None:
        self.registry = self.registry.with_unsharded(name, policy)
        self._plan()

    def attach(self, name: str, df: DataFrame) -> None:
        """Back a table by a DataFrame instead of the layout."""
        self.attached[table_name(name)] = df

    def defer(self, name: str, df: DataFrame) -> None:
        """load() when the table is first used."""
        self.deferred[table_name(name)] = df

    def _ready(self, full: str) -> None:
        if full in self.deferred:
            self.load(full, self.deferred.pop(full))

    def load(self, name: str, df: DataFrame) -> None:
        """Append rows; each is placed by its key, all of them become visible at once.

        A table of many versions is compacted, unless another writer is at it.
        """
        with self.batch() as b:
            b.insert(name, df)
        full = table_name(name)
        if full not in self.attached and len(self.storage._content(full)["versions"]) >= self.storage.MANY:
            try:
                self.storage.compact(full)
            except Conflict:
                pass

    def colocate(self, *names: str, buckets: int | None = None) -> None:
        """Keep copies of sharded tables that are bucketed and sorted by their shard keys.

        Joins and groupings on the keys of tables in as many buckets then need no shuffle. A copy
        serves until its table changes; reads of one key still go to the one directory. buckets:
        the number of shuffle partitions, if not given; each should fit a task's memory.
        """
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for full in map(table_name, names):
            self._ready(full)
            key, target = list(self.registry.sharded(full).key), f"__b{uuid.uuid4().hex[:16]}"
            seen, rows = self.storage.versions(full), self.storage.read(full).drop(*PLACEMENT)
            rows.repartition(n, *key).write.bucketBy(n, *key).sortBy(*key).option("path", f"{self.folder}/{full}/_{target}").saveAsTable(target)
            old = self.bucketed.get(full)
            self.bucketed[full] = seen, target
            if old:
                self.spark.sql(f"drop table if exists {old[1]}")

    def compact(self, name: str, *, vacuum: bool = False) -> int:
        """Write a table's versions as one; vacuum also removes files that no revision lists. Returns the versions before."""
        n = self.storage.compact(name)
        if vacuum:
            self.storage.vacuum(name)
        return n

    def batch(self) -> Batch:
        """Inserts, updates and deletes in any tables that become visible together, or not at all."""
        return Batch(self)

    def session(self) -> Engine:
        """The same tables with settings and temporary tables of its own."""
        return Engine(self.spark.newSession(), self.folder, self.registry, self.topology)._with(self.attached, self.deferred)

    def _with(self, attached: dict[str, DataFrame], deferred: dict[str, DataFrame]) -> Engine:
        self.attached, self.deferred = dict(attached), deferred
        return self

    def create_temporary(self, name: str, df: DataFrame) -> None:
        """A table that this engine alone sees; it hides a durable one until it is discarded."""
        full = table_name(name)
        self.temporary.setdefault(full, (self.attached.get(full), self.registry))
        self.registry = self.registry.with_unsharded(full)
        self.attached[full] = df
        self._plan()

    def discard_temporary(self) -> None:
        for full, (before, registry) in reversed(self.temporary.items()):
            self.attached.pop(full)
            if before is not None:
                self.attached[full] = before
            self.registry = registry
        self.temporary.clear()
        self._plan()

    def copy(self, sql: str, stream: str | None = None) -> CommandResult:
        """COPY as text. FROM reads files at the path (or stream), TO writes them there.

        Rows into a sharded table are routed one by one and become visible together.
        """
        c = parse_copy(sql)
        place = c["place"] or stream
        if place is None:
            raise ValueError("name the files of the COPY stream")
        if not c["incoming"]:
            df = self.sql(c["query"]) if c["query"] else self._in_append_order(c["table"])
            plan = plan_copy(c["table"] or "query", c["columns"] or df.columns, False, c["options"], self.registry)
            n = copy_out(df, place, plan)
            return CommandResult(f"COPY {n}", n)
        target = self.table(c["table"])
        spec = self.registry.sharded(c["table"])
        plan = plan_copy(c["table"], c["columns"] or ([] if spec else target.columns), True, c["options"], self.registry)
        rows = copy_in(self.spark, place, plan, StructType([target.schema[k] for k in plan.columns]))
        rows = rows.select(*[F.col(k) if k in plan.columns else F.lit(None).cast(target.schema[k].dataType).alias(k) for k in target.columns])
        n = self.insert(c["table"], rows).rows
        return CommandResult(f"COPY {n}", n)

    def _in_append_order(self, name: str) -> DataFrame:
        """A table's rows shard by shard, in the order of the shards' names; files of COPY TO follow it."""
        full = table_name(name)
        if full in self.attached or full not in self.registry.tables:
            return self.table(name)
        return self.placed_table(full).repartitionByRange(F.col(SHARD), F.col(SLOT)).sortWithinPartitions(SHARD, SLOT).drop(*PLACEMENT)

    # --- reading

    def placed_table(self, name: str) -> DataFrame:
        """With _shard, _vb and _vshard, if it is sharded."""
        full = table_name(name)
        self._ready(full)
        if full in self.attached:
            df = self.attached[full]
            return placed(df, full, self.registry, self.topology) if full in self.registry.tables else df
        return self.storage.read(full)

    def table(self, name: str, route: RoutePlan | None = None) -> DataFrame:
        full = table_name(name)
        self._ready(full)
        if full in self.attached:
            df = self.attached[full]
        elif full in self.bucketed and (route is None or route.vshard is None) and self.storage.versions(full) == self.bucketed[full][0]:
            df = self.spark.table(self.bucketed[full][1])
        else:
            df = self.storage.read(full)
            if route is not None and route.vshard is not None and route.table == full:
                df = df.where((F.col(SHARD) == route.shard) & (F.col(BUCKET_DIR) == route.vshard // BUCKET) & (F.col(SLOT) == route.vshard))
            df = df.drop(*PLACEMENT)
        if self.registry.policy(full) == "replicated" and self._small(df):
            df = df.hint("broadcast")
        return df

    def _small(self, df: DataFrame) -> bool:
        """Whether the optimizer bounds the table's bytes by REPLICATED_MOST; a larger one joins by its own size."""
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= REPLICATED_MOST

    def keyed(self, name: str, *values: object) -> DataFrame:
        """The rows of one key, read from one directory."""
        full = table_name(name)
        spec = self.registry.sharded(full)
        slot = literal_vshard([str(v) for v in values], list(spec.types))
        route = RoutePlan("single_shard", full, None, slot, self.topology.distribution(full).owner(slot))
        df = self.table(full, route)
        for k, v in zip(spec.key, values, strict=True):
            df = df.where(F.col(k) == F.lit(v))
        return df

    def keys_in(self, name: str, values: list) -> DataFrame:
        """The rows of several single-column keys: a superset of directories, then the exact filter."""
        full = table_name(name)
        spec = self.registry.sharded(full)
        slots = sorted({literal_vshard([str(v)], list(spec.types)) for v in values})
        df = self.placed_table(full).where(F.col(BUCKET_DIR).isin(sorted({s // BUCKET for s in slots})) & F.col(SLOT).isin(slots))
        return df.where(F.col(spec.key[0]).isin(values)).drop(*PLACEMENT)

    def sql(self, sql: str, args: dict | list | None = None, *, strict: bool = False) -> DataFrame:
        """Run a query over the logical tables; PostgreSQL spellings are rewritten (see dialect.postgres)."""
        sql, args = postgres(sql), numbered(args, sql)
        route = self.planner.analyze(sql, args)
        if strict and route.kind == "global":
            raise UnsafeRouting(route.reason)
        if route.write and not route.explain:
            raise UnsafeRouting("use execute() for statements that write")
        return self._run(sql, args, route)

    def _run(self, sql: str, args, route: RoutePlan) -> DataFrame:
        # A query sees its own views; they are inlined when it is analysed, so names can be reused.
        names = {n: f"__v{uuid.uuid4().hex[:12]}" for n in set(route.tables)}
        for full, view in names.items():
            self.table(full, route).createOrReplaceTempView(view)
        try:
            text = sql
            for start, parts, aliased in sorted(self.planner.prepare(sql).spots, reverse=True):
                if view := names.get(table_name(".".join(parts))):
                    end = re.compile(r"\s*\.\s*".join([r"(?:`(?:``|[^`])*`|\w+)"] * len(parts))).match(text, start).end()
                    text = text[:start] + view + ("" if aliased else f" as `{parts[-1]}`") + text[end:]
            run = lambda t: self.spark.sql(t, args) if args else self.spark.sql(t)
            out = run(text)
            while "/" in hidden(text)[0] and (whole := integer_divisions(out, text)):
                for at in sorted(whole, reverse=True):
                    text = f"{text[:at]} div {text[at + 1 :]}"
                out = run(text)
            return out
        finally:
            for view in names.values():
                self.spark.catalog.dropTempView(view)

    def prepare(self, sql: str) -> Prepared:
        return Prepared(self, sql)

    def explain(self, sql: str, args: dict | list | None = None) -> str:
        """The route, then Spark's plan."""
        sql, args = postgres(sql), numbered(args, sql)
        route = self.planner.analyze(sql, args)
        head = f"route: {route.kind}" + (f", shard {route.shard}, vshard {route.vshard}" if route.shard else "") + (f" ({route.reason})" if route.reason else "")
        if route.write:
            return head
        plan = self._run(sql, args, route)._jdf.queryExecution().toString()
        return f"{head}\n{plan}"

    # --- schema

    def ddl(self, sql: str) -> CommandResult:
        """CREATE, DROP and TRUNCATE TABLE, ADD COLUMN and the shard-key comment.

        A batch is checked as a whole before anything happens; its tables change together in one
        revision after its last statement, then the catalogs are published. If a statement fails
        nothing has happened. Serial and identity columns become generated BIGINT keys. A new table
        is unsharded until comments on its columns name the key, in the order of the comments.
        """
        check_ddl(sql)
        before = self.registry, self.topology, dict(self.attached)
        known = self.catalog.latest("definitions")[1] or {}
        changes: dict[str, Callable[[dict], dict]] = {}
        try:
            for s in statements(normalize_ddl(sql).sql):
                known = self._schema_statement(s, known, changes)
        except BaseException:
            self.registry, self.topology, self.attached = before
            self._plan()
            raise
        for full in changes:
            self.attached.pop(full, None)
        self.storage.publish(list(changes.values()))
        self.catalog.update("definitions", lambda _: known)
        self.save()
        return CommandResult(" ".join(statements(sql)[0].upper().split()[:2]), 0)

    def _schema_statement(self, s: str, known: dict, changes: dict) -> dict:
        """The definitions after a statement; its table's change is added, later statements see its rows as attached."""

        def put(full: str, rows: DataFrame) -> None:
            staged = self.storage.stage(placed(rows, full, self.registry, self.topology) if full in self.registry.tables else rows, full)
            changes[full] = self.storage.replaced(full, staged)
            self.attached[full] = rows

        def empty(full: str) -> None:
            put(full, self.spark.createDataFrame([], StructType([StructField(c, spark_type(kind)) for c, kind, _ in known[full]["columns"]])))

        if created := parse_create(s):
            full = table_name(created[0])
            if full in known:
                raise ValueError(f"42P07: {full} exists")
            known = known | {full: {"columns": [list(c) for c in created[1]], "key": []}}
            self.register_unsharded(full)
            empty(full)
        elif m := re.match(r"(?is)^drop\s+table\s+(if\s+exists\s+)?([\w.\"]+)", s):
            full = table_name(m[2])
            if full not in known and not m[1]:
                raise LookupError(f"42P01: no table {full}")
            known = {k: v for k, v in known.items() if k != full}
            self.attached.pop(full, None)
            changes[full] = lambda now: {k: v for k, v in now.items() if k != full}
            self.registry = self.registry.without(full)
            tables = {k: v for k, v in self.topology.tables.items() if k != full}
            self.topology = replace(self.topology, tables=tables, schema_fingerprint=self.registry.fingerprint(), revision=self.topology.revision + 1, updated=time.time())
            self._plan()
        elif m := re.match(r"(?is)^truncate\s+(?:table\s+)?([\w.\"]+)", s):
            if (full := table_name(m[1])) not in known:
                raise LookupError(f"42P01: no table {full}")
            empty(full)
        elif m := re.match(r"(?is)^alter\s+table\s+([\w.\"]+)\s+add\s+(?:column\s+)?(.+)$", s):
            if (full := table_name(m[1])) not in known:
                raise LookupError(f"42P01: no table {full}")
            _, (column,) = parse_create(f"create table x ({m[2]})")
            rows = self.table(full).withColumn(column[0], F.lit(None).cast(spark_type(column[1])))
            known = known | {full: known[full] | {"columns": [*known[full]["columns"], list(column)]}}
            put(full, rows)
        elif key := shard_key_comment(s):
            if (full := table_name(key[0])) not in known:
                raise LookupError(f"42P01: no table {full}")
            spec = known[full] | {"key": [*known[full]["key"], key[1]]}
            kinds = {c: (kind, identity) for c, kind, identity in spec["columns"]}
            rows = self.table(full)
            self.register(full, spec["key"], [kinds[k][0] for k in spec["key"]], generated=len(spec["key"]) == 1 and kinds[spec["key"][0]][1])
            known = known | {full: spec}
            put(full, rows)
        else:
            raise FeatureNotSupported(f"this schema change: {s[:40]}")
        return known

    def _replace(self, full: str, rows: DataFrame, seen: int | None = None) -> None:
        """Publish rows as the whole table; it is stored from now on. seen: the revision that rows come from."""
        self.storage.replace(placed(rows, full, self.registry, self.topology) if full in self.registry.tables else rows, full, seen)
        self.attached.pop(full, None)

    # --- writing

    def insert(self, name: str, rows: DataFrame) -> CommandResult:
        n = rows.count()
        self.load(name, rows)
        return CommandResult(f"INSERT 0 {n}", n)

    def update(self, name: str, changes: dict[str, Column], where: Column, route: RoutePlan | None = None) -> CommandResult:
        with self.batch() as b:
            n = b.update(self._stored(name), changes, where, route)
        return CommandResult(f"UPDATE {n}", n)

    def delete(self, name: str, where: Column, route: RoutePlan | None = None) -> CommandResult:
        with self.batch() as b:
            n = b.delete(self._stored(name), where, route)
        return CommandResult(f"DELETE {n}", n)

    def _stored(self, name: str) -> str:
        """An attached unsharded table is stored before it is changed."""
        full = table_name(name)
        if full in self.attached and full not in self.registry.tables:
            self._replace(full, self.attached[full])
        return full

    def merge(self, name: str, source: DataFrame, on: list[str]) -> CommandResult:
        """Upsert by a join: matched rows take the source's values, others are inserted."""
        full = table_name(name)
        if full in self.registry.tables:
            raise UnsafeRouting("MERGE on a sharded table")
        if source.groupBy(*on).count().where("count > 1").limit(1).count():
            raise ValueError("21000: MERGE would change a row twice")
        now = self.table(full)
        rest = now.join(source, on, "left_anti")
        n = source.count()
        self._replace(full, rest.select(*now.columns).union(source.select(*now.columns)))
        return CommandResult(f"MERGE {n}", n)

    def execute(self, sql: str, args: dict | list | None = None, *, strict: bool = True) -> CommandResult:
        """INSERT, UPDATE, DELETE, MERGE, CREATE TABLE AS or SELECT INTO as text.

        strict refuses writes without a complete key. MERGE takes unsharded tables. ON CONFLICT is refused.
        """
        text, held = hidden(sql)
        if re.search(r"(?i)\bon\s+conflict\b", text):
            raise FeatureNotSupported("INSERT with ON CONFLICT")
        if m := re.match(r"(?is)^\s*create\s+table\s+(if\s+not\s+exists\s+)?([\w.]+)\s+as\s+(.*)$", text):
            return self.create_as(m[2], shown(m[3], held), args, missing_only=bool(m[1]))
        if m := re.match(r"(?is)^\s*(select\b.*?)\binto\s+(?:table\s+)?([\w.]+)(.*)$", text):
            return self.create_as(m[2], shown(m[1] + m[3], held), args)
        sql, args = postgres(sql), numbered(args, sql)
        if re.match(r"(?is)^\s*merge\b", sql):
            return self._merge_text(sql, args)
        route = self.planner.analyze(sql, args)
        if not route.write:
            raise ValueError("execute() takes statements that write")
        if route.kind == "global" and (strict or route.write == "merge"):
            raise UnsafeRouting(route.reason)
        if route.write == "insert":
            m = re.match(r"(?is)\s*insert\s+into\s+([\w.\"]+)\s*(?:\(([^)]*)\))?\s*(.*)$", sql)
            if m[3].lower().startswith(("select", "with")):
                rows = self.sql(m[3], args)
            else:
                rows = self.spark.sql(f"select * from {m[3]}", args) if args else self.spark.sql(f"select * from {m[3]}")
            columns = [c.strip().strip('"') for c in m[2].split(",")] if m[2] else None
            target = self.table(route.table)
            columns = columns or target.columns
            rows = rows.toDF(*columns)
            spec = self.registry.sharded(route.table)
            cast = [F.col(c).cast(target.schema[c].dataType).alias(c) if c in columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns if c in columns or not (spec and spec.generated and c == spec.key[0])]
            return self.insert(route.table, rows.select(*cast))
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(self._bind(sql, args))
        if route.write == "update":
            changes = {plan.assignments().apply(i).key().sql().strip("`"): F.expr(plan.assignments().apply(i).value().sql()) for i in range(plan.assignments().size())}
            condition = F.expr(plan.condition().get().sql()) if plan.condition().isDefined() else F.lit(True)
            return self.update(route.table, changes, condition, route)
        return self.delete(route.table, F.expr(plan.condition().sql()), route)

    def create_as(self, name: str, query: str, args: dict | list | None = None, *, missing_only: bool = False) -> CommandResult:
        """CREATE TABLE AS and SELECT INTO: the query's rows as a new unsharded table."""
        full = table_name(name)
        known = self.catalog.latest("definitions")[1] or {}
        if full in known or full in self.registry.tables or full in self.registry.unsharded or full in self.attached:
            if missing_only:
                return CommandResult("CREATE TABLE AS", 0)
            raise ValueError(f"42P07: {full} exists")
        rows = self.sql(query, args)
        self.register_unsharded(full)
        self._replace(full, rows)
        columns = [[c, {"string": "text", "double": "double precision"}.get(kind, kind.replace("decimal", "numeric")), False] for c, kind in rows.dtypes]
        self.catalog.update("definitions", lambda now: (now or {}) | {full: {"columns": columns, "key": []}})
        self.save()
        n = self.table(full).count()
        return CommandResult(f"SELECT {n}", n)

    def _merge_text(self, sql: str, args: dict | list | None) -> CommandResult:
        """MERGE as one full join: each row's action is the first clause that fits it.

        A target row that two source rows would change is an error (21000), another writer's
        revision meanwhile a conflict.
        """
        text, held = hidden(self._bind(sql, args))
        m = re.match(r"(?is)^\s*merge\s+into\s+([\w.]+)(?:\s+(?:as\s+)?(?!using\b)(\w+))?\s+using\s+(.*?)\s+on\s+(.*?)(?=\s+when\s+(?:not\s+)?matched\b)(.*)$", text)
        if not m:
            raise ValueError("42601: this MERGE")
        full, source = table_name(m[1]), m[3].strip()
        alias = re.search(r"(\w+)$", source)[1]
        target = m[2] or full.partition(".")[2]
        if full in self.registry.tables:
            raise UnsafeRouting("MERGE on a sharded table")
        seen = self.storage.revision(full)
        now = self.table(full)
        left = now.withColumn("__t", F.monotonically_increasing_id()).alias(target)
        right = self.sql(shown(f"select * from {source}", held)).withColumn("__s", F.lit(True)).alias(alias)
        both = left.join(right, F.expr(shown(m[4], held)), "full_outer")
        action, values = F.lit(None).cast("int"), {}
        clauses = re.findall(r"(?is)\bwhen\s+(not\s+)?matched(?:\s+by\s+target)?(?:\s+and\s+(.*?))?\s+then\s+(update\s+set\s+.*?|delete|do\s+nothing|insert\s*.*?)(?=\s+when\s+(?:not\s+)?matched\b|\s*;?\s*$)", m[5])
        for i, (new, condition, what) in reversed(list(enumerate(clauses))):
            fits = F.col("__t").isNull() if new else F.col("__t").isNotNull() & F.col("__s").isNotNull()
            fits = fits & F.expr(shown(condition, held)) if condition else fits
            action = F.when(fits, F.lit(i)).otherwise(action)
            if what.lower().startswith("update"):
                pairs = [x.split("=", 1) for x in split(re.sub(r"(?i)^update\s+set\s+", "", what))]
                values[i] = {c.strip().rpartition(".")[2].lower(): shown(v.strip(), held) for c, v in pairs}
            elif what.lower().startswith("insert"):
                x = re.match(r"(?is)^insert\s*(?:\(([^)]*)\))?\s*values\s*\((.*)\)$", what.strip())
                if not x:
                    raise ValueError("42601: this INSERT of MERGE")
                columns = [c.strip().lower() for c in x[1].split(",")] if x[1] else [c.lower() for c in now.columns]
                values[i] = {c: "null" for c in map(str.lower, now.columns)} | dict(zip(columns, [shown(v, held) for v in split(x[2])], strict=True))
        acted = both.withColumn("__a", action)
        twice = acted.where("__a is not null and __t is not null").groupBy("__t").count().where("count > 1")
        if not twice.isEmpty():
            raise ValueError("21000: MERGE command cannot affect row a second time")
        gone = [i for i, (new, _, what) in enumerate(clauses) if what.lower() == "delete" or new and what.lower().startswith("do")]
        still = [i for i, (_, _, what) in enumerate(clauses) if what.lower().startswith("do")]
        n = acted.where(F.col("__a").isNotNull() & ~(F.col("__a").isin(still) if still else F.lit(False))).count()
        out = []
        for c in now.columns:
            value = F.col(f"{target}.{c}")
            for i, changed in values.items():
                if c.lower() in changed:
                    value = F.when(F.col("__a") == i, F.expr(changed[c.lower()]).cast(now.schema[c].dataType)).otherwise(value)
            out.append(value.alias(c))
        stays = F.when(F.col("__a").isNull(), F.col("__t").isNotNull()).otherwise(~F.col("__a").isin(gone) if gone else F.lit(True))
        self._replace(full, acted.where(stays).select(*out), seen)
        return CommandResult(f"MERGE {n}", n)

    @staticmethod
    def _bind(sql: str, args) -> str:
        """Named parameters as literals; quoted text stays."""
        if not isinstance(args, dict):
            return sql

        def one(m: re.Match) -> str:
            if m[1] is None:
                return m[0]
            v = args[m[1]]
            if v is None or isinstance(v, (bool, int, float)):
                return "null" if v is None else str(v).lower()
            return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

        return re.sub(r"'(?:''|[^'])*'|(?<![:\w]):(\w+)", one, sql)
