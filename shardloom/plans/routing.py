"""The route planner: which shards a statement needs, read off Spark's own parse tree.

Key equalities are proven before analysis, and become literals on the placement columns, so
that partition pruning needs no rule in the optimizer. What can't be proven runs globally.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from ..functions.canonical import UnsupportedShardKeyType
from ..functions.hashing import literal_vshard
from ..sources.registry import Registry, table_name
from ..sources.topology import Topology

# The names of PostgreSQL's aggregate functions.
AGGREGATES = frozenset(
    """any_value array_agg avg bit_and bit_or bit_xor bool_and bool_or corr count covar_pop covar_samp every
    json_agg json_agg_strict json_arrayagg json_object_agg json_object_agg_strict json_object_agg_unique
    json_object_agg_unique_strict json_objectagg jsonb_agg jsonb_agg_strict jsonb_object_agg
    jsonb_object_agg_strict jsonb_object_agg_unique jsonb_object_agg_unique_strict max min range_agg
    range_intersect_agg regr_avgx regr_avgy regr_count regr_intercept regr_r2 regr_slope regr_sxx regr_sxy
    regr_syy stddev stddev_pop stddev_samp string_agg sum var_pop var_samp variance xmlagg""".split()
)
# Aggregates of Spark that PostgreSQL writes otherwise.
OWN_AGGREGATES = frozenset("collect_list collect_set listagg percentile percentile_cont percentile_disc mode max_by min_by approx_count_distinct".split())
WRITES = {"InsertIntoStatement": "insert", "UpdateTable": "update", "DeleteFromTable": "delete", "MergeIntoTable": "merge"}


class UnsafeRouting(Exception):
    """The statement can't be proven to touch one shard (SQLSTATE 0A000)."""

    code = "0A000"

    def __init__(self, reason: str) -> None:
        super().__init__(f"0A000: {reason}")


@dataclass(frozen=True)
class RoutePlan:
    """kind: single_shard, append_scatter, global, unsharded, replicated, topology_independent, ddl."""

    kind: str
    table: str | None = None
    write: str | None = None
    vshard: int | None = None
    shard: str | None = None
    reason: str | None = None
    tables: tuple[str, ...] = field(default=())
    explain: bool = False


@dataclass
class Skeleton:
    """What a statement's text says; parameters are bound later."""

    sql: str
    write: str | None
    relations: list[str]
    equalities: list[tuple[tuple[str, ...], object]] | None  # None: the condition does not prove a key
    updated: list[str]
    scatter_reason: str | None
    rows: int | None
    cte: bool
    explain: bool
    command: bool
    aliases: dict[str, str]
    simple: bool
    places: tuple[int, ...]  # of positional parameters in the text
    spots: tuple[tuple[int, tuple[str, ...], bool], ...]  # where a relation's name begins, its parts, whether it has an alias


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _walk(node, analyzed: bool = False) -> list:
    """The plan nodes of a tree, those of its subqueries included; of an analysed one not what lies in views."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        out.append(n)
        name = _name(n)
        if analyzed and name == "View":
            continue
        todo += _seq(n.children())
        if name == "UnresolvedWith":
            todo += [r._2() for r in _seq(n.cteRelations())]
        if name == "ExplainCommand":
            todo.append(n.logicalPlan())
        for e in _seq(n.expressions()):
            todo += [x.plan() for x in _expressions(e) if _name(x) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")]
    return out


def _expressions(e) -> list:
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += _seq(x.children())
        if _name(x) == "InSubquery":
            todo.append(x.query())
    return out


class _Unknown:
    pass


UNKNOWN = _Unknown()


@dataclass(frozen=True)
class Parameter:
    key: object  # a name, or the place in the text


def _constant(e):
    """(text, type) of a literal, a Parameter, or UNKNOWN."""
    name = _name(e)
    if name == "Literal":
        if e.value() is None:
            return UNKNOWN
        text = e.value().toString() if hasattr(e.value(), "toString") else str(e.value())
        return ("true" if text == "True" else "false" if text == "False" else text), None
    if name == "Cast":
        inner = _constant(e.child())
        return (inner[0], e.dataType().sql().lower()) if isinstance(inner, tuple) else UNKNOWN
    if name in ("UnaryMinus", "UnaryPositive"):
        inner = _constant(e.child())
        return (("-" if name == "UnaryMinus" else "") + inner[0], inner[1]) if isinstance(inner, tuple) else UNKNOWN
    if name == "NamedParameter":
        return Parameter(e.name())
    if name == "PosParameter":
        return Parameter(e.pos())
    return UNKNOWN


def _start(node) -> int:
    """Where in the text a node begins; the parser counts whole characters."""
    at = node.origin().startIndex()
    return at.get() if at.isDefined() else -1


def _column(e) -> tuple[str, ...] | None:
    return tuple(_seq(e.nameParts())) if _name(e) == "UnresolvedAttribute" else None


def _pairs(e) -> list[tuple[tuple[str, ...], object]] | None:
    """Equalities that hold in every row that e keeps; None if OR or NOT makes that unsure."""
    name = _name(e)
    if name == "And":
        left, right = _pairs(e.left()), _pairs(e.right())
        return None if left is None or right is None else left + right
    if name in ("Or", "Not"):
        return None
    if name != "EqualTo":
        return []
    a, b = e.left(), e.right()
    if _name(a) == _name(b) == "CreateNamedStruct":
        left, right = _seq(a.valExprs()), _seq(b.valExprs())
        if len(left) != len(right):
            return None
        both = list(zip(left, right, strict=True))
    else:
        both = [(a, b)]
    out = []
    for x, y in both:
        column, value = (_column(x), y) if _column(x) else (_column(y), x)
        if column:
            out.append((column, _constant(value)))
    return out


def skeleton(spark: SparkSession, sql: str) -> Skeleton:
    """Parse once; raises ParseException (42601) on text that is no statement."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ParseException(f"42601: {str(e).splitlines()[0]}") from None
    explain = _name(plan) == "ExplainCommand"
    analyzed = explain and "analyze" in sql.lower().split()[:3]
    if explain:
        plan = plan.logicalPlan()
    cte = _name(plan) == "UnresolvedWith"
    nodes = _walk(plan)
    relations = [".".join(_seq(n.multipartIdentifier())) for n in nodes if _name(n) == "UnresolvedRelation"]
    if cte:
        local = {r._1() for n in nodes if _name(n) == "UnresolvedWith" for r in _seq(n.cteRelations())}
        relations = [r for r in relations if r not in local]
    writes = [WRITES[_name(n)] for n in nodes if _name(n) in WRITES]
    aliases = {}
    for n in nodes:
        if _name(n) == "SubqueryAlias" and _name(n.child()) == "UnresolvedRelation":
            aliases[n.alias()] = ".".join(_seq(n.child().multipartIdentifier()))
    write = writes[0] if writes and not (explain and not analyzed) else None
    kinds = {_name(n) for n in nodes}
    expressions = [x for n in nodes for e in _seq(n.expressions()) for x in _expressions(e)]
    functions = {_seq(x.nameParts())[-1].lower() for x in expressions if _name(x) == "UnresolvedFunction"}
    subquery = any(_name(x) in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery") for x in expressions)
    window = any(_name(x) in ("WindowExpression", "UnresolvedWindowExpression") for x in expressions) or "WithWindowDefinition" in kinds
    reason = None
    for text, found in (
        ("set operations over sharded tables", kinds & {"Union", "Intersect", "Except"}),
        ("common table expressions and nested queries over sharded tables", cte or subquery or sum(_name(n) in ("Project", "Aggregate") for n in nodes) > 1),
        ("joins over sharded tables", len(relations) > 1),
        ("DISTINCT over sharded tables", kinds & {"Distinct", "Deduplicate"}),
        ("aggregates, GROUP BY, HAVING or windows over sharded tables", kinds & {"Aggregate", "UnresolvedHaving"} or window or functions & (AGGREGATES | OWN_AGGREGATES)),
        ("ORDER BY over sharded tables", "Sort" in kinds),
        ("LIMIT or OFFSET over sharded tables", kinds & {"GlobalLimit", "LocalLimit", "Offset"}),
    ):
        if found:
            reason = f"{text} need a complete shard key"
            break
    condition = [n.condition() for n in nodes if _name(n) == "Filter"]
    updated, rows = [], None
    root = plan if not cte else None
    if write == "update" and root is not None:
        updated = [_column(a.key())[-1] for a in _seq(plan.assignments()) if _column(a.key())]
        condition = [plan.condition().get()] if plan.condition().isDefined() else []
    if write == "delete" and root is not None:
        condition = [plan.condition()]
    equalities: list | None = []
    if write == "insert" and _name(plan) == "InsertIntoStatement":
        equalities, rows = _inserted(plan)
        relations = [".".join(_seq(plan.table().multipartIdentifier())), *relations]
    else:
        for c in condition:
            found = _pairs(c)
            equalities = None if found is None or equalities is None else equalities + found
    places = sorted({x.pos() for x in expressions if _name(x) == "PosParameter"})
    named = {_start(n) for n in nodes if _name(n) == "SubqueryAlias"}
    spots = {(_start(n), tuple(_seq(n.multipartIdentifier())), _start(n) in named) for n in nodes if _name(n) == "UnresolvedRelation"}
    command = not write and not (kinds & {"Project", "Aggregate", "UnresolvedRelation", "UnresolvedInlineTable", "LocalRelation"})
    simple = not subquery and not kinds & {"Union", "Intersect", "Except", "Join", "MergeIntoTable"}
    return Skeleton(sql, write, relations, equalities, updated, reason, rows, cte, explain, command, aliases, simple, tuple(places), tuple(spots))


def _inserted(plan) -> tuple[list, int | None]:
    query, columns = plan.query(), _seq(plan.userSpecifiedCols())
    name = _name(query)
    if name == "LocalRelation":
        data, kinds = _seq(query.data()), [a.dataType() for a in _seq(query.output())]
        if len(data) != 1 or len(columns) != len(kinds):
            return [], len(data)
        values = [data[0].get(i, k) for i, k in enumerate(kinds)]
        texts = [None if v is None else v.toString() if hasattr(v, "toString") else str(v).lower() if isinstance(v, bool) else str(v) for v in values]
        return [((c,), UNKNOWN if t is None else (t, None)) for c, t in zip(columns, texts, strict=True)], 1
    if name == "UnresolvedInlineTable":
        found = [_seq(r) for r in _seq(query.rows())]
        if len(found) != 1 or len(columns) != len(found[0]):
            return [], len(found)
        return [((c,), _constant(e)) for c, e in zip(columns, found[0], strict=True)], 1
    return [], None


def integer_divisions(df: DataFrame, text: str) -> list[int]:
    """Where in the text a / divides integers by integers: PostgreSQL truncates there, Spark's / does not.

    Read off the analysed plan, in which both sides of such a division were cast without the
    text saying so.
    """
    whole = ("tinyint", "smallint", "int", "bigint")
    held = re.compile(r"'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
    blank = held.sub(lambda m: "\x01" * len(m[0]), text)
    out = set()
    for n in _walk(df._jdf.queryExecution().analyzed(), analyzed=True):
        for e in _seq(n.expressions()):
            for x in _expressions(e):
                if _name(x) != "Divide" or not x.origin().sqlText().isDefined() or x.origin().sqlText().get() != text:
                    continue
                span = lambda y: (y.origin().startIndex().get(), y.origin().stopIndex().get()) if y.origin().stopIndex().isDefined() else None
                sides = (x.left(), x.right())
                if not all(_name(y) == "Cast" and span(y) == span(x) and y.child().dataType().sql().lower() in whole for y in sides):
                    continue
                first, last = span(x)
                depth, at = 0, None
                for i in range(first, last + 1):  # the last operator outside parentheses is this one
                    depth += (blank[i] in "([") - (blank[i] in ")]")
                    if blank[i] == "/" and not depth:
                        at = i
                if at is not None:
                    out.add(at)
    return sorted(out)


class Planner:
    def __init__(self, spark: SparkSession, registry: Registry, topology: Topology) -> None:
        self.spark, self.registry, self.topology = spark, registry, topology
        self.prepare = lru_cache(maxsize=1024)(lambda sql: skeleton(spark, sql))

    def analyze(self, sql: str, args: dict | list | None = None) -> RoutePlan:
        """The route of a statement with its parameters bound."""
        s = self.prepare(sql)
        names = [table_name(r) for r in s.relations]
        sharded = [n for n in names if n in self.registry.tables]
        if s.command or (not names and not s.write):
            return RoutePlan("ddl" if s.command and not s.sql.lstrip().lower().startswith(("show", "set", "describe", "desc")) else "topology_independent", explain=s.explain)
        if not sharded:
            policies = {self.registry.policy(n) or "primary" for n in names}
            return RoutePlan("replicated" if policies == {"replicated"} else "unsharded", names[0] if names else None, s.write, tables=tuple(names), explain=s.explain)
        table = sharded[0]
        slot, why = self._key(s, table, len(names), args)
        if slot is not None:
            return RoutePlan("single_shard", table, s.write, slot, self.topology.distribution(table).owner(slot), tables=tuple(names), explain=s.explain)
        if s.write:
            return RoutePlan("global", table, s.write, reason=f"{s.write} on a sharded table needs a complete shard key: {why}", tables=tuple(names), explain=s.explain)
        if s.scatter_reason:
            return RoutePlan("global", table, None, reason=s.scatter_reason, tables=tuple(names), explain=s.explain)
        return RoutePlan("append_scatter", table, None, reason=why, tables=tuple(names), explain=s.explain)

    def _key(self, s: Skeleton, table: str, relations: int, args) -> tuple[int | None, str]:
        """The virtual shard that the statement's key equalities prove, or why none."""
        spec = self.registry.tables[table]
        if relations != 1 or s.cte or not s.simple:
            return None, "one relation and no nested query"
        if s.write == "insert" and s.rows != 1:
            return None, "one row of values"
        if s.write == "merge" or (s.write == "update" and set(s.updated) & set(spec.key)):
            return None, "the key does not change"
        if s.equalities is None:
            return None, "conditions joined by AND"
        names = {table, table.partition(".")[2], *[a for a, t in s.aliases.items() if table_name(t) == table]}
        seen: dict[str, object] = {}
        for column, value in s.equalities:
            if len(column) > 1 and ".".join(column[:-1]) not in names:
                continue
            if column[-1] in spec.key:
                if column[-1] in seen:
                    return None, f"one value for {column[-1]}"
                seen[column[-1]] = value
        if set(seen) != set(spec.key):
            return None, f"values for {', '.join(k for k in spec.key if k not in seen)}"
        texts = []
        for k in spec.key:
            value = self._bound(seen[k], args, s.places)
            if value is UNKNOWN:
                return None, f"a constant for {k}"
            texts.append(value[0])
        try:
            slot = literal_vshard(texts, list(spec.types))
        except UnsupportedShardKeyType:
            slot = None
        return slot, "values of the key's type"

    @staticmethod
    def _bound(value, args, places: tuple[int, ...]):
        if not isinstance(value, Parameter):
            return value
        if isinstance(args, dict) and isinstance(value.key, str):
            given = args.get(value.key)
        elif isinstance(args, list) and value.key in places and len(args) == len(places):
            given = args[places.index(value.key)]
        else:
            return UNKNOWN
        return UNKNOWN if given is None else (str(given).lower() if isinstance(given, bool) else str(given), None)
