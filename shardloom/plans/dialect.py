"""PostgreSQL spellings that Spark's parser lacks, rewritten outside quotes and comments."""

from __future__ import annotations

import re

from ..operators.ddl import FeatureNotSupported
from .clauses import closing, null_order, ordered_item, rewritten, split

TOKEN = re.compile(r"'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|--[^\n]*|/\*.*?\*/", re.S)


def hidden(sql: str) -> tuple[str, list[str]]:
    """The text with quotes and comments replaced by numbered marks."""
    held: list[str] = []

    def hide(m: re.Match) -> str:
        if m[0].startswith(("--", "/*")) and not m[0].startswith("/*+"):  # hints stay
            return " "
        held.append(m[0])
        return f"\x01{len(held) - 1}\x02"

    return TOKEN.sub(hide, sql), held


def shown(text: str, held: list[str]) -> str:
    """The quotes back in their places."""
    return re.sub("\x01(\\d+)\x02", lambda m: held[int(m[1])], text)


def _json(x: str) -> str:
    """The JSON text of a value."""
    return f"substr(to_json(array({x})), 2, length(to_json(array({x}))) - 2)"


def _listed(value: str, separator: str, order: str, condition: str) -> str:
    return f"listagg({value}, {separator})" + (f" within group (order by {order})" if order else "") + condition


def _sorted_array(value: str, order: str, condition: str) -> str:
    """array_agg with an order: an array of keys and value, put in order by a comparison."""
    keys = [ordered_item(x) for x in split(order)]
    parts = ", ".join([*[f"({e}) as k{i}" for i, (e, _) in enumerate(keys)], f"({value}) as v"])
    tests = []
    for i, (_, way) in enumerate(keys):
        less, first = ("-1", "1") if way.startswith("asc") else ("1", "-1"), "-1" if way.endswith("nulls first") else "1"
        last = "1" if first == "-1" else "-1"
        tests.append(f"when a.k{i} is null and b.k{i} is not null then {first} when a.k{i} is not null and b.k{i} is null then {last} when a.k{i} < b.k{i} then {less[0]} when a.k{i} > b.k{i} then {less[1]}")
    rows = f"collect_list(struct({parts})){condition}"
    return f"transform(array_sort({rows}, (a, b) -> case {' '.join(tests)} else 0 end), s -> s.v)"


AGGREGATE = re.compile(r"(?i)\b(string_agg|xmlagg|array_agg|jsonb?_agg(?:_strict)?|jsonb?_object_agg(?:_strict)?)\s*\(")


def _ordered_aggregates(text: str) -> str:
    """string_agg(x, s ORDER BY y) -> listagg(x, s) WITHIN GROUP (ORDER BY y); so the aggregates of JSON, XML and arrays.

    A FILTER clause goes along to the aggregate inside.
    """
    out, at = [], 0
    for m in AGGREGATE.finditer(text):
        if m.start() < at:
            continue
        name, end = m[1].lower(), closing(text, m.end() - 1)
        body = _ordered_aggregates(text[m.end() : end])
        parts = re.split(r"(?i)\border\s+by\b", body, maxsplit=1)
        order = parts[1].strip() if len(parts) == 2 else ""
        values, end = split(parts[0]), end + 1
        if f := re.match(r"(?i)\s*filter\s*(?=\()", text[end:]):
            stop = closing(text, end + f.end()) + 1
            condition, end = f" filter {text[end + f.end() : stop]}", stop
        else:
            condition = ""
        if name == "string_agg":
            new = _listed(values[0], values[1], order, condition)
        elif name == "xmlagg":
            new = _listed(values[0], "''", order, condition)
        elif name == "array_agg":
            new = _sorted_array(values[0], order, condition) if order else f"array_agg({values[0]}){condition}"
        else:
            last = values[-1]
            value = _json(last) if len(values) == 1 else f"concat({_json(f'cast({values[0]} as string)')}, ':', {_json(last)})"
            value = f"case when {last} is not null then {value} end" if name.endswith("strict") else value
            ends = "{}" if len(values) == 2 else "[]"
            new = f"concat('{ends[0]}', {_listed(value, chr(39) + ',' + chr(39), order, condition)}, '{ends[1]}')"
        out += [text[at : m.start()], new]
        at = end
    return "".join(out) + text[at:]


def to_spark(sql: str) -> str:
    """The statement in Spark's spelling.

    Covered: FETCH FIRST n ROWS ONLY, ~ and its variants, ORDER BY inside string_agg, array_agg, xmlagg
    and the aggregates of JSON (with FILTER), = ANY (array),
    -> and ->> on JSON text, IS [NOT] DISTINCT FROM with parameters as it is, :: casts as they
    are. FOR UPDATE and FOR SHARE are refused (there are no row locks).
    """
    text, held = hidden(sql)
    if re.search(r"(?i)\bfor\s+(no\s+key\s+)?(update|share|key\s+share)\b", text):
        raise FeatureNotSupported("row locks (FOR UPDATE, FOR SHARE)")
    if re.search(r"(?i)\bfetch\s+(first|next)\b.*\bwith\s+ties\b", text):
        raise FeatureNotSupported("FETCH WITH TIES in text; use functions.pg.with_ties")
    text = re.sub(r"(?i)\bfetch\s+(?:first|next)\s+(?:(\d+)\s+)?rows?\s+only\b", lambda m: f"limit {m[1] or 1}", text)
    mark = "\x01(\\d+)\x02"
    for sign, by, flag in ((r"!~\*", "not rlike", True), (r"!~", "not rlike", False), (r"~\*", "rlike", True), (r"(?<![!<>=~])~", "rlike", False)):
        def match(m: re.Match, by: str = by, flag: bool = flag) -> str:
            if flag:
                held[int(m[1])] = "'(?i)" + held[int(m[1])][1:]
            return f" {by} \x01{m[1]}\x02"

        text = re.sub(rf"\s*{sign}\s*{mark}", match, text)
    text = re.sub(rf"([\w.]+)\s*->>?\s*{mark}", lambda m: f"get_json_object({m[1]}, '$.{held[int(m[2])][1:-1]}')", text)
    text = re.sub(r"(?i)([\w.]+|\x01\d+\x02)\s*=\s*any\s*\(([^()]+(?:\([^()]*\))?)\)", lambda m: f"array_contains({m[2].strip()}, {m[1]})", text)
    text = _ordered_aggregates(text)
    return shown(text, held)


def postgres(sql: str) -> str:
    """The statement in Spark's spelling and with PostgreSQL's meaning of ORDER BY.

    Besides to_spark(): DISTINCT ON, FETCH WITH TIES, GROUP BY DISTINCT, equalities of row values,
    the default place of nulls, $n for parameters. What is in quotes stays as it is.
    """
    text, held = hidden(sql)
    text = re.sub(r"(?i)\bpublic\.(\w+)\.(\w+)", r"\1.\2", text)
    text = re.sub(r"\$(\d+)", r":p\1", text)
    text, held = hidden(to_spark(shown(rewritten(text), held)))
    return shown(null_order(text), held)


COPY = re.compile(
    r"(?is)^\s*copy\s+(?:(?P<table>[\w.\"]+)\s*(?:\((?P<columns>[^)]*)\))?|\((?P<query>.*)\))\s+(?P<way>from|to)\s+(?P<place>stdin|stdout|program|'[^']*')\s*(?:with)?\s*(?:\((?P<options>.*)\))?\s*;?\s*$"
)


def parse_copy(sql: str) -> dict:
    """table or query, columns, incoming, place (a path or None for the stream), options of COPY."""
    m = COPY.match(sql)
    if not m:
        raise ValueError("42601: not a COPY statement")
    if m["place"].lower() == "program":
        raise FeatureNotSupported("COPY PROGRAM")
    if m["query"] and m["way"].lower() == "from":
        raise ValueError("42601: COPY FROM takes a table")
    options = []
    for part in re.findall(r"(\w+)(?:\s+('(?:''|[^'])*'|[\w.-]+))?\s*(?:,|$)", m["options"] or ""):
        value = part[1]
        options.append((part[0].lower(), value[1:-1].replace("''", "'") if value.startswith("'") else value or "true"))
    place = m["place"]
    columns = [c.strip().strip('"') if c.strip().startswith('"') else c.strip().lower() for c in (m["columns"] or "").split(",") if c.strip()]
    return {"table": m["table"], "query": m["query"], "columns": columns, "incoming": m["way"].lower() == "from", "place": place[1:-1] if place.startswith("'") else None, "options": options}
