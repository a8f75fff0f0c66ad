"""PostgreSQL clauses that Spark's parser lacks, written as queries that it has.

All functions take and give text in which quoted parts are hidden (see dialect.hidden).
"""

from __future__ import annotations

import re
from itertools import product

from ..operators.ddl import FeatureNotSupported

# What ends a list of ORDER BY at its own depth.
ENDS = re.compile(r"(?:limit|offset|fetch|union|intersect|except|minus|for|window)\b|(?:rows|range|groups)\s+(?:between\b|unbounded\b|current\b|\d|\x01|:)", re.I)
CLAUSE = re.compile(r"(?:from|where|having|window|limit|offset|fetch|union|intersect|except|minus)\b|(?:group|order)\s+by\b", re.I)
WORD = re.compile(r"\w+")


def closing(text: str, at: int) -> int:
    """The end of the parenthesis that opens at at."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return i
    raise ValueError("42601: a parenthesis is not closed")


def split(text: str) -> list[str]:
    """The parts between commas that no parenthesis holds."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def _until(text: str, at: int, ends: re.Pattern) -> int:
    """The first place from at on where a word fits ends, or a parenthesis or statement closes."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            if not depth:
                return i
            depth -= 1
        elif c == ";" and not depth:
            return i
        elif (m := WORD.match(text, i)) and (i == 0 or not re.match(r"[\w.]", text[i - 1])):
            if not depth and ends.match(text, i):
                return i
            i = m.end()
            continue
        i += 1
    return i


def ordered_item(item: str) -> tuple[str, str]:
    """An ORDER BY item's expression and its direction with PostgreSQL's place of nulls."""
    m = re.match(r"(?is)^(.*?)(\s+(?:asc|desc))?(\s+nulls\s+(?:first|last))?$", item.strip())
    way = (m[2] or "").strip().lower() or "asc"
    return m[1].strip(), f"{way} {(m[3] or '').strip().lower() or ('nulls first' if way == 'desc' else 'nulls last')}"


def null_order(text: str) -> str:
    """ORDER BY with nulls last ascending and first descending, where the text does not say."""
    out, at = [], 0
    for m in re.finditer(r"(?i)\border\s+by\s+", text):
        if m.start() < at:  # inside an item that was done already
            continue
        end = _until(text, m.end(), ENDS)
        body = text[m.end() : end]
        tail = body[len(body.rstrip()) :]
        items = []
        for item in split(body):
            if item.lower() == "all" or not item:
                items.append(item)
                continue
            expression, way = ordered_item(item)
            items.append(f"{null_order(expression)} {way}")
        out += [text[at : m.end()], ", ".join(items), tail]
        at = end
    return "".join(out) + text[at:]


def _block(text: str, at: int) -> tuple[dict[str, tuple[int, int, int]], int]:
    """The clauses (name: start, start and end of the body) of the SELECT whose list starts at at, and its end."""
    marks, i = [("list", at, at)], at
    while True:
        i = _until(text, i, CLAUSE)
        m = CLAUSE.match(text, i)
        if i >= len(text) or not m:
            break
        name = re.sub(r"\s+", " ", m[0].lower())
        if name in ("union", "intersect", "except", "minus"):
            if name != "except" or not re.match(r"(?i)\s*\((?!\s*select\b)", text[m.end() :]):  # not "* except (columns)"
                break
        elif not (name == "from" and re.search(r"(?i)\bdistinct\s+$", text[:i])):
            marks.append((name, i, m.end()))
        i = m.end()
    found = {name: (start, body, nxt) for (name, start, body), nxt in zip(marks, [s for _, s, _ in marks[1:]] + [i], strict=True)}
    return found, i


def _named(items: list[str]) -> dict[str, str]:
    """Expressions of a select list by alias and by place."""
    out = {}
    for k, item in enumerate(items, 1):
        m = re.match(r"(?is)^(.*?)\s+as\s+([\w\x01\x02]+)$", item)
        out[str(k)] = m[1] if m else item
        if m:
            out[m[2].lower()] = m[1]
    return out


def _order(text: str, clauses: dict, items: list[str]) -> list[tuple[str, str]]:
    if "order by" not in clauses:
        return []
    _, a, b = clauses["order by"]
    names = _named(items)
    return [(names.get(e.lower(), e), way) for e, way in map(ordered_item, split(text[a:b]))]


def _rest(text: str, clauses: dict, end: int) -> str:
    """From FROM on, without order and limits."""
    if "from" not in clauses:
        return ""
    return text[clauses["from"][0] : min([end, *[clauses[c][0] for c in ("order by", "limit", "offset", "fetch") if c in clauses]])]


def distinct_on(text: str) -> str:
    """SELECT DISTINCT ON (keys): the first row of each key by ORDER BY, through a row number."""
    m = re.search(r"(?i)\bselect\s+distinct\s+on\s*(?=\()", text)
    if not m:
        return text
    close = closing(text, m.end())
    keys = split(text[m.end() + 1 : close])
    clauses, end = _block(text, close + 1)
    _, a, b = clauses["list"]
    items = split(text[a:b])
    names = _named(items)
    keys = [names.get(k.lower(), k) for k in keys]
    order = _order(text, clauses, items)
    plain = lambda e: re.sub(r"\s+", "", e.lower())
    if order and {plain(e) for e, _ in order[: len(keys)]} != {plain(k) for k in keys}:
        raise ValueError("42P10: SELECT DISTINCT ON expressions must match the first ORDER BY expressions")
    by = ", ".join(f"{e} {way}" for e, way in order) or ", ".join(keys)
    extra = [f"{e} as __o{i}" for i, (e, _) in enumerate(order)]
    hide = ", ".join(["__rn", *[f"__o{i}" for i in range(len(order))]])
    inner = ", ".join([text[a:b].strip(), f"row_number() over (partition by {', '.join(keys)} order by {by}) as __rn", *extra])
    tail = " ".join(text[clauses[c][0] : clauses[c][2]].strip() for c in ("limit", "offset", "fetch") if c in clauses)
    last = " order by " + ", ".join(f"__o{i} {way}" for i, (_, way) in enumerate(order)) if order else ""
    new = f"select * except ({hide}) from (select {inner} {_rest(text, clauses, end)}) where __rn = 1{last} {tail} "
    return distinct_on(text[: m.start()] + new + text[end:])


def with_ties(text: str) -> str:
    """FETCH FIRST n ROWS WITH TIES through ranks, whose map side keeps n rows and their ties."""
    ties = re.search(r"(?i)\bfetch\s+(?:first|next)\s+(?:(\d+)\s+)?rows?\s+with\s+ties\b", text)
    if not ties:
        return text
    for m in reversed(list(re.finditer(r"(?i)\bselect\b", text[: ties.start()]))):
        clauses, end = _block(text, m.end())
        if "fetch" in clauses and clauses["fetch"][0] == ties.start():
            break
    else:
        raise FeatureNotSupported("FETCH WITH TIES of this statement")
    before = text[: m.start()].rstrip().lower()
    if "order by" not in clauses:
        raise ValueError("42601: WITH TIES cannot be specified without ORDER BY clause")
    if before.endswith(("union", "all", "intersect", "except", "minus")):
        raise FeatureNotSupported("FETCH WITH TIES over a set operation")
    n, (_, a, b) = int(ties[1] or 1), clauses["list"]
    skip = re.match(r"\s*(\d+)", text[clauses["offset"][1] :]) if "offset" in clauses else None
    skip = int(skip[1]) if skip else 0
    body, items = text[a:b].strip(), split(text[a:b])
    rest = _rest(text, clauses, end)
    if re.match(r"(?i)distinct\b", body):  # order by what the query returns
        order = [ordered_item(x) for x in split(text[slice(*clauses["order by"][1:])])]
        body, rest = "*", f"from (select {body} {rest})"
    else:
        order = _order(text, clauses, items)
    by = ", ".join(f"{e} {way}" for e, way in order)
    extra = [f"rank() over (order by {by}) as __rk", *([f"row_number() over (order by {by}) as __rn"] if skip else []), *[f"{e} as __o{i}" for i, (e, _) in enumerate(order)]]
    hide = ", ".join(x.rpartition(" ")[2] for x in extra)
    last = ", ".join(f"__o{i} {way}" for i, (_, way) in enumerate(order))
    kept = f"__rk <= {n + skip}" + (f" and __rn > {skip}" if skip else "")
    new = f"select * except ({hide}) from (select {', '.join([body, *extra])} {rest}) where {kept} order by {last} "
    return with_ties(text[: m.start()] + new + text[end:])


def grouping_sets(element: str) -> list[tuple[str, ...]]:
    """The sets that one element of GROUP BY stands for."""
    m = re.match(r"(?is)^(rollup|cube|grouping\s+sets)\s*(\(.*\))$", element)
    inside = lambda t: [x for x in split(t[1:-1]) if x]
    group = lambda t: tuple(inside(t)) if t.startswith("(") and closing(t, 0) == len(t) - 1 else (t,)
    if not m:
        return [group(element)]
    parts, kind = inside(m[2]), m[1].lower()
    if kind == "rollup":
        return [sum(map(group, parts[:k]), ()) for k in range(len(parts), -1, -1)]
    if kind == "cube":
        return [sum((group(p) for p, on in zip(parts, pick, strict=True) if on), ()) for pick in product((True, False), repeat=len(parts))]
    return [s for p in parts for s in grouping_sets(p)]


def group_by_distinct(text: str) -> str:
    """GROUP BY DISTINCT: the product of the elements' grouping sets, each set once."""
    m = re.search(r"(?i)\bgroup\s+by\s+(distinct|all)\s+", text)
    if not m:
        return text
    end = _until(text, m.end(), re.compile(rf"{CLAUSE.pattern}|{ENDS.pattern}", re.I))
    sets = [tuple(dict.fromkeys(sum(pick, ()))) for pick in product(*map(grouping_sets, split(text[m.end() : end])))]
    if m[1].lower() == "distinct":
        sets = list({frozenset(re.sub(r"\s+", "", e.lower()) for e in s): s for s in reversed(sets)}.values())[::-1]
    made = ", ".join(f"({', '.join(s)})" for s in sets)
    return group_by_distinct(f"{text[: m.start()]}group by grouping sets ({made}) {text[end:]}")


def tuples(text: str) -> str:
    """Equalities of row values, part by part: Spark compares rows of equal types only."""
    pattern = r"\(([\w.\x01\x02]+(?:\s*,\s*[\w.\x01\x02]+)+)\)\s*=\s*\(([^()]+)\)"

    def pair(m: re.Match) -> str:
        a, b = m[1].split(","), split(m[2])
        return "(" + " and ".join(f"{x.strip()} = {y}" for x, y in zip(a, b, strict=True)) + ")" if len(a) == len(b) else m[0]

    return re.sub(pattern, pair, text)


def rewritten(text: str) -> str:
    """All of the above that change a statement's shape; null_order() comes after them."""
    return tuples(group_by_distinct(with_ties(distinct_on(text))))
