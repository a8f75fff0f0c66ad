"""Schema statements: normal form of generated keys, classes, and what is refused."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Serial types and integer types that an identity column may have.
SERIALS = ("serial", "serial2", "serial4", "serial8", "smallserial", "bigserial")
IDENTITY = "GENERATED BY DEFAULT AS IDENTITY"
#: start of a statement -> why it is refused on all shards
REFUSED = (
    (r"(create|drop)\s+database\b", "databases are not created or dropped in a transaction"),
    (r"(create|drop)\s+tablespace\b", "tablespaces are not created or dropped in a transaction"),
    (r"alter\s+system\b", "server settings are not part of the catalog"),
    (r"create\s+(or\s+replace\s+)?(function|procedure)\b", "user-defined functions and procedures are not supported"),
    (r"(create\s+(unique\s+)?|drop\s+|re)index\s+concurrently\b", "concurrent index changes are not supported"),
    (r"copy\b.*\bprogram\b", "COPY PROGRAM is not supported"),
)
DDL = r"(create|alter|drop|comment|truncate|grant|revoke|reindex|rename|security|reassign|import)\b"
TEMPORARY = r"(create\s+(global\s+|local\s+)?temp(orary)?\b|discard\s+temp\b)"
TRANSACTION = r"(begin|start\s+transaction|commit|end|rollback|abort|savepoint|release|prepare\s+transaction)\b"


class FeatureNotSupported(Exception):
    def __init__(self, reason: str) -> None:
        super().__init__(f"0A000: {reason}")


@dataclass(frozen=True)
class Normalized:
    sql: str
    schema: bool
    changed: bool


def statements(sql: str) -> list[str]:
    """The statements of a batch; semicolons in quotes, comments and dollar quotes do not split."""
    token = re.compile(r"'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|--[^\n]*|/\*.*?\*/|\$(\w*)\$.*?\$\1\$|;|[^;'\"$/-]+|.", re.S)
    out, now = [], []
    for m in token.finditer(sql):
        if m[0] == ";":
            out.append("".join(now).strip())
            now = []
        elif not m[0].startswith(("--", "/*")):
            now.append(m[0])
        else:
            now.append(" ")
    out.append("".join(now).strip())
    return [s for s in out if s]


def _split(body: str) -> list[str]:
    """Comma-separated parts at depth 0."""
    parts, depth, now, quote = [], 0, [], ""
    for c in body:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            parts.append("".join(now))
            now = []
            continue
        now.append(c)
    return [*parts, "".join(now)]


def _column(text: str) -> str:
    """A column definition with its generated key in normal form; others as they are."""
    m = re.match(r"(?is)^(\s*(?:\"(?:\"\"|[^\"])+\"|[a-z_][\w$]*)\s+)((?:pg_catalog\.)?[a-z][\w]*)(.*)$", text)
    if not m or re.match(r"(?i)\s*(constraint|primary|unique|check|foreign|exclude|like)\b", text):
        return text
    head, kind, rest = m[1], m[2].lower().removeprefix("pg_catalog."), m[3]
    if kind in SERIALS:
        return f"{head}BIGINT{rest} {IDENTITY}".replace("  ", " ")
    generated = r"(?i)generated\s+(always|by\s+default)\s+as\s+identity"
    return f"{head}BIGINT{re.sub(generated, IDENTITY, rest)}" if re.search(generated, rest) else text


def normalize_ddl(sql: str) -> Normalized:
    """Serial and identity columns become BIGINT GENERATED BY DEFAULT AS IDENTITY.

    CREATE TABLE, ADD COLUMN, ADD GENERATED and SET GENERATED are covered; typed tables and
    partition options have no column types and stay.
    """
    out, schema = [], False
    for s in statements(sql):
        new = s
        if m := re.match(r"(?is)^(create\s+(?:(?:global|local)\s+)?(?:temp(?:orary)?\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?[\w.\"$]+\s*)\((.*)\)([^()]*)$", s):
            schema = True
            new = f"{m[1]}({','.join(_column(c) for c in _split(m[2]))}){m[3]}"
        elif re.match(r"(?i)(create\s+.*\btable|alter\s+table)\b", s):
            schema = True
            if re.match(r"(?i)alter\s+table\b", s):
                new = re.sub(r"(?is)(\badd\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?)(?!constraint|primary|unique|check|foreign|generated)(.+?)(?=,\s*(?:add|alter|drop)\b|$)", lambda m: m[1] + _column(m[2]), new)
                new = re.sub(r"(?i)\b(add|set)\s+generated\s+always\b", lambda m: f"{m[1]} GENERATED BY DEFAULT", new)
        out.append(new)
    text = "; ".join(out)
    changed = out != statements(sql)
    return Normalized(text if changed else sql, schema, changed)


def classify(sql: str) -> str:
    """query, write, ddl, temporary, transaction, copy or utility; the strongest of a batch."""
    found = set()
    for s in statements(sql):
        s = s.lower()
        if re.match(TEMPORARY, s):
            found.add("temporary")
        elif re.match(DDL, s) or re.match(r"select\b.*\binto\s+(?!strict)\w", s, re.S):
            found.add("ddl")
        elif re.match(r"(insert|update|delete|merge)\b", s) or re.match(r"with\b.*\b(insert\s+into|update|delete\s+from)\b", s, re.S):
            found.add("write")
        elif re.match(TRANSACTION, s):
            found.add("transaction")
        elif re.match(r"copy\b", s):
            found.add("copy")
        elif re.match(r"(select|with|values|table|explain|show)\b", s):
            found.add("query")
        else:
            found.add("utility")
    return next((k for k in ("ddl", "temporary", "write", "copy", "transaction", "utility", "query") if k in found), "query")


def check_ddl(sql: str, *, atomic: bool = True) -> None:
    """Refuse what can't be done on all shards at once."""
    batch = [s.lower() for s in statements(sql)]
    for s in batch:
        for pattern, reason in REFUSED:
            if re.match(pattern, s, re.S):
                raise FeatureNotSupported(reason)
    ddl = [s for s in batch if re.match(DDL, s) and not re.match(TEMPORARY, s)]
    if ddl and any(re.match(TRANSACTION, s) for s in batch):
        raise FeatureNotSupported("transaction control and schema changes do not share a batch")
    if ddl and any(re.match(TEMPORARY, s) for s in batch):
        raise FeatureNotSupported("temporary and durable objects do not share a batch")
    if ddl and not atomic:
        raise FeatureNotSupported("schema changes on all shards need an atomic commit")


def shard_key_comment(sql: str, marker: str = "shard_key") -> tuple[str, str] | None:
    """(table, column) of a COMMENT ON COLUMN that marks a shard key."""
    m = re.match(r"(?is)^\s*comment\s+on\s+column\s+([\w.\"]+)\.([\w\"]+)\s+is\s+'([^']*)'\s*;?\s*$", sql)
    return (m[1].strip('"'), m[2].strip('"')) if m and m[3].endswith(marker) else None


def parse_create(sql: str) -> tuple[str, list[tuple[str, str, bool]]] | None:
    """Table name and (column, type, identity) of a CREATE TABLE with column types."""
    m = re.match(r"(?is)^create\s+(?:unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"$]+)\s*\((.*)\)[^()]*$", sql)
    if not m:
        return None
    columns = []
    for text in _split(m[2]):
        if re.match(r"(?i)\s*(constraint|primary|unique|check|foreign|exclude|like)\b", text):
            continue
        c = re.match(r"(?is)^\s*(\"(?:\"\"|[^\"])+\"|[a-z_][\w$]*)\s+((?:pg_catalog\.)?(?:double\s+precision|character\s+varying|timestamp\s+with(?:out)?\s+time\s+zone|[a-z]\w*)(?:\s*\([^)]*\))?)(.*)$", text)
        if not c:
            raise ValueError(f"42601: not a column definition: {text.strip()!r}")
        name = c[1][1:-1].replace('""', '"') if c[1].startswith('"') else c[1].lower()
        columns.append((name, " ".join(c[2].lower().split()), IDENTITY.lower() in " ".join(c[3].lower().split())))
    return m[1], columns
