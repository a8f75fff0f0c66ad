"""Data functions over SQL text, command tags, error codes and connection strings."""

from __future__ import annotations

import hashlib
import re
import struct
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_sql(sql: Column | str) -> Column:
    """A label that groups like statements: comments dropped, literals `?`, white space squeezed.

    Comments go before strings, so a comment mark inside a string ends it; of labels beyond 300
    bytes the whole characters in the first 300 stay, and an ellipsis follows.
    """
    c = _col(sql)
    for pattern, by in ((r"(?s)/\*.*?\*/", " "), (r"--[^\n]*", " "), (r"'(?:''|[^'])*'", "?"), (r"\b\d+(?:\.\d+)?\b", "?"), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, by)
    c = F.trim(c)
    # a character that the cut halves becomes replacement signs, which go
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, 300).cast("string")), "\ufffd+$", "")
    return F.when(c == "", F.lit("<empty query>")).when(F.octet_length(c) > 300, F.concat(head, F.lit("…"))).otherwise(c)


def fingerprint(label: Column | str) -> Column:
    """The first 16 hex digits of the label's SHA-256."""
    return F.substring(F.sha2(_col(label), 256), 1, 16)


def statement(label: Column | str) -> Column:
    """The first word in capitals, UNKNOWN without one."""
    word = F.regexp_extract(_col(label), r"^\s*(\S+)", 1)
    return F.when(word == "", "UNKNOWN").otherwise(F.upper(word))


def first_keyword(sql: Column | str) -> Column:
    """The first word behind leading white space and comments, in capitals."""
    return F.upper(F.regexp_extract(_col(sql), r"(?s)^(?:\s+|--[^\n]*(?:\n|$)|/\*.*?\*/)*([A-Za-z_]+)", 1))


def sqlstate_category(code: Column | str) -> Column:
    """The class of a PostgreSQL error code."""
    head = F.substring(_col(code), 1, 2)
    return F.when(head == "08", "transport").when(head.isin("22", "23"), "data_error").when(head.isin("25", "40"), "transaction_error").when(head == "42", "sql_error").when(head == "53", "resource_exhausted").otherwise("postgres_error")


def row_count_tag(tag: Column | str) -> Column:
    """struct(command, rows) of tags such as INSERT 0 3; rows null where the tag counts none."""
    c = _col(tag)
    has = c.rlike(r"^(INSERT 0|UPDATE|DELETE|COPY|SELECT|MERGE) \d+$")
    return F.when(has, F.struct(F.regexp_extract(c, r"^(.*) \d+$", 1).alias("command"), F.regexp_extract(c, r"(\d+)$", 1).cast("long").alias("rows"))).otherwise(F.struct(c.alias("command"), F.lit(None).cast("long").alias("rows")))


def merged_tag(tags: list[str]) -> str:
    """One tag for the shards' tags: counts are summed, unlike commands give FANOUT."""
    if not tags:
        return ""
    parts = [re.fullmatch(r"(INSERT 0|UPDATE|DELETE|COPY|SELECT|MERGE) (\d+)", t) for t in tags]
    if all(parts) and len({p[1] for p in parts}) == 1:
        return f"{parts[0][1]} {sum(int(p[2]) for p in parts)}"
    return tags[0] if len(set(tags)) == 1 else "FANOUT"


def statement_name(sql: str, oids: list[int], prefix: str = "stmt_") -> str:
    """A stable name of a prepared statement: prefix and 24 hex digits of text and type ids."""
    return prefix + hashlib.sha256(sql.encode() + b"".join(struct.pack(">I", o) for o in oids)).hexdigest()[:24]


def stable_shard_id(name: Column | str, prefix: str = "shard") -> Column:
    """A stable id of a shard's name: 10 bytes of a hash, in hex."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat(F.lit(prefix), F.lit("\0"), _col(name)), 256), 1, 20))


def redacted_dsn(dsn: str) -> tuple[str, str]:
    """Host and path of a connection string, without its secrets, and a hash of the whole."""
    try:
        parts = urlsplit(dsn)
        host = parts.netloc.rpartition("@")[2]
    except ValueError:
        host = ""
    shown = host + parts.path.removesuffix("/") if host else "configured-endpoint"
    return shown, "sha256:" + hashlib.sha256(dsn.encode()).hexdigest()
