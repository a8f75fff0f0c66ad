"""COPY: options, and the text, CSV and binary formats of PostgreSQL, both ways."""

from __future__ import annotations

import codecs
import datetime
import decimal
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import AnyStr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import Registry, table_name

MAX_ROW = 16 << 20
CHUNK, BATCH = 1 << 20, 2 << 20  # bytes of a file that reach a decoder at once; characters that it gives back at once
SIGNATURE = b"PGCOPY\n\xff\r\n\0"
# Option words for booleans, key types of the binary format, text escapes.
YES, NO = ("true", "on", "1", ""), ("false", "off", "0")
BINARY_KEYS = ("int2", "smallint", "int4", "int", "integer", "int8", "bigint", "oid", "float4", "real", "float8", "double precision", "bool", "boolean", "uuid", "text", "varchar", "character varying", "name", "bpchar", "char", "character", "smallserial", "serial", "bigserial")
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


class CopyError(ValueError):
    """A COPY statement or its data are not valid; code is the SQLSTATE."""

    def __init__(self, message: str, code: str = "22023") -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class CopyPlan:
    table: str
    columns: tuple[str, ...]
    incoming: bool
    format: str = "text"
    delimiter: str = "\t"
    null: str = "\\N"
    header: bool = False
    match: bool = False
    quote: str = '"'
    escape: str = '"'
    encoding: str = "UTF8"
    unsupported: tuple[str, ...] = field(default=())


def plan_copy(table: str, columns: list[str], incoming: bool, options: list[tuple[str, str]], registry: Registry | None = None) -> CopyPlan:
    """Check the options of COPY and fill in their defaults.

    For rows that come into a sharded table the columns are listed, hold the whole key once, and
    nothing is set that would change how rows are routed.
    """
    given: dict[str, str] = {}
    for name, value in options:
        if name.lower() in given:
            raise CopyError(f"COPY option {name.lower()} is given twice", "42601")
        given[name.lower()] = value
    form = given.get("format", "text").lower()
    if form not in ("text", "csv", "binary"):
        raise CopyError(f"COPY format {form!r} is not known")
    for name in ("delimiter", "quote", "escape"):
        if name in given and len(given[name].encode()) != 1:
            raise CopyError(f"COPY {name.upper()} is one single-byte character")
    only = {"quote": "csv", "escape": "csv"}
    for name in given:
        if form == "binary" and name in ("delimiter", "null", "header", "quote", "escape"):
            raise CopyError(f"COPY {name.upper()} does not go with the binary format", "42601")
        if only.get(name, form) != form:
            raise CopyError(f"COPY {name.upper()} goes with CSV only", "0A000")
    head = given.get("header", "false").lower()
    if head not in (*YES, *NO, "match"):
        raise CopyError("COPY HEADER is a boolean or MATCH")
    quote = given.get("quote", '"')
    plan = CopyPlan(
        table_name(table), tuple(columns), incoming, form, given.get("delimiter", "," if form == "csv" else "\t"), given.get("null", "" if form == "csv" else "\\N"),
        head in YES or head == "match", head == "match", quote, given.get("escape", quote), given.get("encoding", "UTF8").upper().replace("-", ""),
        tuple(n for n in given if n not in ("format", "delimiter", "null", "header", "quote", "escape", "encoding")),
    )
    if plan.delimiter in "\n\r\0":
        raise CopyError("COPY DELIMITER is not a line end or NUL")
    if form == "csv" and plan.delimiter in (plan.quote, plan.escape):
        raise CopyError("COPY DELIMITER differs from QUOTE and ESCAPE")
    spec = registry.sharded(table) if registry else None
    if not incoming or spec is None:
        return plan
    if plan.encoding != "UTF8":
        raise CopyError("COPY into a sharded table takes UTF8 only", "0A000")
    if plan.unsupported:
        raise CopyError(f"COPY into a sharded table does not take {', '.join(plan.unsupported).upper()}", "0A000")
    if not columns:
        raise CopyError("COPY into a sharded table lists its columns", "0A000")
    if len(set(columns)) != len(columns):
        raise CopyError("COPY lists a column twice", "42701")
    if missing := [k for k in spec.key if k not in columns]:
        raise CopyError(f"COPY lacks shard-key column {missing[0]!r}" + ("; give its fleet-wide value" if spec.generated else ""), "0A000")
    if form == "binary" and any(t.partition("(")[0].strip() not in BINARY_KEYS for t in spec.types):
        raise CopyError("the binary format does not decode this key type", "0A000")
    return plan


def length(row: list) -> int:
    """Of a row's fields together, within the limit; on every path."""
    n = sum(len(x) for x in row if x is not None)
    if n > MAX_ROW:
        raise CopyError("COPY row is too long", "54000")
    return n


def checked(row: list) -> list:
    """A row within the limit."""
    length(row)
    return row


def _more(parts: Iterator[AnyStr], held: AnyStr) -> tuple[AnyStr, bool]:
    """held and what follows it, and whether that was the last; a long record doubles it, so that it is not read over and over."""
    if len(held) > 4 * MAX_ROW + CHUNK:  # the longest spelling of a row: four characters for one
        raise CopyError("COPY row is too long", "54000")
    got, size = [held], 0
    for part in parts:
        got.append(part)
        size += len(part)
        if size >= max(len(held), 1):
            return held[:0].join(got), False
    return held[:0].join(got), True


# --- text -----------------------------------------------------------------------------------


def decode_text(field_: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] == "x" and len(c) > 1:
            return chr(int(c[1:], 16))
        if c[0] in "01234567":
            return chr(int(c, 8) & 255)
        return ESCAPES.get(c, c)

    if "\\" not in field_:
        return field_
    if field_.endswith("\\") and (len(field_) - len(field_.rstrip("\\"))) % 2:
        raise CopyError("COPY text ends in an escape character", "22P04")
    return re.sub(r"\\(x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|.)", one, field_, flags=re.S)


def encode_text(value: str, delimiter: str) -> str:
    out = value.replace("\\", "\\\\")
    for letter, c in ESCAPES.items():
        out = out.replace(c, "\\" + letter)
    return out if delimiter in "".join(ESCAPES.values()) else out.replace(delimiter, "\\" + delimiter)


def split_text(line: str, plan: CopyPlan) -> list[str | None]:
    if "\\" not in line:
        return [None if f == plan.null else f for f in line.split(plan.delimiter)]
    out, now, i = [], [], 0
    while i < len(line):
        c = line[i]
        if c == "\\" and i + 1 < len(line):
            now.append(line[i : i + 2])
            i += 2
            continue
        if c == plan.delimiter:
            out.append("".join(now))
            now = []
        else:
            now.append(c)
        i += 1
    out.append("".join(now))
    return [None if f == plan.null else decode_text(f) for f in out]


def _lines(parts: Iterator[str]) -> Iterator[str]:
    held, last = "", False
    while not last:
        held, last = _more(parts, held)
        *whole, held = held.split("\n")
        yield from whole
    if held:
        yield held


def text_records(data: str | Iterable[str]) -> Iterator[str]:
    """Lines up to the end marker; an escaped line end stays inside its record.

    Of the parts of a file, the last line may have a line end.
    """
    held = ""
    for line in (data.split("\n") if data else []) if isinstance(data, str) else _lines(iter(data)):
        record = held + line
        if (len(record) - len(record.rstrip("\\"))) % 2 and record:
            held = record + "\n"
            if len(held) > 4 * MAX_ROW + CHUNK:
                raise CopyError("COPY row is too long", "54000")
            continue
        held = ""
        if record == "\\.":
            return
        yield record
    if held:
        raise CopyError("COPY text ends inside a record", "22P04")


# --- CSV ------------------------------------------------------------------------------------


def csv_records(data: str | Iterable[str], plan: CopyPlan) -> Iterator[list[str | None]]:
    """Rows of fields; only an unquoted field can be null, quotes may hold line ends.

    data: a file's text or its parts in order, of which no more is held than a record needs.
    """
    parts = iter([data] if isinstance(data, str) else data)
    record = _csv_record(plan)
    held, last = "", False
    while not last:
        held, last = _more(parts, held)
        if plan.quote not in held and "\r" not in held:
            whole, line_end, held = (held.removesuffix("\n"), held, "") if last else held.rpartition("\n")
            for line in whole.split("\n") if line_end else []:
                row: list[str | None] | None = [None if f == plan.null else f for f in line.split(plan.delimiter)]
                if row == ["\\."]:
                    return
                yield row
            continue
        at = 0
        while at < len(held):
            row, end = record(held, at, last)
            if row is None:
                break
            if row == ["\\."]:
                return
            yield row
            at = end
        held = held[at:]


def _csv_record(plan: CopyPlan):
    """A function of (text, start, whether it is the last text): a row and its end; no row if the text ends before its line end."""
    q, e, d = plan.quote, plan.escape, plan.delimiter
    q_, e_, d_ = re.escape(q), re.escape(e), re.escape(d)
    inner = f"(?:[^{q_}]++|{q_}{q_})*+" if e == q else f"(?:[^{q_}{e_}]++|{e_}[{q_}{e_}]|{e_}(?![{q_}{e_}]))*+"
    quoted, plain, escaped = re.compile(f"{q_}({inner}){q_}"), re.compile(f"[^{d_}{q_}\n\r]*+"), re.compile(f"{e_}([{q_}{e_}])")

    def record(text: str, i: int, last: bool) -> tuple[list[str | None] | None, int]:
        row: list[str | None] = []
        n = len(text)
        while True:
            if text.startswith(q, i):
                m = quoted.match(text, i)
                if m is None:
                    if last:
                        raise CopyError("CSV ends inside quotes", "22P04")
                    return None, i
                row.append(escaped.sub(r"\1", m[1]))
                i = m.end()
                if i < n and text[i] not in (d, "\n", "\r"):
                    raise CopyError("CSV has data after a closing quote", "22P04")
            else:
                m = plain.match(text, i)
                i = m.end()
                if text.startswith(q, i):
                    raise CopyError("CSV has a quote inside an unquoted field", "22P04")
                row.append(None if m[0] == plan.null else m[0])
            if text.startswith(d, i):
                i += 1
                continue
            if not last and (i == n or text[i] == "\r" and i + 1 == n):  # the rest of the field or line end may follow
                return None, i
            return row, min(n, i + (2 if text.startswith("\r\n", i) else 1))

    return record


def encode_csv(value: str | None, plan: CopyPlan) -> str:
    if value is None:
        return plan.null
    if value == plan.null or any(c in value for c in (plan.delimiter, plan.quote, "\n", "\r")) or value == "\\.":
        inner = value.replace(plan.escape, plan.escape * 2) if plan.escape != plan.quote else value
        return plan.quote + inner.replace(plan.quote, plan.escape + plan.quote) + plan.quote
    return value


# --- binary ---------------------------------------------------------------------------------


def binary_records(data: bytes | Iterable[bytes], columns: int) -> Iterator[list[bytes | None]]:
    """Rows of a file, or of its parts in order."""
    parts = iter([data] if isinstance(data, bytes) else data)
    held, at, last = b"", 0, False

    def has(n: int) -> bool:
        nonlocal held, at, last
        while len(held) - at < n and not last:
            held, last = _more(parts, held[at:])
            at = 0
        return len(held) - at >= n

    if not has(19) or held[:11] != SIGNATURE:
        raise CopyError("not a binary COPY stream", "22P04")
    extension = struct.unpack_from(">i", held, 15)[0]
    at += 19
    while True:
        if extension:  # bytes to pass over
            if extension < 0 or not has(1):
                raise CopyError("binary COPY ends without its trailer", "22P04")
            passed = min(extension, len(held) - at)
            at, extension = at + passed, extension - passed
            continue
        if not has(2):
            raise CopyError("binary COPY ends without its trailer", "22P04")
        n = struct.unpack_from(">h", held, at)[0]
        at += 2
        if n == -1:
            if has(1):
                raise CopyError("binary COPY goes on behind its trailer", "22P04")
            return
        if n != columns:
            raise CopyError(f"binary COPY row has {n} columns, expected {columns}", "22P04")
        row: list[bytes | None] = []
        for _ in range(n):
            if not has(4):
                raise CopyError("binary COPY ends inside a row", "22P04")
            size = struct.unpack_from(">i", held, at)[0]
            at += 4
            if size < -1 or size > MAX_ROW or not has(max(size, 0)):
                raise CopyError("binary COPY field is too long", "22P04")
            row.append(None if size == -1 else held[at : at + size])
            at += max(size, 0)
        checked(row)
        yield row


_NUMBERS = {"smallint": ">h", "int": ">i", "bigint": ">q", "float": ">f", "double": ">d"}
# Dates and instants count from the start of 2000; numerics are digits to the base 10,000.
DAY_ZERO, INSTANT_ZERO, BASE = datetime.date(2000, 1, 1), datetime.datetime(2000, 1, 1), 10_000
NEGATIVE, NOT_A_NUMBER = 0x4000, 0xC000


def numeric_to_binary(value: decimal.Decimal) -> bytes:
    """Count, weight, sign, scale, then the digits: weight is the power of the base that the first has."""
    sign, digits, exponent = value.as_tuple()
    scale = max(0, -exponent)
    whole = int("".join(map(str, digits)) or "0") * 10 ** max(0, exponent) * 10 ** (-scale % 4)
    groups, behind = [], (scale + 3) // 4
    while whole:
        whole, group = divmod(whole, BASE)
        groups.append(group)
    weight = len(groups) - 1 - behind
    groups.reverse()
    while groups and not groups[-1]:
        groups.pop()
    return struct.pack(">hhHH", len(groups), weight if groups else 0, NEGATIVE if sign and groups else 0, scale) + struct.pack(f">{len(groups)}h", *groups)


def numeric_from_binary(data: bytes) -> decimal.Decimal | None:
    """The value; null for NaN, which no decimal column can hold."""
    if len(data) < 8:
        raise CopyError(f"{len(data)} bytes are no numeric", "22P03")
    n, weight, sign, scale = struct.unpack_from(">hhHH", data)
    if len(data) != 8 + 2 * n or sign not in (0, NEGATIVE, NOT_A_NUMBER):
        raise CopyError("the bytes are no numeric", "22P03")
    if sign == NOT_A_NUMBER:
        return None
    whole = 0
    for group in struct.unpack_from(f">{n}h", data, 8):
        whole = whole * BASE + group
    with decimal.localcontext(decimal.Context(prec=max(50, 4 * n + scale + 8), Emax=10**6, Emin=-(10**6))):
        value = decimal.Decimal(whole).scaleb(4 * (weight - n + 1))
        return (-value if sign else value).quantize(decimal.Decimal(1).scaleb(-scale))


def binary_value(value: object, kind: T.DataType) -> bytes | None:
    if value is None:
        return None
    name = kind.simpleString()
    if name in _NUMBERS:
        return struct.pack(_NUMBERS[name], value)
    if name == "boolean":
        return b"\1" if value else b"\0"
    if name == "binary":
        return bytes(value)
    if name == "string":
        return value.encode()
    if name == "date":
        return struct.pack(">i", (value - DAY_ZERO).days)
    if name in ("timestamp", "timestamp_ntz"):  # the session's time zone is UTC
        if value.tzinfo is not None:
            value = value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
        return struct.pack(">q", (value - INSTANT_ZERO) // datetime.timedelta(microseconds=1))
    if name.startswith("decimal"):
        return numeric_to_binary(value)
    raise CopyError(f"the binary format does not encode {name}", "0A000")


def from_binary(value: bytes | None, kind: T.DataType) -> object:
    if value is None:
        return None
    name = kind.simpleString()
    fixed = {"date": ">i", "timestamp": ">q", "timestamp_ntz": ">q"} | _NUMBERS
    if name in fixed and len(value) != struct.calcsize(fixed[name]):
        raise CopyError(f"{len(value)} bytes are no {name}", "22P03")
    if name in _NUMBERS:
        return struct.unpack(_NUMBERS[name], value)[0]
    if name == "boolean":
        return value != b"\0"
    if name == "string":
        return value.decode()
    if name == "binary":
        return value
    if name == "date":
        return DAY_ZERO + datetime.timedelta(days=struct.unpack(">i", value)[0])
    if name in ("timestamp", "timestamp_ntz"):
        return INSTANT_ZERO + datetime.timedelta(microseconds=struct.unpack(">q", value)[0])
    if name.startswith("decimal"):
        return numeric_from_binary(value)
    raise CopyError(f"the binary format does not decode {name}", "0A000")


# --- DataFrames -----------------------------------------------------------------------------


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about 4 MB, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's default: 64 MB, which both sides of a worker hold
        spark.conf.set(key, "4m")


def decoded(files: DataFrame, plan: CopyPlan, schema: T.StructType) -> DataFrame:
    """Rows of COPY files (one a row of files, in its only column) in the types of schema; a batch or a stream.

    Spark hands a file on in pieces of CHUNK bytes, and rows leave in batches of about BATCH
    characters: what Python holds does not grow with the file.
    """
    small_batches(files.sparkSession)
    kinds = [schema[c].dataType for c in plan.columns]
    n, binary = len(kinds), plan.format == "binary"
    whole = files.select(F.col(files.columns[0]).cast("binary").alias("content"))
    pieces = whole.selectExpr("content", f"explode(sequence(0, greatest(length(content) - 1, 0) div {CHUNK})) as at").selectExpr("at", f"substring(content, cast(at * {CHUNK} + 1 as int), {CHUNK}) as piece")

    def by_file(parts: Iterator[pd.DataFrame]) -> Iterator[Iterator[bytes]]:
        file = 0

        def numbered() -> Iterator[tuple[int, bytes]]:
            nonlocal file
            for part in parts:
                for at, piece in zip(part["at"], part["piece"], strict=True):
                    file += at == 0
                    yield file, bytes(piece)

        for _, pieces_ in groupby(numbered(), lambda x: x[0]):
            yield (piece for _, piece in pieces_)

    def rows(file: Iterator[bytes]) -> Iterator[list]:
        if binary:
            return binary_records(file, n)
        found = csv_records(_texts(file), plan) if plan.format == "csv" else (split_text(x, plan) for x in text_records(_texts(file)))
        if plan.header:
            first = next(found, None)
            if plan.match and first is not None and tuple(first) != plan.columns:
                raise CopyError("COPY header does not match the columns", "22P04")
        return found

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file in by_file(parts):
            for some in _batches(rows(file), n):
                if binary:
                    some = [[from_binary(v, k) for v, k in zip(r, kinds, strict=True)] for r in some]
                    yield pd.DataFrame({c: pd.Series([r[i] for r in some], dtype=object) for i, c in enumerate(plan.columns)})
                else:
                    yield pd.DataFrame(some, columns=[f"c{i}" for i in range(n)], dtype=object)

    if binary:
        return pieces.mapInPandas(decode, T.StructType([T.StructField(c, k) for c, k in zip(plan.columns, kinds, strict=True)]))
    return _typed(pieces.mapInPandas(decode, ", ".join(f"c{i} string" for i in range(n))), plan, kinds)


def _texts(file: Iterable[bytes]) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        for piece in file:
            yield decoder.decode(piece)
        decoder.decode(b"", True)
    except UnicodeDecodeError as e:
        raise CopyError("COPY data are not UTF8", "22021") from e


def _batches(rows: Iterable[list], n: int) -> Iterator[list[list]]:
    """Rows of n fields, 5,000 or about BATCH characters at a time."""
    held, size = [], 0
    for r in rows:
        if len(r) != n:
            raise CopyError(f"COPY row has {len(r)} columns, expected {n}", "22P04")
        held.append(r)
        size += length(r)
        if len(held) == 5_000 or size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _typed(raw: DataFrame, plan: CopyPlan, kinds: list[T.DataType]) -> DataFrame:
    return raw.select(*[F.col(f"c{i}").cast(k).alias(c) for i, (c, k) in enumerate(zip(plan.columns, kinds, strict=True))])


def copy_in(spark: SparkSession, paths: str | list[str], plan: CopyPlan, schema: T.StructType) -> DataFrame:
    """Rows of COPY files in the types of schema (fields by plan.columns).

    Text splits by line and scales with the file, but for files with an end marker or a line end
    inside a record; these, CSV and binary records may span lines, so each such file is decoded by
    one task, piece by piece (see decoded; Spark's reader holds the file, of 2 GB at most: write
    many files, as copy_out does).
    """
    if plan.format == "binary":
        return decoded(spark.read.format("binaryFile").load(paths).select("content"), plan, schema)
    if plan.format == "csv" or plan.header:
        return decoded(spark.read.text(paths, wholetext=True), plan, schema)
    small_batches(spark)
    kinds = [schema[c].dataType for c in plan.columns]
    n = len(kinds)

    def by_line(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _batches((split_text(x, plan) for part in parts for x in part["value"]), n):
            yield pd.DataFrame(some, columns=[f"c{i}" for i in range(n)], dtype=object)

    lines = spark.read.text(paths, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"))
    # an end marker, or a line end inside a record: such files are read whole, by the same decoder
    odd = (F.col("value") == "\\.") | F.col("value").rlike(r"(?s)(?:^|[^\\])(?:\\\\)*\\$")
    apart = [r["file"] for r in lines.where(odd).select("file").distinct().collect()]  # a name a file
    plain = (lines.where(~F.col("file").isin(apart)) if apart else lines).select("value")
    out = _typed(plain.mapInPandas(by_line, ", ".join(f"c{i} string" for i in range(n))), plan, kinds)
    return out.union(decoded(spark.read.text(apart, wholetext=True), plan, schema)) if apart else out


def text_cell(value: Column, plan: CopyPlan) -> Column:
    """encode_text() of a column."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for letter, c in ESCAPES.items():
        out = F.replace(out, F.lit(c), F.lit("\\" + letter))
    if plan.delimiter not in ESCAPES.values():
        out = F.replace(out, F.lit(plan.delimiter), F.lit("\\" + plan.delimiter))
    return F.coalesce(out, F.lit(plan.null))


def csv_cell(value: Column, plan: CopyPlan) -> Column:
    """encode_csv() of a column."""
    inner = F.replace(value, F.lit(plan.escape), F.lit(plan.escape * 2)) if plan.escape != plan.quote else value
    quoted = F.concat(F.lit(plan.quote), F.replace(inner, F.lit(plan.quote), F.lit(plan.escape + plan.quote)), F.lit(plan.quote))
    special = (value == plan.null) | (value == "\\.")
    for c in (plan.delimiter, plan.quote, "\n", "\r"):
        special = special | value.contains(c)
    return F.when(value.isNull(), F.lit(plan.null)).when(special, quoted).otherwise(value)


def copy_out(df: DataFrame, path: str, plan: CopyPlan, *order: str) -> int:
    """Write COPY files, one a partition in the given order; returns the rows, counted as they are written.

    Each file is a whole stream: header line or binary envelope once a file.
    """
    columns = list(plan.columns or df.columns)
    df = df.select(*columns)
    kinds = [f.dataType for f in df.schema.fields]
    if plan.format == "binary":
        from ._binary_sink import write_binary

        return write_binary(df, path, kinds)
    text = plan.format == "text"
    cells = [text_cell(F.col(f"`{c}`").cast("string"), plan) if text else csv_cell(F.col(f"`{c}`").cast("string"), plan) for c in columns]
    seen = Observation()
    lines = (df.orderBy(*order) if order else df).observe(seen, F.count(F.lit(1)).alias("n")).select(F.concat_ws(plan.delimiter, *cells).alias("value"))
    if plan.header:
        head = plan.delimiter.join(encode_text(c, plan.delimiter) if text else encode_csv(c, plan) for c in columns)

        def headed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pydict({"value": [head]})
            for part in parts:
                yield pa.RecordBatch.from_arrays([part.column(0)], ["value"])  # the same field, nullable

        small_batches(df.sparkSession)
        lines = lines.mapInArrow(headed, "value string")
    lines.write.option("lineSep", "\n").text(path)
    return seen.get["n"]

