"""Canonical text of shard-key values, as a Column and, for literals, in Python.

Equal values of a type have one text: 01 and 1, 1.50 and 1.5, t and true.
"""

from __future__ import annotations

import decimal
import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# PostgreSQL type names by family.
INTEGERS = ("int2", "smallint", "smallserial", "serial2", "int4", "int", "integer", "serial", "serial4", "int8", "bigint", "bigserial", "serial8", "oid")
DECIMALS = ("numeric", "decimal")
FLOATS = ("float4", "real")
DOUBLES = ("float8", "double precision")
BOOLEANS = ("bool", "boolean")
UUIDS = ("uuid",)
TEXTS = ("text", "varchar", "character varying", "name")
PADDED = ("bpchar", "char", "character")
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")

_FAMILY = {name: family for family, names in {"integer": INTEGERS, "decimal": DECIMALS, "float": FLOATS, "double": DOUBLES, "bool": BOOLEANS, "uuid": UUIDS, "text": TEXTS, "padded": PADDED}.items() for name in names}


class UnsupportedShardKeyType(ValueError):
    """Values of this type have no canonical text, so rows are not placed by it."""


def type_family(pg_type: str) -> str:
    """The family of a type name; schema prefix and type modifier are ignored."""
    name = pg_type.strip().lower().removeprefix("pg_catalog.").partition("(")[0].strip()
    if pg_type.rstrip().endswith("]") or name not in _FAMILY:
        raise UnsupportedShardKeyType(pg_type)
    return _FAMILY[name]


def spark_type(pg_type: str) -> T.DataType:
    """The Spark type that stores a column of this PostgreSQL type."""
    name = pg_type.strip().lower().removeprefix("pg_catalog.")
    if m := re.fullmatch(r"(?:numeric|decimal)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", name):
        return T.DecimalType(min(int(m[1] or 38), 38), int(m[2] or (18 if not m[1] else 0)))
    bare = name.partition("(")[0].strip()
    if bare in ("int2", "smallint", "smallserial", "serial2"):
        return T.ShortType()
    if bare in ("int4", "int", "integer", "serial", "serial4"):
        return T.IntegerType()
    other = {"timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(), "timestamp without time zone": T.TimestampNTZType(), "date": T.DateType(), "bytea": T.BinaryType(), "json": T.StringType(), "jsonb": T.StringType()}
    if bare in other:
        return other[bare]
    return {"integer": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType()}.get(type_family(name), T.StringType())


def decimal_text(value: str) -> str | None:
    """Digits without superfluous zeros or exponent; null if it is no number."""
    value = value.strip()
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value, re.ASCII):
        return None
    exact = decimal.Context(prec=max(50, 2 * len(value)), Emax=10**9, Emin=-(10**9))
    text = format(exact.normalize(exact.create_decimal(value)), "f")
    return "0" if text in ("-0", "0") else text


def float_text(value: float, single: bool = False) -> str:
    """Shortest digits that give the value back, with an exponent below 1e-4 and from 1e6 on."""
    if single:
        value = struct.unpack("f", struct.pack("f", value))[0]
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "+Inf" if value > 0 else "-Inf"
    text = repr(value)
    if single:
        text = next(t for t in (f"{value:.{p}e}" for p in range(9)) if struct.unpack("f", struct.pack("f", float(t)))[0] == value)
    d = decimal.Decimal(text)
    sign, digits, exponent = d.as_tuple()
    digits = "".join(map(str, digits)).lstrip("0")
    stripped = digits.rstrip("0")
    exponent += len(digits) - len(stripped)
    minus = "-" if sign else ""
    if not stripped:
        return minus + "0"
    point = len(stripped) + exponent - 1
    if point < -4 or point >= 6:
        mantissa = stripped[0] + ("." + stripped[1:] if len(stripped) > 1 else "")
        return f"{minus}{mantissa}e{'-' if point < 0 else '+'}{abs(point):02d}"
    return minus + format(decimal.Decimal(stripped).scaleb(exponent), "f")


def literal_text(value: str, pg_type: str | None) -> str | None:
    """The canonical text of a literal; null if it can't be a value of the type."""
    if pg_type is None:
        return value
    try:
        family = type_family(pg_type)
    except UnsupportedShardKeyType:
        return None
    word = value.strip()
    if family == "integer":
        return str(int(word)) if re.fullmatch(r"[+-]?\d+", word, re.ASCII) else None
    if family == "decimal":
        return decimal_text(value)
    if family in ("float", "double"):
        try:
            return float_text(float(word), family == "float")
        except (ValueError, OverflowError):
            return None
    if family == "bool":
        word = word.lower()
        return "true" if word in TRUE_WORDS else "false" if word in FALSE_WORDS else None
    if family == "uuid":
        compact = word.strip("{}").replace("-", "").lower()
        return "-".join((compact[:8], compact[8:12], compact[12:16], compact[16:20], compact[20:])) if re.fullmatch(r"[0-9a-f]{32}", compact) else None
    return value.rstrip(" ") if family == "padded" else value


def canonical(column: Column | str, pg_type: str) -> Column:
    """The canonical text of a typed column; null stays null, text that is no value becomes null."""
    c = F.col(column) if isinstance(column, str) else column
    family = type_family(pg_type)
    if family == "integer":
        return c.cast("decimal(38,0)").cast("string")
    if family == "decimal":
        text = c.cast("string")
        text = F.when(text.rlike(r"[eE]"), c.cast("decimal(38,18)").cast("string")).otherwise(text)
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\+", ""), r"^(-?)0+(?=\d)", "$1"), r"(\.\d*?)0+$", "$1")
        text = F.regexp_replace(F.regexp_replace(text, r"\.$", ""), r"^(-?)\.", "$10.")
        return F.when(text.isin("-0", ""), "0").otherwise(text)
    if family in ("float", "double"):
        single = family == "float"
        return F.udf(lambda v: None if v is None else float_text(v, single), "string")(c.cast("float" if single else "double"))
    if family == "bool":
        word = F.lower(F.trim(c.cast("string")))
        return F.when(word.isin(*TRUE_WORDS), "true").when(word.isin(*FALSE_WORDS), "false")
    if family == "uuid":
        compact = F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"^[{}]+|[{}]+$", ""), "-", ""))
        parts = [F.substring(compact, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.when(compact.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))
    return F.rtrim(c.cast("string")) if family == "padded" else c.cast("string")
