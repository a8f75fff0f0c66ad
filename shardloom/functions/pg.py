"""PostgreSQL semantics that Spark's own functions lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def asc(c: Column | str) -> Column:
    """Ascending, nulls last."""
    return _col(c).asc_nulls_last()


def desc(c: Column | str) -> Column:
    """Descending, nulls first."""
    return _col(c).desc_nulls_first()


def int_div(a: Column | str, b: Column | str) -> Column:
    """Integer division that truncates towards zero."""
    return F.call_function("div", _col(a), _col(b))


def array_agg(value: Column | str, *order: Column | str) -> Column:
    """All values with their nulls, ordered by the given expressions, then by the value."""
    keys = [F.struct(_col(o).isNull().alias("n"), _col(o).alias("v")).alias(f"k{i}") for i, o in enumerate(order)]
    rows = F.array_sort(F.collect_list(F.struct(*keys, F.struct(_col(value).isNull().alias("n"), _col(value).alias("v")).alias("value"))))
    return F.transform(rows, lambda r: r["value"]["v"])


def string_agg(value: Column | str, separator: str, *order: Column | str) -> Column:
    """Non-null values joined in order; null if there are none."""
    joined = F.array_compact(array_agg(_col(value).cast("string"), *order))
    return F.when(F.size(joined) > 0, F.array_join(joined, separator))


def json_agg(value: Column | str, *order: Column | str) -> Column:
    """A JSON array of all values, nulls included; null without rows."""
    rows = array_agg(value, *order)
    return F.when(F.size(rows) > 0, F.to_json(rows))


def json_agg_strict(value: Column | str, *order: Column | str) -> Column:
    """A JSON array of the non-null values."""
    rows = F.array_compact(array_agg(value, *order))
    return F.when(F.size(rows) > 0, F.to_json(rows))


def json_object_agg(key: Column | str, value: Column | str, *, strict: bool = False, unique: bool = False) -> Column:
    """A JSON object in key order; of repeated keys the last value by order stays.

    strict leaves out null values; unique raises on a repeated key.
    """
    pairs = F.collect_list(F.when(_col(value).isNotNull() if strict else F.lit(True), F.struct(_col(key).cast("string").alias("key"), _col(value).alias("value"))))
    pairs = F.array_sort(pairs)
    keys = F.transform(pairs, lambda p: p["key"])
    if unique:
        distinct = F.size(F.array_distinct(keys)) == F.size(keys)
        pairs = F.when(distinct, pairs).otherwise(F.raise_error(F.lit("22030: duplicate JSON object key value")))
    last = F.filter(pairs, lambda p, i: (i == F.size(pairs) - 1) | (p["key"] != F.get(pairs, i + 1)["key"]))
    return F.when(F.size(last) > 0, F.to_json(F.map_from_entries(last)))


def xml_agg(value: Column | str, *order: Column | str) -> Column:
    """XML fragments one after the other; null without any."""
    return string_agg(value, "", *order)


def range_agg(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """The union of half-open ranges [lo, hi) of each group as maximal ranges: keys, lo, hi.

    Overlapping and adjacent ranges merge; empty and null ranges contribute nothing.
    """
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    seen = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(lo) < F.col(hi)).withColumn("__new", F.when(seen.isNull() | (F.col(lo) > seen), 1).otherwise(0))
    island = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "__island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__island")


def range_intersect_agg(lo: Column | str, hi: Column | str) -> Column:
    """struct(lo, hi) of the ranges' common part; null if it is empty."""
    a, b = F.max(_col(lo)), F.min(_col(hi))
    return F.when(a < b, F.struct(a.alias("lo"), b.alias("hi")))


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def with_ties(df: DataFrame, n: int, *keys: tuple[Column, bool]) -> DataFrame:
    """The first n rows by keys (column, descending) and all that equal the n-th in them.

    The n-th row comes from a top-n (no global sort); rows are then compared with it, so that
    no window gathers the table in one task.
    """
    if n <= 0:
        return df.limit(0)
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.withColumns({name: c for name, (c, _) in zip(names, keys, strict=True)})
    by = [F.col(name).desc_nulls_first() if down else F.col(name).asc_nulls_last() for name, (_, down) in zip(names, keys, strict=True)]
    last = keyed.select(*names).orderBy(*by).limit(n).collect()[-1:]  # n rows at most, n is the caller's
    if not last:
        return df.limit(0)
    bound = last[0]
    reach: Column = F.lit(True)  # equal so far
    for name, (_, down) in reversed(list(zip(names, keys, strict=True))):
        c, v = F.col(name), F.lit(bound[name]).cast(keyed.schema[name].dataType)
        if bound[name] is None:
            ahead, same = (F.lit(False) if down else c.isNotNull()), c.isNull()
        else:
            ahead, same = ((c > v) | c.isNull() if down else F.coalesce(c < v, F.lit(False))), F.coalesce(c == v, F.lit(False))
        reach = ahead | (same & reach)
    return keyed.where(reach).drop(*names)


def groups_frame(df: DataFrame, keys: list[str], order: list[Column], start: int, end: int) -> tuple[DataFrame, WindowSpec]:
    """df and a window over it that is GROUPS BETWEEN start AND end: peer groups before (negative) and after the row's.

    A dense rank numbers the peer groups, so that the frame is a range of that number; drop __g afterwards.
    """
    numbered = df.withColumn("__g", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered, Window.partitionBy(*keys).orderBy("__g").rangeBetween(start, end)


def exclude_current_row(value: Column | str, window: WindowSpec) -> dict[str, Column]:
    """sum, count and avg of a frame with EXCLUDE CURRENT ROW; sum and avg are null if no value is left.

    The frame must hold the current row. An aggregate of the rest is the whole frame's less the row's own.
    """
    v = _col(value)
    n = F.count(v).over(window) - F.when(v.isNotNull(), 1).otherwise(0)
    total = F.when(n > 0, F.sum(v).over(window) - F.coalesce(v, F.lit(0)))
    return {"sum": total, "count": n, "avg": total / n}


def band_join(left: DataFrame, right: DataFrame, low: Column, high: Column, value: Column, width: float) -> DataFrame:
    """left and right where value (of right) lies between low and high (of left), both ends included.

    Both sides meet in bins of the width, then by the exact test: an equi-join that shuffles,
    where the plain condition compares every row with every row. A row of left goes to each bin
    that it overlaps, so width should be about the bands' length. Nulls match nothing.
    """
    bins = F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))
    l = left.withColumns({"__low": low, "__high": high}).where("__low <= __high").withColumn("__bin", F.explode(bins))
    r = right.withColumn("__value", value).withColumn("__bin", F.floor(value / width).cast("long"))
    return l.join(r, "__bin").where("__value between __low and __high").drop("__bin", "__low", "__high", "__value")


def age_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole days between two instants."""
    return F.datediff(_col(later), _col(earlier))
