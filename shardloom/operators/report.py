"""Test reports as data: TAP lines, schedules, missing and regressed tests, output digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAP = r"^(ok|not ok)\s+(\d+)\s+[-+]?\s*(\S+)(?:\s+(\d+)\s*ms)?(?:\s*#\s*(\w+)\s*(.*))?"


def tap_results(lines: DataFrame, column: str = "value") -> DataFrame:
    """test, number, status (pass, fail, skip, todo), ms: one row a result line."""
    c = F.col(column)
    got = lambda i: F.regexp_extract(c, TAP, i)
    directive = F.lower(got(5))
    status = F.when(directive == "skip", "skip").when(directive == "todo", "todo").when(got(1) == "ok", "pass").otherwise("fail")
    ms = F.when(got(4) != "", got(4).cast("int"))
    return lines.where(c.rlike(TAP)).select(got(3).alias("test"), got(2).cast("int").alias("number"), status.alias("status"), ms.alias("ms"))


def schedule(lines: DataFrame, column: str = "value") -> DataFrame:
    """test: the tests of `test: a b c` lines."""
    body = F.regexp_extract(F.col(column), r"^\s*test:\s*(.*)$", 1)
    return lines.where(F.col(column).rlike(r"^\s*test:")).select(F.explode(F.split(F.trim(body), r"\s+")).alias("test")).where("test <> ''")


def missing(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Scheduled tests without a result."""
    return expected.select("test").join(results.select("test"), "test", "left_anti")


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tests that passed and do not pass now; a test without a result counts as missing."""
    now = after.select("test", F.col("status").alias("now"))
    return before.where("status = 'pass'").select("test").join(now, "test", "left").withColumn("now", F.coalesce("now", F.lit("missing"))).where("now <> 'pass'")


def digest(text: Column | str, *replacements: tuple[str, str]) -> Column:
    """SHA-256 of an output after the reviewed replacements."""
    c = F.col(text) if isinstance(text, str) else text
    for pattern, by in replacements:
        c = F.regexp_replace(c, pattern, by)
    return F.sha2(c, 256)


def summary(results: DataFrame) -> DataFrame:
    """tests by status."""
    return results.groupBy("status").agg(F.count("*").alias("tests"))
