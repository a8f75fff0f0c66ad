"""Mixing sources to target weights: temperature, entropy or repetition target, block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

LEVELS, JOBS = 5, 8  # halvings of the exponent's interval that one job decides, and jobs: 40 halvings
FEW = 1_000_000  # sources whose plan may be broadcast (some tens of MB); more are joined by shuffle


def word_count(text: str = "text") -> Column:
    """Words between white space; null and blank texts have none."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def exponent(totals: DataFrame, *, max_repeat: float | None = 4.0, target_entropy: float | None = None, budget: float | None = None) -> float:
    """Bisect the exponent a of the weights p^a, p the token shares of totals (source, tokens > 0).

    target_entropy (nats): the a in 0 to 1 whose weights have that entropy; out of reach, the
    nearer end. Else max_repeat: the least a at which no source repeats more often than that,
    given the budget; without a budget the largest source is taken once. One job measures all
    the midpoints that the next LEVELS halvings may need, as one aggregate over the sources;
    nothing is collected but these few numbers.
    """
    total, most = totals.agg(F.sum("tokens"), F.max("tokens")).first()
    if not total:
        return 1.0

    def fits(points: list[float]) -> list[bool]:
        """Whether at each exponent the weights are still as even as may be."""
        each = totals.select((F.col("tokens") / F.lit(float(total))).alias("p"), F.explode(F.array(*[F.lit(x) for x in points])).alias("a"))
        w = F.pow("p", F.col("a"))
        found = each.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("plogp"), F.max(F.pow("p", F.col("a") - 1)).alias("peak"))
        of = {r["a"]: r for r in found.collect()}  # a row for each point
        out = []
        for x in points:
            r = of[x]
            b = budget if budget is not None else total * r["z"] * (most / total) ** (1 - x)
            entropy, repeat = math.log(r["z"]) - r["plogp"] / r["z"], b / total * r["peak"] / r["z"]
            out.append(entropy <= target_entropy if target_entropy is not None else repeat <= max_repeat)
        return out

    low, high = 0.0, 1.0
    if fits([low])[0]:
        return low
    if not fits([high])[0]:
        return high
    for _ in range(JOBS):
        n = 1 << LEVELS
        points = [low + (high - low) * i / n for i in range(1, n)]
        fit = fits(points)
        first, last = 0, n
        while last - first > 1:
            mid = (first + last) // 2
            first, last = (first, mid) if fit[mid - 1] else (mid, last)
        low, high = low + (high - low) * first / n, low + (high - low) * last / n
    return high


def mixture(docs: DataFrame, *, max_repeat: float = 4.0, target_entropy: float | None = None, budget: int | None = None, block: int = 1 << 16, seed: int = 23, tokens: Column | None = None) -> DataFrame:
    """row (a struct of the columns of docs), n_tokens, epoch (int, from 0), mix_order (double): the mixture's rows.

    Source shares of tokens are raised to an exponent (see exponent()) and normalised; a source
    of T tokens gets weight * budget tokens. The budget, if not given, is the one that takes the
    largest source once, so that every document occurs. Each whole pass over a source is an
    epoch; the last, partial epoch takes its documents in a seeded permutation by blocks of about
    block tokens: whole blocks by prefix sums of block sizes, then documents inside the block
    that the budget cuts, never beyond the budget. Sorting by mix_order interleaves the sources
    evenly, each epoch of a source permuted by its own seed.

    docs needs doc_id, text, source; its columns may have any names and, but for maps, any types.
    A null source is a source. Sources without tokens (null, empty or blank texts) are taken once.
    Rows that are equal in all columns count and occur like others; where the budget ends among
    them, as many of them are taken as fit. An empty table gives no rows; a text of any length is
    one row. Sums of a hot source are partial aggregates, its prefix sums run over blocks, and
    only one block a source, its equal rows counted first, is sorted.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    row = docs.select(whole.alias("row"), (tokens if tokens is not None else word_count()).alias("n"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("of"))
    row = row.withColumn("rid", F.xxhash64("row"))
    slim = written(row.select("rid", "of", "n"), "sizes")
    totals = written(slim.groupBy("of").agg(F.sum("n").alias("tokens")), "sources")
    positive = totals.where("tokens > 0").select(F.col("of").alias("source"), "tokens")
    a = exponent(positive, max_repeat=max_repeat, target_entropy=target_entropy, budget=budget)
    total, most = positive.agg(F.sum("tokens"), F.max("tokens")).first()
    total, most = float(total or 1), float(most or 1)
    z = positive.agg(F.sum(F.pow(F.col("tokens") / total, F.lit(a)))).first()[0] or 1.0
    b = float(budget) if budget is not None else total * z * (most / total) ** (1 - a)
    repeat = F.when(F.col("tokens") == 0, 1.0).otherwise(F.pow(F.col("tokens") / total, F.lit(a - 1)) / z * (b / total) + 1e-9)
    plan = totals.withColumn("repeat", repeat).withColumn("full", F.floor("repeat").cast("int"))
    plan = plan.withColumns({"rest": F.floor((F.col("repeat") - F.col("full")) * F.col("tokens")).cast("long"), "blocks": F.ceil(F.greatest(F.col("tokens"), F.lit(1)) / block).cast("long")})
    plan = written(plan.select("of", "repeat", "full", "rest", "blocks"), "plan")

    def placed(rows: DataFrame, epoch: Column) -> DataFrame:
        h = F.xxhash64(F.lit(seed), epoch, "rid")
        return rows.withColumns({"block": F.pmod(h, F.col("blocks")), "in": F.xxhash64(h)})

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= FEW else df

    last = placed(slim.join(small(plan.select("of", "full", "rest", "blocks")), "of"), F.col("full"))
    sums = last.groupBy("of", "block").agg(F.sum("n").alias("t"), F.first("rest").alias("rest"))
    w = Window.partitionBy("of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bound = sums.withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0)))
    cut = written(bound.where("before < rest and before + t > rest").select("of", "block", "before"), "cut")
    full = bound.where("before < rest and before + t <= rest").groupBy("of").agg(F.max("block").alias("through"))
    inside = Window.partitionBy("of").orderBy("in", "rid").rowsBetween(Window.unboundedPreceding, -1)
    equal = last.join(small(cut), ["of", "block"]).groupBy("of", "block", "in", "rid", "n", "rest", "before").agg(F.count("*").alias("m"))
    equal = equal.withColumn("at", F.col("before") + F.coalesce(F.sum(F.col("m") * F.col("n")).over(inside), F.lit(0)))
    # the first rows that do not all fit; of them as many as fit
    edge = equal.where("at <= rest and at + m * n > rest").select("of", F.col("block").alias("cut"), F.col("in").alias("end_in"), F.col("rid").alias("end_rid"), F.floor((F.col("rest") - F.col("at")) / F.col("n")).cast("int").alias("copies"))
    plan = written(plan.join(full, "of", "left").join(edge, "of", "left"), "edges")
    each = placed(row.join(small(plan), "of").withColumn("epoch", F.explode(F.expr("sequence(0, full)"))), F.col("epoch"))
    whole_block = F.coalesce(F.col("block") <= F.col("through"), F.lit(False)) & F.coalesce(F.col("block") != F.col("cut"), F.lit(True))
    before_edge = (F.col("block") == F.col("cut")) & ((F.col("in") < F.col("end_in")) | ((F.col("in") == F.col("end_in")) & (F.col("rid") < F.col("end_rid"))))
    ends = F.coalesce((F.col("epoch") == F.col("full")) & (F.col("rid") == F.col("end_rid")), F.lit(False))
    taken = (F.col("epoch") < F.col("full")) | ((F.col("rest") > 0) & (whole_block | F.coalesce(before_edge, F.lit(False))))
    parts = [each.where(~ends & taken)]
    if not plan.where("copies > 0").isEmpty():  # the budget ends among equal rows: so many copies of one of them
        parts.append(each.where(ends & (F.col("copies") > 0)).dropDuplicates(["of"]).withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop("copy"))
    each = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    unit = F.pmod("in", F.lit(1 << 30)) / float(1 << 30)
    order = (F.col("epoch") + (F.col("block") + unit) / F.col("blocks")) / F.greatest("repeat", F.lit(1e-9))
    return each.select("row", F.col("n").alias("n_tokens"), "epoch", order.alias("mix_order"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of mixture() as docs with n_tokens, epoch and mix_order; columns of docs with these names are replaced."""
    keep = [c for c in docs.columns if c.lower() not in ("n_tokens", "epoch", "mix_order")]
    return mixture(docs, **parameters).select(*[F.col(f"row.`{c}`") for c in keep], "n_tokens", "epoch", "mix_order")


def write_mixed(mix: DataFrame, uri: str) -> DataFrame:
    """Write rows of mixed() or mixture() in the mixture's order, file after file, and read them back."""
    mix.repartitionByRange("mix_order").sortWithinPartitions("mix_order").write.parquet(uri)
    return mix.sparkSession.read.schema(mix.schema).parquet(uri)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with the default repetition limit of 4: doc_id, source, n_tokens, epoch, mix_order."""
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_tokens", "epoch", "mix_order")
