"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_since, plain, scratch_mark, table, unused, written

SHINGLE = 5
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit and width
NEAR = 3  # bits that may differ inside a block
RADIUS = NEAR * len(BLOCKS) + len(BLOCKS) - 1  # 19: beyond it every block may differ in more than NEAR bits
FEW = 2_000_000  # rows of a join side that may be broadcast (some tens of MB); more are shuffled


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words (runs of letters and digits); null: none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)))


def with_shingles(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, n (words) and sh (the five-word shingle hashes by position; fewer words: none)."""
    hashed = df.select(*keep, word_hashes(F.col(text)).alias("w"))
    each = ", ".join(f"x[i + {k}]" for k in range(SHINGLE))
    # transform(array(w), x -> ...)[0] binds x to w: the optimizer can't copy w into the inner lambda
    both = F.expr(f"transform(array(w), x -> struct(size(x) as n, if(size(x) < {SHINGLE}, cast(array() as array<bigint>), transform(sequence(0, greatest(0, size(x) - {SHINGLE})), i -> xxhash64({each}))) as sh))")
    return hashed.select(*keep, F.inline(both))


def simhash(shingles: str) -> Column:
    """64 bits: bit b is set if more shingles (each as often as it occurs) have bit b set than not."""
    return F.expr(f"transform(array({shingles}), x -> aggregate(sequence(0, 63), 0L, (f, b) -> f | if(aggregate(x, 0, (s, h) -> s + if((shiftright(h, b) & 1L) = 1L, 1, -1)) > 0, shiftleft(1L, b), 0L)))[0]")


def _block(fp: str, i: int) -> Column:
    first, width = BLOCKS[i]
    return F.expr(f"shiftrightunsigned({fp}, {first}) & {(1 << width) - 1}L")


def _variants(fp: str) -> Column:
    """(block, value) for each block of fp and each value within NEAR bits of it."""
    out = []
    for i, (_, width) in enumerate(BLOCKS):
        masks = [sum(1 << b for b in bits) for k in range(NEAR + 1) for bits in combinations(range(width), k)]
        near = F.array(*[F.lit(m).cast("long") for m in masks])
        own = _block(fp, i)
        out.append(F.transform(near, lambda m: F.struct(F.lit(i).alias("block"), own.bitwiseXOR(m).alias("value"))))  # noqa: B023
    return F.concat(*out)


def _need(similarity: float) -> Column:
    """Positions that a window of n or words words must share with the item: c / (a + b - c) >= similarity."""
    both = F.least("n", "words") + F.col("words") - 2 * (SHINGLE - 1)
    return F.greatest(F.lit(1), F.ceil(both * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))).cast("int")


def _cover() -> Column:
    """Starts that cover every window with need of the positions at: each position that begins one, or the last window."""
    start = "greatest(0, least(x, n - words))"
    inside = f"get(at, i + need - 1) <= {start} + words - {SHINGLE}"
    return F.expr(f"array_distinct(filter(transform(at, (x, i) -> if({inside}, {start}, null)), x -> x is not null))")


def matches(docs: DataFrame, benchmark: DataFrame, *, similarity: float = 0.8) -> DataFrame:
    """Which documents hold which benchmark items: doc_id, rid, item_id, start, words, similarity.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored. Windows
    have the size of the items, in words. Two texts are compared by the weighted Jaccard
    similarity of their five-word shingles, each weighing as often as it occurs.

    1. A window at the similarity has at least `need` positions whose shingle is in the item, in
       any order. Windows that have so many are covered by those that begin at such a position
       (or are the last of the text): moving the start on to the next such position loses none of
       them. Besides these, windows are fingerprinted in which a shingle lies at its place in
       the item.
    2. The fingerprints of windows and items of the same size meet in a multi-index: five
       blocks of 12 or 13 bits, each probed with all values up to three bits away. By the
       pigeonhole principle it finds every pair at a Hamming distance of up to RADIUS = 19.
    3. Pairs within the radius are verified exactly.

    One row for each document and item, with the best window (of equals one in which a shingle
    lies at its place, then the first); a document
    text (rid) that occurs in several rows with one doc_id counts once, as do repeated rows of
    benchmark. Null and empty texts and items below five words, which have no shingle, match
    nothing; a text shorter than an item is one window, one of any length is read whole. Either
    table may be empty.
    """
    items = with_shingles(benchmark.where("item_id is not null"), "text", F.col("item_id").cast("long").alias("item_id")).where(f"n >= {SHINGLE}")
    items = written(items.withColumn("fp", simhash("sh")).dropDuplicates(["item_id", "sh"]), "items")
    needles = items.select("item_id", F.col("n").alias("words"), F.posexplode("sh").alias("off", "h")).distinct()
    needles = written(needles, "needles")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    hay = with_shingles(rows, "text", "rid").select("rid", "n", F.posexplode("sh").alias("pos", "h"))
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("off"), F.col("n") - F.col("words")))
    hits = hay.join(_small(needles, needles.count()), "h").groupBy("rid", "n", "item_id", "words").agg(F.sort_array(F.collect_set("pos")).alias("at"), F.collect_set(start).alias("placed"))
    hits = written(hits.withColumn("need", _need(similarity)), "hits")
    windows = hits.select("rid", "words", F.explode("placed").alias("start"), F.lit(True).alias("placed"))
    windows = windows.union(hits.where("size(at) >= need").select("rid", "words", F.explode(_cover()).alias("start"), F.lit(False)))
    windows = written(windows.groupBy("rid", "words", "start").agg(F.max("placed").alias("placed")), "windows")
    touched = written(windows.select("rid").distinct(), "touched")
    texts = rows.join(_small(touched, touched.count()), "rid").dropDuplicates(["rid"])
    cut = with_shingles(texts, "text", "rid", "doc_id").join(windows, "rid")
    cut = cut.select("rid", "doc_id", "words", "start", "placed", F.expr(f"slice(sh, start + 1, words - {SHINGLE - 1})").alias("ws"))
    cut = written(cut.withColumn("wfp", simhash("ws")), "cut")
    probes = items.select("item_id", F.col("n").alias("words"), "fp", F.explode(_variants("fp")).alias("v")).select("item_id", "words", "fp", "v.block", "v.value")
    places = cut.select("rid", "words", "start", "wfp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block("wfp", i).alias("value")) for i in range(len(BLOCKS))])).alias("v")).select("rid", "words", "start", "wfp", "v.block", "v.value")
    pairs = places.join(probes, ["words", "block", "value"]).where(F.expr(f"bit_count(wfp ^ fp) <= {RADIUS}")).select("rid", "words", "start", "item_id").distinct()
    both = pairs.join(cut, ["rid", "words", "start"]).join(items.select("item_id", F.col("sh").alias("is")), "item_id")
    common = F.expr("aggregate(array_distinct(is), 0, (s, x) -> s + least(size(filter(ws, y -> y = x)), size(filter(is, y -> y = x))))")
    scored = both.withColumn("common", common).withColumn("similarity", F.col("common") / (F.size("ws") + F.size("is") - F.col("common")))
    best = scored.where(F.col("similarity") >= similarity).groupBy("doc_id", "rid", "item_id").agg(F.max(F.struct("similarity", "placed", (-F.col("start")).alias("at"), "words")).alias("b"))
    return best.select("doc_id", "rid", "item_id", (-F.col("b.at")).alias("start"), "b.words", "b.similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **parameters: float) -> DataFrame:
    """docs without the rows whose text holds a benchmark item (see matches)."""
    mark = scratch_mark()
    gone = written(matches(docs, benchmark, **parameters).select("rid").distinct(), "leaks")
    drop_since(docs.sparkSession, mark, gone)
    rid, key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), unused(docs, "__rid")
    return docs.withColumn(key, rid).join(_small(gone.withColumnRenamed("rid", key), gone.count()), key, "left_anti").select(*plain(docs))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "words", F.round("similarity", 6).alias("similarity"))


_SHINGLES = "list_transform(range(1, greatest(1, len(w) - 3)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])"
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
# Every item-sized window of every text that shares a shingle with the item, in a plain loop over starts.
OP10_SQL = f"""
with d as (select doc_id, len(w) as n, {_SHINGLES} as sh from (select distinct doc_id, text, {_WORDS} as w from documents)),
i as (select item_id, len(w) as words, {_SHINGLES} as sh from (select item_id, {_WORDS} as w from benchmark) where len(w) >= 5),
needle as (select item_id, words, unnest(sh) as h, generate_subscripts(sh, 1) - 1 as off from i),
hay as (select doc_id, n, unnest(sh) as h, generate_subscripts(sh, 1) - 1 as pos from d),
hit as (select doc_id, item_id, n, words, pos, off from hay join needle using (h)),
touch as (select doc_id, item_id, any_value(n) as n, any_value(words) as words, list_distinct(list(greatest(0, least(pos - off, n - words)))) as placed, list_distinct(list(pos)) as begin_at from hit group by doc_id, item_id),
win as (select *, unnest(range(0, greatest(1, n - words + 1))) as start from touch),
cut as (select doc_id, item_id, start, words, list_contains(placed, start) as placed, list_contains(begin_at, start) or start = n - words as begins, d.sh[start + 1 : start + words - 4] as ws, i.sh as sh
  from win join d using (doc_id, n) join i using (item_id, words)),
pair as (select doc_id, item_id, start, words, placed, begins, len(ws) as a, len(sh) as b,
  list_sum(list_transform(list_distinct(sh), lambda x: least(len(list_filter(ws, lambda y: y = x)), len(list_filter(sh, lambda z: z = x))))) as c
  from cut where len(list_intersect(ws, sh)) > 0),
best as (select *, c / (a + b - c) as sim, row_number() over (partition by doc_id, item_id order by c / (a + b - c) desc, placed desc, placed or begins desc, start) as k from pair where c / (a + b - c) >= 0.8)
select doc_id, item_id, cast(start as int) as start, cast(words as int) as words, round(sim, 6) as similarity from best where k = 1
"""
