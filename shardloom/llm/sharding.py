"""Two-pass external shuffle into shards, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, table, written

FEW = 1_000_000  # hashes of repeated rows that may be broadcast (16 MB)

BUCKET = 16 << 20  # bytes of text that a bucket holds on average; a bucket is shuffled in memory
CHUNK = 4_096  # buckets, and copies of a row, that one task handles together


def size_of(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _before(count: DataFrame) -> DataFrame:
    """bucket, base: the rows of all buckets below, from (bucket, m); chunk sums first, then inside each chunk."""
    chunk = count.withColumn("chunk", F.expr(f"bucket div {CHUNK}"))
    tops = chunk.groupBy("chunk").agg(F.sum("m").alias("t"))
    tops = tops.withColumn("top", F.coalesce(F.sum("t").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("chunk", "top")
    inside = Window.partitionBy("chunk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return chunk.withColumn("own", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(tops, "chunk").select("bucket", (F.col("top") + F.col("own")).alias("base"))


def shuffle_into_shards(docs: DataFrame, uri: str, shards: int, *, seed: int = 17, bucket_bytes: int = BUCKET) -> DataFrame:
    """Write docs (with a text column) in a seeded random order, in equal shards, and read them back.

    Pass 1 scatters the rows uniformly into buckets by a seeded hash of the whole row and, for
    rows that are equal in all columns, of the copy's number. Pass 2 brings each bucket to one
    task, puts it in a definite order, applies Fisher-Yates (Spark's shuffle() on arrays) and
    writes. Prefix sums of the bucket counts turn a row's rank in its bucket into its place in
    the whole order, and shard s takes the places from ceil(s n / shards) on, so that shard
    sizes are at most one apart whatever the data. The order depends on seed, bucket_bytes and
    the number of shuffle partitions, as Spark's shuffle() adds the partition to its seed.

    Returns the columns of docs, shard (int) and slot (long, from 0 without gaps in each shard);
    columns of docs with these two names are replaced, others may have any name and, but for
    maps, any type. Nulls are values like others; equal rows all stay, dealt over the buckets
    by number: one of them is counted out where the map side has merged them. A long text makes
    its bucket larger by its size. An empty table gives no rows.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), size_of().alias("size")).withColumn("h", F.xxhash64(F.lit(seed), "row"))
    equal = written(rows.groupBy("h").agg(F.count("*").alias("m"), F.first("size").alias("size")), "equal")
    n, total, most = equal.agg(F.sum("m"), F.sum(F.col("m") * F.col("size")), F.max("m")).first()
    n, buckets = n or 0, max(1, -(-(total or 0) // bucket_bytes))
    at = lambda copy: F.pmod(F.when(copy == 0, F.col("h")).otherwise(F.xxhash64("h", copy)), F.lit(buckets)).alias("bucket")
    single = rows.select(at(F.lit(0)), "row")
    one = equal.select(at(F.lit(0)))
    if (most or 0) > 1:
        many = written(equal.where("m > 1").select("h"), "many")
        if many.count() <= FEW:
            many = F.broadcast(many)
        # by row, as two rows may share a hash
        copies = written(rows.join(many, "h", "left_semi").groupBy("h", "row").agg(F.count("*").alias("m")), "copies")
        chunks = F.explode(F.expr(f"sequence(0, (m - 1) div {CHUNK})")).alias("chunk")
        numbers = F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(m, (chunk + 1) * {CHUNK}) - 1)")).alias("copy")
        each = lambda *kept: copies.select("h", *kept, "m", chunks).repartition("h", "chunk").select("h", *kept, numbers).select(at(F.col("copy")), *kept)
        single = rows.join(many, "h", "left_anti").select(at(F.lit(0)), "row").union(each("row"))
        one = equal.where("m = 1").select(at(F.lit(0))).union(each())
    base = written(_before(one.groupBy("bucket").agg(F.count("*").alias("m"))), "bases")
    held = single.groupBy("bucket").agg(F.collect_list("row").alias("rows"))
    mixed = held.join(base, "bucket").select("base", F.posexplode(F.shuffle(F.array_sort("rows"), seed)).alias("rank", "row"))
    place = F.col("base") + F.col("rank")
    shard = F.floor(place * shards / F.lit(max(n, 1))) if n * shards < 1 << 52 else (place.cast("decimal(20,0)") * shards / F.lit(n)).cast("long")
    first = F.expr(f"(cast(shard as decimal(20,0)) * {n} + {shards - 1}) div {shards}")
    out = mixed.select("row", shard.cast("int").alias("shard"), place.alias("place")).select("row", "shard", (F.col("place") - first).cast("long").alias("slot"))
    out = out.select(*[F.col(f"row.`{c}`") for c in keep], "shard", "slot")
    out.write.partitionBy("shard").option("compression", "zstd").parquet(uri)
    return spark.read.schema(out.schema).parquet(uri)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39; the law that holds is `rows`, so grown_shard is null."""
    done = shuffle_into_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"), 40)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return done.select("doc_id", size_of().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
