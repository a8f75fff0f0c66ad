"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_since, kept_by, mix64, release, scratch_mark, scratch_path, small_batches, table, written

BOS, EOS = "\x02", "\x03"
BATCH = 24_000_000  # bytes of text whose distinct n-grams are looked up together
FEW = 2_000_000  # trusted ids that may be broadcast (16 MB of longs); more are joined by shuffle
PIECE = 1_000_000  # longer texts are cut, with overlap, into pieces of so many characters
SLICE = 2_000  # rows whose texts are Python strings at a time
DENSE = 1 << 23


def pieces(text: str | None, order: int) -> list[str]:
    """The padded text in pieces that share order - 1 characters: each n-gram lies in one piece."""
    t = (text or "").replace(BOS, " ").replace(EOS, " ")
    full = BOS * (order - 1) + t + EOS
    return [full[i : i + PIECE + order - 1] for i in range(0, len(full) - order + 1, PIECE)]


def grams(parts: list[str], order: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct n-grams of some pieces; the n-gram of each window; the piece of each window."""
    joined = "".join(parts)
    size = np.array([len(p) for p in parts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)

    def dense(code: np.ndarray, most: int) -> tuple[np.ndarray, int]:
        if most > DENSE:
            u, inverse = np.unique(code, return_inverse=True)
            return inverse.astype(np.int32), len(u)
        seen = np.zeros(most, np.bool_)
        seen[code] = True
        rank = np.cumsum(seen, dtype=np.int32) - 1
        return rank[code], int(rank[-1]) + 1 if most else 0

    char, width = dense(points, int(points.max()) + 1)
    code, n = char, width
    for _ in range(order - 1):
        nxt = code[:-1].astype(np.int64) * width + char[len(char) - len(code) + 1 :]
        code, n = dense(nxt, n * width)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), size)[: len(code)]
    inside = np.arange(len(code)) - start[owner] <= size[owner] - order
    code, owner, at = code[inside], owner[inside], np.flatnonzero(inside)
    seen = np.zeros(n, np.bool_)
    seen[code] = True
    rank = np.cumsum(seen, dtype=np.int32) - 1
    first = np.empty(int(rank[-1]) + 1, np.int64)
    first[rank[code]] = at
    return [joined[i : i + order] for i in first.tolist()], rank[code], owner


def _batched(texts: list, order: int) -> Iterator[tuple[list[str], list[int]]]:
    held, of, chars = [], [], 0
    for i, text in enumerate(texts):
        for p in pieces(text, order):
            held.append(p)
            of.append(i)
            chars += len(p)
            if chars >= PIECE:
                yield held, of
                held, of, chars = [], [], 0
    if held:
        yield held, of


def _cut(c: Column | str, start: int, length: int) -> Column:
    return F.substring(c, start, length)


def kneser_ney(counts: DataFrame, order: int) -> tuple[dict[int, tuple[DataFrame, DataFrame]], float]:
    """For each order m two tables, and the probability of an unseen character.

    counts: (gram, n) of the highest order. Lower orders count distinct left extensions. The
    discounts D1, D2, D3+ of each order follow from its counts of counts (Chen and Goodman
    1998), a few numbers that the driver collects. The tables: (gram, share), the discounted
    share of the gram after its context, and (context, left), the mass that a context leaves to
    the next lower order.
    """
    orders = {order: counts.select("gram", F.col("n").alias("a"))}
    for m in range(order - 1, 0, -1):
        orders[m] = orders[m + 1].groupBy(_cut("gram", 2, m).alias("gram")).agg(F.count("*").alias("a"))
    orders = {m: written(x, f"order{m}") for m, x in orders.items()}
    stats = None
    for m, x in orders.items():
        row = x.agg(F.lit(m).alias("m"), *[F.sum((F.col("a") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)], F.count("*").alias("rows"))
        stats = row if stats is None else stats.union(row)
    of = {r["m"]: r for r in stats.collect()}
    model = {}
    for m, x in orders.items():
        r = of[m]
        n = [(r[f"n{i}"] or 0) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d = [min(i, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else i / 2 for i in (1, 2, 3)]
        discount = F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])
        context = _cut("gram", 1, m - 1)
        total = x.groupBy(context.alias("context")).agg(F.sum("a").alias("s"), F.sum(discount).alias("d"))
        share = x.withColumn("context", context).join(total.select("context", "s"), "context").select("gram", ((F.col("a") - discount) / F.col("s")).alias("share"))
        model[m] = share, total.select("context", (F.col("d") / F.col("s")).alias("left"))
    return model, 1.0 / (1 + of[1]["rows"])


def score_grams(known: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]], floor: float, order: int) -> DataFrame:
    """gram, logp: the interpolated log probability of the last character of each gram.

    From single characters up, the distinct suffixes of each length join their counts, their
    contexts and the scores of the next shorter suffixes, sharded by these keys. A key meets at
    most one row for each character of the alphabet, so none is hot.
    """
    suffix = {order: known.select("gram")}
    for m in range(order - 1, 0, -1):
        suffix[m] = suffix[m + 1].select(_cut("gram", 2, m).alias("gram")).distinct()
    lower = None
    for m in range(1, order + 1):
        share, left = model[m]
        x = suffix[m].join(share, "gram", "left").withColumn("context", _cut("gram", 1, m - 1)).join(left, "context", "left")
        below = F.lit(floor)
        if lower is not None:
            x = x.withColumn("shorter", _cut("gram", 2, m - 1)).join(lower.select(F.col("gram").alias("shorter"), F.col("p").alias("q")), "shorter")
            below = F.col("q")
        lower = written(x.select("gram", (F.coalesce("share", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * below).alias("p")), f"suffix{m}")
    return lower.select("gram", F.log("p").cast("float").alias("logp"))


def _whole_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows (rid, text, known) in batches of about BATCH characters, each with a key of its content."""
    held, chars = [], 0

    def keyed() -> tuple[int, pa.Table]:
        t = pa.concat_tables(held)
        rid = t.column("rid").to_numpy().view(np.uint64)
        order = mix64(rid + np.arange(len(rid), dtype=np.uint64))
        return int(np.bitwise_xor.reduce(mix64(order)).view(np.int64)), t

    for batch in batches:
        for i in range(0, batch.num_rows, 2_000):
            part = batch.slice(i, 2_000)
            held.append(pa.Table.from_batches([part]))
            chars += part.column(1).nbytes
            if chars >= BATCH:
                yield keyed()
                held, chars = [], 0
    if held:
        yield keyed()


def _summed(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by("gram").aggregate([("n", "sum")])
    return out.rename_columns(["gram" if c == "gram" else "n" for c in out.column_names])


def batch_grams(docs: DataFrame, order: int) -> DataFrame:
    """batch, gram, n: the distinct n-grams of each batch of rows; n counts them in its known rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("quality")
        for key, t in _whole_batches(batches):
            held = []
            for first in range(0, t.num_rows, SLICE):
                part = t.slice(first, SLICE)
                trusted = part.column("known").to_numpy(zero_copy_only=False).astype(np.int64)
                for parts, of in _batched(part.column("text").to_pylist(), order):
                    gram, code, owner = grams(parts, order)
                    n = np.bincount(code, trusted[np.array(of)[owner]]).astype(np.int64)
                    held.append(pa.table({"gram": pa.array(gram, pa.string()), "n": n}))
                    del gram, code, owner, n
                if len(held) > 8:
                    held = [_summed(held)]
            for found in _summed(held).to_batches(max_chunksize=100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(found.num_rows, key)), found.column("gram"), found.column("n")], ["batch", "gram", "n"])
            del held, t
            release()

    return docs.mapInArrow(run, "batch long, gram string, n long")


def perplexities(docs: DataFrame, answers: DataFrame, order: int) -> DataFrame:
    """docs (rid, text, known) and answers (batch, gram, logp) to rid, n (characters and the end), logp (sum).

    The answers lie in the shared folder, split by batch; the task that scans a batch reads its
    own. So the texts are never shuffled, and no task holds more than one batch's n-grams.
    """
    spark = docs.sparkSession
    uri = scratch_path(spark, "answers")
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = F.pmod("batch", F.lit(shards)).cast("int")
    answers.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions("batch").write.partitionBy("shard").parquet(uri)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import compute, parquet
        from pyarrow import fs as pafs

        kept_by("quality")
        fs, root = pafs.FileSystem.from_uri(uri)
        for key, t in _whole_batches(batches):
            found = parquet.read_table(f"{root}/shard={key % shards}", filesystem=fs, filters=[("batch", "=", key)], columns=["gram", "logp"], partitioning=None)
            known, score = found.column("gram").combine_chunks(), found.column("logp").to_numpy()
            logp, n = np.zeros(t.num_rows), np.zeros(t.num_rows, np.int64)
            for first in range(0, t.num_rows, SLICE):
                texts = t.column("text").slice(first, SLICE).to_pylist()
                for parts, of in _batched(texts, order):
                    gram, code, owner = grams(parts, order)
                    at = compute.index_in(pa.array(gram, pa.string()), value_set=known)
                    if at.null_count:
                        raise RuntimeError("the partitions of the input changed between two passes; write it to a table first")
                    row = first + np.array(of)[owner]
                    logp += np.bincount(row, score[at.to_numpy()][code], t.num_rows)
                    n += np.bincount(row, minlength=t.num_rows)
                    del gram, code, owner, at, row
            yield pa.RecordBatch.from_arrays([t.column("rid").combine_chunks(), pa.array(n), pa.array(logp)], ["rid", "n", "logp"])
            del found, known, score, t
            release()

    return docs.mapInArrow(total, "rid long, n long, logp double")


def bounds_of(bars: DataFrame, low: float, high: float, *by: str) -> DataFrame:
    """by, q (the low, high and middle quantile of known rows) and mid (the middle one of others).

    bars: counts n of values b (thousandths). Exact for these values: cumulative counts over the
    bars, so neither rows nor sketches gather in a task.
    """
    w = Window.partitionBy(*by, "known")
    cum = bars.withColumns({"cum": F.sum("n").over(w.orderBy("b")), "all": F.sum("n").over(w)})
    at = lambda p, known: F.min(F.when((F.col("known") == known) & (F.col("cum") >= p * F.col("all")), F.col("b"))) / 1000
    return cum.groupBy(*by).agg(F.array(at(low, True), at(high, True), at(0.5, True)).alias("q"), at(0.5, False).alias("mid"))


def scored(docs: DataFrame, labels: DataFrame, *, order: int = 5, high: float = 0.99, low: float = 0.01, slack: float = 0.1, sure: float = 3.0) -> DataFrame:
    """row (a struct of the columns of docs), n_tokens, perplexity, low_bound, high_bound, kept.

    The model is trained on the whole trusted text: documents whose label says quality 1 and not
    toxic, every n-gram of them counted. Bounds are language-specific quantiles (high and low) of
    the trusted documents' mean surprise, in nats a character, widened by slack. A model knows the
    texts that it has counted, so the high bound also moves up by the distance between the
    language's median among other documents and among trusted ones (0 to 0.5 nats). A document is
    rejected if its own mean surprise lies beyond a bound by more than sure standard errors of
    its length. A language without trusted documents uses the bounds of all languages.

    docs needs doc_id, text, lang and may have other columns of any names; labels needs doc_id,
    quality, toxic. A document without text (null, empty or white space only) is rejected,
    perplexity null. Null languages form one language. Repeated rows are scored alike. Texts of
    any length are scored whole, in overlapping pieces. Without trusted text everything else is
    kept, with null perplexity and bounds. An empty table gives no rows.
    """
    spark, mark = docs.sparkSession, scratch_mark()
    small_batches(spark)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    row = docs.select(whole.alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.coalesce("lang", F.lit("")).alias("of"), F.xxhash64("doc_id", "text").alias("rid"))
    trusted = written(labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id", F.lit(True).alias("known")).distinct(), "trusted")
    few = trusted.count() <= FEW
    text = row.where("trim(text) <> ''").select("rid", "doc_id", "text").join(F.broadcast(trusted) if few else trusted, "doc_id", "left").select("rid", "text", F.coalesce("known", F.lit(False)).alias("known"))
    if not few:
        text = written(text, "texts")  # a scan has the same partitions in each pass
    need = written(batch_grams(text, order), "grams")
    counts = written(need.groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    model, floor = kneser_ney(counts.where("n > 0"), order)
    if floor == 1.0:
        nothing = F.lit(None).cast("double")
        kept = F.coalesce(F.trim("text") != "", F.lit(False))
        return row.select("row", F.lit(0).cast("long").alias("n_tokens"), nothing.alias("perplexity"), nothing.alias("low_bound"), nothing.alias("high_bound"), kept.alias("kept"))
    scores = written(score_grams(counts, model, floor, order), "scores")
    answers = need.select("batch", "gram").join(scores, "gram")
    score = written(perplexities(text, answers, order).groupBy("rid").agg(F.max("n").alias("n"), F.max("logp").alias("logp")), "perplexity")
    drop_since(spark, mark, trusted, score)
    base = row.select("rid", "doc_id", "of").join(score, "rid").withColumn("h", -F.col("logp") / F.col("n"))
    base = base.join(F.broadcast(trusted) if few else trusted, "doc_id", "left")
    mark = base.select("of", F.coalesce("known", F.lit(False)).alias("known"), F.round(F.col("h") * 1000).cast("long").alias("b"))
    bars = written(mark.groupBy("of", "known", "b").agg(F.count("*").alias("n")), "bars")  # some thousands a language
    every = bounds_of(bars.groupBy("known", "b").agg(F.sum("n").alias("n")), low, high).first()  # four numbers
    if every is None or every["q"] is None:
        every = {"q": [0.0, 0.0, 0.0]}
    bounds = written(bounds_of(bars, low, high, "of"), "bounds")
    out = row.select("row", "rid", "of").join(score, "rid", "left").join(bounds, "of", "left")
    q = [F.coalesce(F.col("q")[i], F.lit(every["q"][i])) for i in range(3)]
    h, margin = -F.col("logp") / F.col("n"), sure * q[2] / F.sqrt("n")
    shift = F.greatest(F.lit(0.0), F.least(F.lit(0.5), F.coalesce("mid", q[2]) - q[2]))
    lower, upper = q[0] - slack, q[1] + shift + slack
    kept = F.coalesce((h <= upper + margin) & (h >= lower - margin), F.lit(False))
    return out.select("row", F.coalesce("n", F.lit(0)).cast("long").alias("n_tokens"), F.exp(h).alias("perplexity"), F.exp(lower).alias("low_bound"), F.exp(upper).alias("high_bound"), kept.alias("kept"))


VERDICT = ("n_tokens", "perplexity", "low_bound", "high_bound", "kept")


def judged(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of scored() as docs with the columns of VERDICT; columns of docs with these names are replaced."""
    keep = [c for c in docs.columns if c.lower() not in VERDICT]
    return scored(docs, labels, **parameters).select(*[F.col(f"row.`{c}`") for c in keep], *VERDICT)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their perplexity and bounds."""
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.where("kept").select("doc_id", "lang", "n_tokens", "perplexity", "low_bound", "high_bound", "kept")
