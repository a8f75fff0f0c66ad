"""MinHash near-duplicate removal by a signature-coordinate inverted join."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Forest, components, drop_since, groups_by, kept_by, mix64, plain, release, scratch_mark, small_batches, table, unused, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
PAIR_LIST = 8  # posting lists up to this length are compared pair by pair before classes form
BLOCK, BLOCK_MOST, BLOCKS = 128, 8192, 24


def match_threshold(similarity: float, k: int) -> int:
    """Coordinates of k that a pair at the similarity shares but for one chance in some millions."""
    return max(1, math.floor(k * similarity - 5 * math.sqrt(k * similarity * (1 - similarity))))


class Shingler:
    """Distinct w-word shingles of a text as sorted unsigned 64-bit hashes."""

    def __init__(self, w: int) -> None:
        self.w, self.known = w, {}

    def words(self, text: str | None) -> np.ndarray:
        known = self.known
        if len(known) > 250_000:
            known.clear()
        out = []
        for x in WORDS.findall((text or "").translate(LOWER)):
            h = known.get(x)
            if h is None:
                h = known[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def of_words(self, h: np.ndarray) -> np.ndarray:
        """With fewer than w words, the whole sequence is the one shingle."""
        w = min(self.w, len(h))
        if not w:
            return h
        n = len(h) - w + 1
        out = np.full(n, np.uint64(len(h) if len(h) < self.w else self.w))
        for i in range(w):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        return np.unique(out)


def _coordinates(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(seed)
    a = r.randint(0, 2**31, k).astype(np.uint64) << np.uint64(33) | r.randint(0, 2**31, k).astype(np.uint64) << np.uint64(2) | np.uint64(1)
    return a, r.randint(0, 2**31, k).astype(np.uint64) << np.uint64(31)


def signatures(docs: DataFrame, shingle: int, k: int, seed: int) -> DataFrame:
    """doc_id, seq (16-byte hash of the word sequence; null without words), n_shingles, sig (k minima)."""
    a, b = _coordinates(k, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("minhash_dedup")
        s = Shingler(shingle)
        for batch in batches:
            seq, n, sig, at = [], [], [], [0]
            for text in (t for i in range(0, batch.num_rows, 500) for t in batch.column(1).slice(i, 500).to_pylist()):
                h = s.words(text)
                x = s.of_words(h)
                n.append(len(x))
                seq.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                if len(x):
                    low = np.full(k, np.uint64(2**64 - 1))
                    for i in range(0, len(x), 4096):
                        np.minimum(low, (x[i : i + 4096, None] * a + b).min(axis=0), out=low)
                    sig.append(low)
                at.append(at[-1] + (k if len(x) else 0))
            flat = pa.array(np.concatenate(sig).view(np.int64) if sig else np.array([], np.int64))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq, pa.binary()), pa.array(n, pa.int64()), lists], ["doc_id", "seq", "n_shingles", "sig"])
        del s
        release()

    return docs.mapInArrow(run, "doc_id long, seq binary, n_shingles long, sig array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (doc_id, class, nb, text) with the whole shingle set as little-endian bytes in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("minhash_dedup")
        s = Shingler(shingle)
        for batch in batches:
            sets = [s.of_words(s.words(t)).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["doc_id", "class", "nb", "set"])
        del s
        release()

    return docs.mapInArrow(run, "doc_id long, class long, nb int, set binary")


def _links(percent: int):
    """Confirm links inside one pair of blocks on the full sets; emit a spanning forest of them.

    Each document's shingles are looked up in an index of the group's shingles, which counts
    the exact intersections with all others at once (no pair is formed that shares nothing).
    """

    def group(t: pa.Table) -> list[tuple[int, int]]:
        ids = t.column("doc_id").to_numpy()
        side = t.column("block").to_numpy()
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        word, code = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(code, kind="stable")
        posting, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(word)))])
        at = np.concatenate([[0], np.cumsum(size)])
        forest, out, n = Forest(), [], len(sets)
        for i in range(n):
            if lo != hi and side[i] != lo:
                continue
            own = code[at[i] : at[i + 1]]
            own = own[start[own + 1] - start[own] > 1]
            if not len(own):
                continue
            both = np.bincount(np.concatenate([posting[start[c] : start[c + 1]] for c in own]), minlength=n)
            fits = 100 * both >= percent * (size + size[i] - both)
            fits[i] = False
            if lo == hi:
                fits[:i] = False
            else:
                fits &= side == hi
            for j in np.flatnonzero(fits):
                if forest.join(int(ids[i]), int(ids[j])):
                    out.append((int(ids[i]), int(ids[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in groups_by("gid", group)(batches):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, k: int = 64, seed: int = 7) -> DataFrame:
    """Classes of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    docs needs doc_id (integer) and text; other columns are ignored. Returns one row per input
    row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Each document's MinHash
    signature is posted under its k (coordinate, value) pairs. A pair at the similarity collides
    in t of k coordinates or more (match_threshold), so
    - a document with fewer than t posts that anyone shares is skipped (no partner can reach t),
    - of its x shared posts only the x - t + 1 rarest are kept: by the pigeonhole principle two
      documents with t collisions meet in one of these prefixes whatever the frequent posts hold.
    Lists of up to PAIR_LIST documents yield pairs, which stay if their signatures agree in t
    coordinates; longer lists yield a star around their smallest document (no pair is lost: both
    ends join one candidate class). Inside a candidate class blocks are compared with blocks on
    the full shingle sets, exactly, and only spanning forests of the links leave a task.

    Equal word sequences are one node throughout (copies are never compared with each other).
    Rows without words link with nothing and form their own component. A null doc_id links with
    nothing: component_id null, kept true. Rows that repeat a doc_id are judged each by its text.
    Texts of any length are read whole; an empty table gives no rows.
    """
    spark, mark = docs.sparkSession, scratch_mark()
    small_batches(spark)
    t = match_threshold(percent / 100, k)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prep = written(signatures(docs, shingle, k, seed), "minhash")
    slim = written(prep.select("doc_id", "seq", "n_shingles"), "sizes")
    reps = written(slim.where("seq is not null and doc_id is not null").groupBy("seq").agg(F.min("doc_id").alias("doc_id")), "reps")
    posts = prep.join(reps, ["seq", "doc_id"]).select("doc_id", F.posexplode("sig").alias("pos", "low")).select("doc_id", F.xxhash64("pos", "low").alias("post"))
    shared = posts.groupBy("post").agg(F.count("*").alias("df")).where("df > 1")
    by_doc = Window.partitionBy("doc_id")
    ranked = posts.join(shared, "post").withColumns({"x": F.count("*").over(by_doc), "r": F.row_number().over(by_doc.orderBy("df", "post"))})
    posting = written(ranked.where(f"x >= {t} and r <= x - {t} + 1").select("post", "doc_id"), "postings")
    lists = written(posting.groupBy("post").agg(F.count("*").alias("m"), F.min("doc_id").alias("first")).where("m > 1"), "lists")
    star = posting.join(lists.where(f"m > {PAIR_LIST}"), "post").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    few = posting.join(lists.where(f"m <= {PAIR_LIST}").select("post"), "post")
    pairs = few.join(few.select("post", F.col("doc_id").alias("other")), "post").where("doc_id < other").select(F.col("doc_id").alias("a"), F.col("other").alias("b")).distinct()
    sig = prep.select("doc_id", "sig").where("sig is not null")
    pairs = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = pairs.where(F.expr(f"size(filter(zip_with(sa, sb, (x, y) -> x = y), z -> z)) >= {t}")).select("a", "b")
    classes = written(components(star.where("a <> b").distinct().union(pairs)), "classes")

    sizes = classes.groupBy(F.col("component").alias("class")).agg(F.count("*").alias("m"))
    nb = F.ceil(F.col("m") / F.least(F.lit(BLOCK_MOST), F.greatest(F.lit(BLOCK), F.ceil(F.col("m") / BLOCKS)))).cast("int")
    sizes = written(sizes.select("class", nb.alias("nb")), "sizes")
    member = written(classes.select(F.col("node").alias("doc_id"), F.col("component").alias("class")).join(sizes, "class").select("doc_id", "class", "nb"), "members")
    sets = written(_sets(docs.join(member, "doc_id").select("doc_id", "class", "nb", "text"), shingle), "sets")
    block = F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int")
    placed = sets.withColumn("block", block).withColumn("with", F.explode(F.expr("sequence(0, nb - 1)")))
    placed = placed.select("doc_id", "set", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "class")
    placed = placed.withColumn("gid", F.xxhash64("class", "lo", "hi"))
    links = written(placed.repartition("gid").sortWithinPartitions("gid").mapInArrow(_links(percent), "a long, b long"), "links")
    label = components(links)
    of_seq = written(reps.join(label, reps.doc_id == label.node, "left").select("seq", F.coalesce("component", "doc_id").alias("of_text")), "labels")
    drop_since(spark, mark, slim, of_seq)
    found = slim.join(of_seq, "seq", "left").withColumn("component_id", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("of_text", "doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **parameters: int) -> DataFrame:
    """docs without near copies: of each component the document with the smallest doc_id stays.

    Of rows that repeat a doc_id all stay or go; rows with a null doc_id stay.
    """
    mark = scratch_mark()
    gone = written(near_duplicates(docs, **parameters).where("not kept").select("doc_id").distinct(), "gone")
    drop_since(docs.sparkSession, mark, gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def one_of_each(docs: DataFrame, **parameters: int) -> DataFrame:
    """docs with one row of each component, null and repeated doc_ids included.

    Nodes are (doc_id, text), not doc_id: of a component the one with the smallest doc_id stays
    (nulls last, then by hash), and of rows with that doc_id and text one. A text that shares
    its doc_id with a removed copy stays. Only texts of repeated rows are shuffled.
    """
    mark = scratch_mark()
    key = unused(docs, "__rid")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    nodes = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), **parameters).select(F.col("doc_id").alias(key), "component_id").distinct()
    rows = keyed.select(key, F.col("doc_id").cast("long").alias("id")).groupBy(key).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(key).alias("key"), "n")).alias("s")
    stay = written(nodes.join(rows, key).groupBy("component_id").agg(first).select(F.col("s.key").alias(key), (F.col("s.n") > 1).alias("many")), "stay")
    drop_since(docs.sparkSession, mark, stay)
    once = keyed.join(stay.where("not many").select(key), key, "left_semi").select(*plain(docs))
    return once.union(keyed.join(stay.where("many").select(key), key, "left_semi").dropDuplicates([key]).select(*plain(docs)))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


OP8_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g from d),
t as (select doc_id, md5(array_to_string(list_sort(g), '|')) as k, len(g) as n, g from s),
rep as (select k, min(doc_id) as doc_id, any_value(n) as n, any_value(g) as g from t where n > 0 group by k),
u as (select doc_id, n, unnest(g) as x from rep),
i as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from u a join u b on a.x = b.x and a.doc_id < b.doc_id
  and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2),
l as (select a, b from i where 100 * c >= 85 * (na + nb - c)),
e as (select a as p, b as q from l union all select b, a from l),
r(p, q) as (select doc_id, doc_id from rep union select r.p, e.q from r join e on r.q = e.p),
m as (select p, min(q) as c from r group by p)
select t.doc_id, cast(t.n as bigint) as n_shingles, coalesce(m.c, t.doc_id) as component_id, t.doc_id = coalesce(m.c, t.doc_id) as kept
from t left join rep using (k) left join m on m.p = rep.doc_id
"""
