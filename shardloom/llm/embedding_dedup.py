"""Embedding near-duplicate removal: spherical k-means cells, blocked cosine products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, components, drop_written, groups_by, table, written

SAMPLE = 20_000  # vectors that fit the cells; every vector is assigned and compared
CELL, CELLS_MOST = 2_000, 4_096  # vectors of one label for each cell; cells that a sample of SAMPLE can place
ROWS = 1_024  # vectors whose cosines with all cells are held at a time
BLOCK, BLOCK_MOST, BLOCKS = 1_024, 4_096, 12


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centroids of the unit rows of x, by cosine; an empty cell keeps its centroid."""
    rng = np.random.RandomState(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        length = np.linalg.norm(total, axis=1)
        c[length > 0] = total[length > 0] / length[length > 0, None]
    return c


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length, scaled to unit length in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(centroids: np.ndarray, threshold: float):
    """Each vector goes to its nearest cell, and to each earlier cell that a partner may call home.

    Let x and y have cosine >= threshold, so |x - y| <= chord. If c is nearest to x and h nearest
    to y then (x.h - x.c) <= 0, hence y.h - y.c <= (y - x).(h - c) <= chord |h - c|. Cells that
    fail this test hold no partner of y: the assignment loses no pair.
    """
    chord = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    gap = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            near = _unit(batch.column(3)) @ centroids.T
            home = np.argmax(near, axis=1)
            best = near[np.arange(len(near)), home]
            goes = (best[:, None] - near <= chord * gap[home]) & (np.arange(len(centroids)) < home[:, None])
            goes[np.arange(len(near)), home] = True
            row, cell = np.nonzero(goes)
            t = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cell.astype(np.int32)), pa.array(cell == home[row])], ["vec_id", "label", "n", "embedding", "cell", "home"])

    return run


def _compare(threshold: float):
    """Cosines of one pair of blocks: partial link counts and a spanning forest of the links."""

    def group(t: pa.Table) -> tuple[list, list, list]:
        ids, n = t.column("vec_id").to_numpy(), t.column("n").to_numpy()
        side, home = t.column("block").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        x = _unit(t.column("embedding"))
        a, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        links = np.zeros(len(ids), np.int64)
        forest, u, v = Forest(), [], []
        for i in range(0, len(a), 512):
            rows = a[i : i + 512]
            hit = x[rows] @ x[b].T >= threshold
            hit &= home[rows][:, None] | home[b][None, :]
            if lo == hi:
                hit &= rows[:, None] < b[None, :]
            r, s = np.nonzero(hit)
            r, s = rows[r], b[s]
            np.add.at(links, r, n[s])
            np.add.at(links, s, n[r])
            for p, q in zip(ids[r].tolist(), ids[s].tolist(), strict=True):
                if forest.join(p, q):
                    u.append(p)
                    v.append(q)
        some = np.flatnonzero(links)
        return ids[some].tolist() + u, [None] * len(some) + v, links[some].tolist() + [0] * len(u)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v, links in groups_by("gid", group)(batches):
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(links, pa.int64())], ["u", "v", "links"])

    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.98) -> DataFrame:
    """Link vectors of equal label whose cosine (double precision) is threshold or more.

    vectors needs vec_id (integer), embedding (array of float or double) and label; other
    columns are ignored. Returns one row per input row: vec_id, n_links (other vectors linked
    directly), component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Cells come from spherical k-means on a sample of at most SAMPLE vectors (bounded rows to the
    driver); every vector is then compared in its own cell and in the cells that may hold
    partners (see _assign), so the result does not depend on the sample. Exactly equal vectors
    with equal labels are compared once. Large cells are compared block by block; a task emits
    partial counts and spanning forests, never all pairs.

    Vectors that are null, empty, zero, hold null or non-finite components, have a null label or
    a null vec_id link with nothing; vectors of different lengths do not link. A null vec_id has
    component null and is kept. Rows that repeat a vec_id share its component and count.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    sound = "vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(embedding, v -> v <> 0)"
    valid = vectors.where(sound)
    same = written(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).select("vec_id", "label", "n", "embedding"), "vectors")
    members = written(valid.join(same.select(F.col("vec_id").alias("rep"), "label", F.col("embedding")), ["label", "embedding"]).select("vec_id", "rep"), "members")
    of_label = same.groupBy(F.size("embedding").alias("dim"), "label").agg(F.count("*").alias("m"))
    size = {r["dim"]: r["m"] for r in of_label.groupBy("dim").agg(F.max("m").alias("m")).collect()}
    parts = []
    for dim, m in sorted(size.items()):
        of_dim = same.where(F.size("embedding") == dim)
        sample = of_dim.select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toArrow()
        x = _unit(sample.column(0))
        c = spherical_kmeans(x, max(1, min(CELLS_MOST, len(x), math.ceil(m / CELL))))
        parts.append(of_dim.mapInArrow(_assign(c, threshold), "vec_id long, label " + same.schema["label"].dataType.simpleString() + ", n long, embedding " + same.schema["embedding"].dataType.simpleString() + ", cell int, home boolean").withColumn("dim", F.lit(dim)))
    if not parts:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.union(p)
    placed = written(placed.withColumn("part", F.xxhash64("dim", "label", "cell")), "cells")
    m = placed.groupBy("part").agg(F.count("*").alias("m"))
    nb = F.ceil(F.col("m") / F.least(F.lit(BLOCK_MOST), F.greatest(F.lit(BLOCK), F.ceil(F.col("m") / BLOCKS)))).cast("int")
    sizes = written(m.select("part", nb.alias("nb")), "sizes")
    blocks = placed.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("nb")).cast("int"))
    blocks = blocks.withColumn("with", F.explode(F.expr("sequence(0, nb - 1)"))).withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")})
    blocks = blocks.withColumn("gid", F.xxhash64("part", "lo", "hi")).select("gid", "lo", "hi", "block", "vec_id", "n", "home", "embedding")
    found = written(blocks.repartition("gid").sortWithinPartitions("gid").mapInArrow(_compare(threshold), "u long, v long, links long"), "links")
    label = components(found.where("v is not null").select(F.col("u").alias("a"), F.col("v").alias("b")))
    links = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    reps = same.select(F.col("vec_id").alias("rep"), "n").groupBy("rep").agg(F.sum(F.col("n") - 1).alias("own"))
    reps = reps.join(links, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    reps = written(reps.select("rep", (F.col("own") + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "reps")
    for old in (same, placed, sizes, found):
        drop_written(old)
    of_vec = written(members.join(reps, "rep").groupBy("vec_id").agg(F.sum("links").alias("links"), F.min("component").alias("component")), "of_vec")
    out = vectors.select("vec_id").join(of_vec, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as (
  select a.vec_id as p, b.vec_id as q from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
r(p, q) as (select vec_id, vec_id from v union select r.p, e.q from r join e on r.q = e.p),
m as (select p, min(q) as c from r group by p)
select t.vec_id, (select count(*) from e where e.p = t.vec_id) as n_links, coalesce(m.c, t.vec_id) as component_id, t.vec_id = coalesce(m.c, t.vec_id) as kept
from embeddings t left join m on m.p = t.vec_id
"""
