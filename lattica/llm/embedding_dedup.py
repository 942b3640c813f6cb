"""Near-duplicate embeddings by binary codes of randomised rotations.

Each distinct vector is rotated at random; the signs are its code, and the inner product of the rotated unit vector with its
code, scaled to unit length, is stored as correction factor. Slices of the signs of several rotations are the keys of hash
tables in which similar vectors meet. For vectors that meet, code and factor give an unbiased estimate of the cosine with a
confidence bound; only pairs whose bound reaches the threshold are computed exactly, in double precision.
"""

from __future__ import annotations

import math
from functools import lru_cache
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.components import components
from lattica.llm.tables import drop, keep

THRESHOLD, SEED, BLOCK = 0.93, 5, 128
#: A pair at the threshold meets in no table with at most this probability; it also bounds the share of wrong estimates.
MISS = 1e-6
#: Half-width of the confidence interval in standard errors of the estimate.
SIGMAS = 5.0


def plan(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits of a key, tables): keys get longer with the number of vectors, tables follow from MISS."""
    bits = min(48, max(12, math.ceil(math.log2(max(vectors, 2)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


@lru_cache(8)
def rotations(dim: int, n: int, seed: int = SEED) -> np.ndarray:
    """n random rotations side by side, (dim, n * dim)."""
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    return np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)])


def encode(unit: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs, correction factors and rotated vectors, of the first rotation."""
    turned = unit @ rotations(unit.shape[1], 1, seed)
    return turned >= 0, np.abs(turned).sum(1) / math.sqrt(unit.shape[1]), turned


def estimate(signs: np.ndarray, factor: np.ndarray, query: np.ndarray, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (codes, queries) and the half-width of their confidence intervals; query is rotated, of unit length."""
    d = signs.shape[1]
    at = np.where(signs, 1.0, -1.0) @ query.T / math.sqrt(d) / factor[:, None]
    return at, np.broadcast_to(sigmas * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(d - 1, 1))[:, None], at.shape)


def table_keys(unit: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables) keys, slices of the signs of as many rotations as are needed."""
    dim = unit.shape[1]
    signs = np.hstack([unit @ r >= 0 for r in np.split(rotations(dim, math.ceil(bits * tables / dim), seed + 1), math.ceil(bits * tables / dim), 1)])
    return signs[:, : bits * tables].reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _unit(rows: list) -> np.ndarray:
    v = np.stack(rows)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def embedding_components(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of embeddings (vec_id, embedding, label).

    Only vectors of equal label and length are compared. A vector that is null, empty or all zero, or holds null or
    non-finite components, links with nothing, as does one whose label or vec_id is null. Rows with the same vec_id, label
    and vector are one vector. An empty table gives an empty one; other columns are ignored.
    """
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("label"))
    fine = "vec_id is not null and label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    good = e.where(fine).groupBy("label", "v", "vec_id").agg(F.lit(1).alias("one"))
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = keep(classes.select("rep", "copies", F.xxhash64("label", F.size("v")).alias("grp"), "label", "v"), "vectors")
    bits, tables = plan(classes.count(), threshold)

    def keys(batches):
        for batch in batches:
            vec = [np.asarray(x) for x in batch.column(2).to_numpy(zero_copy_only=False)]
            size = np.array([len(x) for x in vec])
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                k = table_keys(_unit([vec[r] for r in rows]), bits, tables)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(4)), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables), pa.array(k.ravel()))], ["rep", "grp", "v", "copies", "keys"])

    # keys are computed once and go along with the vectors: a product of another shape may round a sign the other way
    found = keep(classes.select("rep", "grp", "v", "copies").mapInArrow(A.tidy(keys), "rep long, grp long, v array<double>, copies long, keys array<long>"), "keys")
    at = found.select("rep", "grp", F.posexplode("keys").alias("no", "key"))
    w = Window.partitionBy("no", "grp", "key")
    met = at.withColumns({"all": F.count("*").over(w), "row": F.row_number().over(w.orderBy("rep"))}).where("all > 1")
    cut = keep(met.select("no", F.xxhash64("no", "grp", "key").alias("bucket"), "rep", F.floor((F.col("row") - 1) / BLOCK).alias("block")), "buckets")
    of = cut.groupBy("no", "bucket", "block").agg(F.expr("bit_xor(xxhash64(rep))").alias("mark"), F.count("*").alias("rows"))
    i, j = of.selectExpr("no", "bucket", "block i", "mark mi", "rows ri"), of.selectExpr("bucket", "block j", "mark mj", "rows rj")
    once = i.join(j, "bucket").where("i <= j").groupBy("mi", "mj", "ri", "rj").agg(F.min(F.struct("no", "bucket", "i", "j")).alias("x")).select("x.*")
    once = keep(once.where("true"), "tiles")
    tile, rows = F.xxhash64("bucket", "i", "j").alias("tile"), cut.drop("no")
    left = once.withColumn("block", F.col("i")).join(rows, ["bucket", "block"]).select(tile, "no", "rep", F.when(F.col("i") == F.col("j"), 2).otherwise(0).alias("side"))
    right = once.where("i < j").withColumn("block", F.col("j")).join(rows, ["bucket", "block"]).select(tile, "no", "rep", F.lit(1).alias("side"))
    earlier = F.slice("keys", F.lit(1), F.col("no")).alias("keys")
    full = left.unionByName(right).join(found.select("rep", "copies", "v", "keys"), "rep").select("tile", "no", "side", "rep", "copies", "v", earlier)

    def compare(batches):
        now, held = None, []
        for batch in batches:
            c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            for k in range(batch.num_rows):
                if c[0][k] != now:
                    yield from _tile(held, threshold)
                    now, held = c[0][k], []
                held.append([c[m][k] for m in range(1, 7)])
        yield from _tile(held, threshold)

    part = full.repartition("tile").sortWithinPartitions("tile").mapInArrow(A.tidy(compare), "rep long, links long, root long")
    part = keep(part, "links")
    label = components(part.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = part.groupBy("rep").agg(F.sum("links").alias("links"))
    per = classes.select("rep", "copies", "label", "v").join(links, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    per = per.select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = e.where(fine).join(per, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = e.where(f"not coalesce({fine}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = keep(linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id")), "result")
    for table in (found, cut, once, part):
        drop(table)
    return out


def _tile(held: list, threshold: float) -> Iterator[pa.RecordBatch]:
    if len(held) < 2:
        return
    no, side, rep, copies = held[0][0], np.array([x[1] for x in held]), np.array([x[2] for x in held]), np.array([x[3] for x in held])
    unit = _unit([np.asarray(x[4]) for x in held])
    signs, factor, turned = encode(unit)
    at, width = estimate(signs, factor, turned)
    pair = (at + width >= threshold) & (side[:, None] != 1) & ((side[:, None] != side) | (side[:, None] == 2) & (np.arange(len(held))[:, None] < np.arange(len(held))))
    i, j = np.nonzero(pair)
    ok = (unit[i] * unit[j]).sum(1) >= threshold
    i, j = i[ok], j[ok]
    if no and len(i):  # a pair counts in the first table where it meets
        k = np.stack([np.asarray(x[5]) for x in held])
        new = ~(k[i] == k[j]).any(1)
        i, j = i[new], j[new]
    if not len(i):
        return
    links = np.bincount(i, copies[j], len(held)) + np.bincount(j, copies[i], len(held))
    root = rep.copy()
    while True:  # smallest vector that links inside the tile lead to
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, new[i])
        if (new == root).all():
            break
        root = new
    rows = np.flatnonzero(links > 0)
    yield pa.RecordBatch.from_arrays([pa.array(rep[rows].astype(np.int64)), pa.array(links[rows].astype(np.int64)), pa.array(root[rows].astype(np.int64))], ["rep", "links", "root"])
