"""N-gram Jaccard join: documents whose sets of word shingles overlap by a threshold or more.

Documents of equal sets are one class first. Classes that share a band of min-hash values meet in a bucket. In a few rounds
every class is compared with one chosen class of its buckets; then whatever of a bucket is not yet in one component is compared
in tiles of blocks of bounded size, cut by set size. Hashed signatures thin the tiles out; in a tile, signatures of hashed bits
bound the overlap from above before sorted arrays are intersected exactly. Pairs inside one component are never listed, so
groups of copies cost their size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.components import components
from lattica.llm.tables import drop, keep, small_batches, with_rows_of

WIDTH, PERCENT = 5, 80
#: 32 bands of 3: a pair at Jaccard 0.8 misses all with probability (1 - 0.8^3)^32 = 1e-10.
BANDS, PER_BAND, SEED = 32, 3, 11
BLOCK, STAR_BLOCK, STARS = 256, 256, 2
#: Rows of a tile go on if so many of the low bytes of their min-hash values agree with another row: six standard deviations
#: below what a pair at Jaccard 0.8 has of 96.
AGREE = 53


def _sets(batch: pa.RecordBatch, at: int, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    raw, off = A.string_bytes(batch.column(at))
    for a, b in A.slices(off):
        w = A.Words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        h, o = A.distinct_sets(*A.shingles(w.hashes(), w.row, w.count, width), b - a)
        yield a, b, h, o, w.count


def _sum(values: np.ndarray, o: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (total[o[1:]] - total[o[:-1]]).view(np.int64)


def sketches(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, per_band: int = PER_BAND, seed: int = SEED) -> DataFrame:
    """(doc_id, n, set_a, set_b, keys, signature): size and 128-bit fingerprint of the set of shingles, its band keys, and the low
    bytes of its min-hash values."""

    def run(batches):
        for batch in batches:
            for a, b, h, o, _ in _sets(batch, 1, width):
                hashed = A.minhash(h, o, bands * per_band, seed)
                keys = A.band_keys(hashed, per_band)
                n = np.diff(o)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(_sum(A.mix(h), o)), pa.array(_sum(A.mix(h * A.U(0x9FB21C651E98DF25)), o)), A.list_array(keys[n > 0].ravel(), ends, pa.int64()), A.binary_array(hashed.astype(np.uint8), np.arange(b - a + 1) * hashed.shape[1])], ["doc_id", "n", "set_a", "set_b", "keys", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(A.tidy(run), "doc_id long, n long, set_a long, set_b long, keys array<long>, signature binary")


def sets_of(docs: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, hashes): sorted sets of the documents in ids (doc_id)."""

    def run(batches):
        for batch in batches:
            for a, b, h, o, _ in _sets(batch, 1, width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), A.binary_array(h, o * 8)], ["doc_id", "hashes"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_rows_of(text, ids, "doc_id").select("doc_id", "text").mapInArrow(A.tidy(run), "doc_id long, hashes binary")


def _by_tile(batches, columns: int, tile_of) -> Iterator[pa.RecordBatch]:
    """Calls tile_of(rows) for the rows of each tile; rows come sorted by tile, the first column."""
    tile, held = None, []
    for batch in batches:
        c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        for k in range(batch.num_rows):
            if c[0][k] != tile:
                yield from tile_of(held)
                tile, held = c[0][k], []
            held.append([x[k] for x in c])
    yield from tile_of(held)


def _pairs(side: np.ndarray, comp: np.ndarray, n: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Rows of a tile that row i is to be compared with."""
    j = np.flatnonzero((comp != comp[i]) & ((side != side[i]) | (side[i] == 2) & (np.arange(len(side)) > i)))
    return j[np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j])]


def thinned(tiles: DataFrame, signatures: DataFrame, percent: int = PERCENT, agree: int = AGREE) -> DataFrame:
    """The rows of tiles (tile, doc_id, side, comp) that another row of the tile may be similar to, by size and signature."""

    def tile_of(held):
        if len(held) < 2:
            return
        side, comp, n = (np.array([x[k] for x in held], np.int64) for k in (2, 3, 4))
        sig = np.stack([np.frombuffer(x[5], np.uint8) for x in held])
        stay = np.zeros(len(held), bool)
        for i in np.flatnonzero(side != 1):
            j = _pairs(side, comp, n, i, percent)
            j = j[(sig[j] == sig[i]).sum(1) >= agree]
            stay[j] = True
            stay[i] |= len(j) > 0
        if stay.any():
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x, s in zip(held, stay, strict=True) if s], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["tile", "doc_id", "side", "comp"])

    rows = with_rows_of(signatures, tiles, "doc_id").select("tile", "doc_id", "side", "comp", "n", "signature")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(A.tidy(lambda b: _by_tile(b, 6, tile_of)), "tile long, doc_id long, side int, comp long")


def links(tiles: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) found in tiles (tile, doc_id, side, comp): rows of side 0 are compared with those of side 1, and those of
    side 2 with all. Tiles hold at most a few hundred rows. Rows of equal comp are not compared, and two values of comp get one edge a tile.
    """
    rows = with_rows_of(sets, tiles, "doc_id").select("tile", "doc_id", "side", "comp", "hashes")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(A.tidy(lambda b: _by_tile(b, 5, lambda held: _tile(held, percent))), "a long, b long")


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of hashed bits for each set, in uint64 words; four bits an element of the largest set, at least 64."""
    bits = max(6, int(4 * max(map(len, sets)) - 1).bit_length())
    out = np.zeros((len(sets), 1 << bits - 6), np.uint64)
    for row, h in zip(out, sets, strict=True):
        at = h >> A.U(64 - bits)
        np.bitwise_or.at(row, at >> A.U(6), A.U(1) << (at & A.U(63)))
    return out


def _tile(held: list, percent: int) -> Iterator[pa.RecordBatch]:
    if len(held) < 2:
        return
    side, comp = np.array([x[2] for x in held]), np.array([x[3] for x in held])
    sets = [np.frombuffer(x[4], np.uint64) for x in held]
    n, sig = np.array([len(x) for x in sets]), signatures(sets)
    found, done = [], set()
    for i in np.flatnonzero(side != 1):
        j = _pairs(side, comp, n, i, percent)
        if not len(j):
            continue
        only_i, only_j = np.bitwise_count(sig[i] & ~sig[j]).sum(1), np.bitwise_count(sig[j] & ~sig[i]).sum(1)
        most = np.minimum(n[i] - only_i.astype(np.int64), n[j] - only_j.astype(np.int64))
        for k in j[most * (100 + percent) >= percent * (n[i] + n[j])]:
            pair = (comp[i], comp[k])
            if pair in done:
                continue
            both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if 100 * both >= percent * (n[i] + n[k] - both):
                done |= {pair, pair[::-1]}
                found.append((held[i][1], held[k][1]))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])


def _star(met: DataFrame, turn: int) -> DataFrame:
    """Tiles of each row of met (key, doc_id, comp) and the class chosen in one of its buckets, the one that it meets most often."""
    w = Window.partitionBy("key")
    order = F.struct(*([] if not turn else [F.xxhash64("doc_id", F.lit(turn)).alias("h")]), F.col("doc_id").alias("first"), F.col("comp").alias("at"))
    other = met.withColumn("x", F.min(order).over(w)).select("doc_id", "comp", "x.first", "x.at").where("comp <> at")
    best = other.groupBy("doc_id", "comp", "first", "at").agg(F.count("*").alias("k")).groupBy("doc_id", "comp").agg(F.max(F.struct("k", (-F.col("first")).alias("f"), "at")).alias("x"))
    best = best.select("doc_id", "comp", (-F.col("x.f")).alias("first"), "x.at")
    blocks = best.join(best.groupBy("first").agg(F.ceil(F.count("*") / STAR_BLOCK).alias("blocks")), "first").select("first", "at", "doc_id", "comp", F.xxhash64("first", F.expr("pmod(xxhash64(doc_id), blocks)")).alias("tile"))
    centre = blocks.select("tile", F.col("first").alias("doc_id"), F.lit(0).alias("side"), F.col("at").alias("comp")).distinct()
    return centre.unionByName(blocks.select("tile", "doc_id", F.lit(1).alias("side"), "comp"))


def _labelled(met: DataFrame, found: DataFrame) -> DataFrame:
    return met.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp"))


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, per_band: int = PER_BAND) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    A null, empty or blank text has no set and links with nothing; so does a row whose doc_id is null, which is kept. Rows
    repeated whole stay as many. Other columns are ignored. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    s = keep(sketches(docs, width, bands, per_band), "sketches")
    known = s.where("n > 0 and doc_id is not null")
    same = ["set_a", "set_b", "n"]
    reps = known.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    members = keep(known.select("doc_id", *same).join(reps, same).select("doc_id", "rep").distinct(), "members")
    chosen = known.join(members.where("doc_id = rep").select("doc_id"), "doc_id")
    rows = chosen.select("doc_id", "n", F.explode(F.array_distinct("keys")).alias("key"))
    met = rows.withColumn("all", F.count("*").over(Window.partitionBy("key"))).where("all > 1").drop("all")
    met = keep(met, "buckets")
    sets = keep(sets_of(docs, met.select("doc_id").distinct(), width), "sets")

    near, found = None, None
    for turn in range(STARS):
        now = met.withColumn("comp", F.col("doc_id")) if found is None else _labelled(met, found)
        tiles = keep(_star(now, turn), "tiles")
        new = keep(links(tiles, sets, percent), "links")
        drop(tiles)
        near = new if near is None else near.unionByName(new)
        found = keep(components(near), "components")

    # what a bucket holds beside its largest component, in blocks by size
    at = _labelled(met, found)
    share = at.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "comp")).alias("x"), F.count("*").alias("comps"))
    mixed = at.join(share.where("comps > 1").select("key", F.col("x.comp").alias("main")), "key").withColumn("stray", F.col("comp") != F.col("main"))
    cut = keep(mixed.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("key", "stray").orderBy("n", "doc_id")) - 1) / BLOCK) * 2 + F.col("stray").cast("int")), "blocks")
    of = cut.groupBy("key", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.expr("bit_xor(xxhash64(doc_id, comp))").alias("mark"), F.count("*").alias("rows"))
    i, j = of.select("key", *(F.col(c).alias(f"{c}_i") for c in of.columns[1:])), of.select("key", *(F.col(c).alias(f"{c}_j") for c in of.columns[1:]))
    pairs = i.join(j, "key").where(f"block_i <= block_j and most_i * 100 >= {percent} * least_j and most_j * 100 >= {percent} * least_i and not (lo_i = hi_i and lo_j = hi_j and lo_i = lo_j)")
    once = pairs.groupBy("mark_i", "mark_j", "rows_i", "rows_j").agg(F.min(F.struct("key", "block_i", "block_j")).alias("x")).select("x.*")
    once = keep(once, "pairs")
    tile = F.xxhash64("key", "block_i", "block_j").alias("tile")
    left = once.withColumn("block", F.col("block_i")).join(cut, ["key", "block"]).select(tile, "doc_id", F.when(F.col("block_i") == F.col("block_j"), 2).otherwise(0).alias("side"), "comp")
    right = once.where("block_i < block_j").withColumn("block", F.col("block_j")).join(cut, ["key", "block"]).select(tile, "doc_id", F.lit(1).alias("side"), "comp")
    tiles = keep(left.unionByName(right), "tiles")
    thin = keep(thinned(tiles, chosen.select("doc_id", "n", "signature"), percent), "thin")
    more = keep(links(thin, sets, percent), "links")
    final = components(near.unionByName(more)) if more.limit(1).count() else found
    label = members.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = s.select("doc_id", F.col("n").alias("n_shingles")).join(label, "doc_id", "left")
    out = keep(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "result")
    for table in (s, members, met, sets, tiles, cut, once, thin):
        drop(table)
    return out
