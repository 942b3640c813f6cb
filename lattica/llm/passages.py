"""Substring dedup: passages that repeat within and across documents.

Texts are cut at line ends and sentence ends into paragraphs' pieces of five words or more, so that a passage put into the
middle of a line is still found. Pieces with equal sets of word shingles are one class; small sets that differ by one shingle
are found by keys of the set without each of its shingles. Longer pieces are also banded by min-hash, colliding ones verified by
exact Jaccard similarity, first with the smallest of their bucket, then whatever of a bucket is not yet in one component, and
joined to components. Runs of repeated pieces that are long enough count as repeated passages; of each class the first piece
stays and the others are to be removed.

Stretches of 50 words and more that stand elsewhere word by word are found exactly, wherever sentences and lines end. The least
hash of the short windows inside a long one is its anchor; equal long windows have equal anchors, so only those whose anchor
occurs twice are compared, and each repeated one points at its first place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.components import components
from lattica.llm.ngram_join import PERCENT, WIDTH, _sum, links
from lattica.llm.tables import BROADCAST_BYTES, drop, keep, release, small_batches, with_rows_of

#: A run of repeated pieces counts from so many words on; pieces of so many shingles are banded.
RUN_WORDS, BANDED = 25, 8
#: A pair at Jaccard 0.8 misses all bands with probability (1 - 0.8^3)^10 = 8e-4, one at 0.9 with 2e-6.
BANDS, PER_BAND, SEED = 10, 3, 41
BLOCK = 256
#: Parts that the stretches with one first place are dealt into.
PARTS = 16
#: Words of the windows that are compared exactly, and of the windows that their anchors are chosen from.
EXACT_WORDS, ANCHOR_WORDS = 50, 16
#: Sets of so many shingles at 0.8 and more to a smaller one hold all of it and one shingle besides; they are found by equal keys.
LEAST_SUB, MOST_SUB = 5, 8
#: Bits of the table of repeated anchors: eight an anchor, within these powers of two. A full table only lets more windows through.
FEWEST_BITS, MOST_BITS = 16, 29


def cut_pieces(w: A.Words) -> tuple[np.ndarray, np.ndarray]:
    """(piece of each word, first word of each piece): pieces end with a line, or with a word that ends in '.', '!' or '?'."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = np.concatenate([[0], np.cumsum(w.raw == 10)])
    ends = np.isin(w.raw[w.end - 1], np.frombuffer(b".!?", np.uint8))
    ends[:-1] |= (w.row[1:] != w.row[:-1]) | (lines[w.start[1:]] != lines[w.end[:-1]])
    piece = np.concatenate([[0], np.cumsum(ends[:-1])])
    return piece, np.flatnonzero(np.concatenate([[True], ends[:-1]]))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key): a row is known by its id and a hash of its text, as ids may repeat with other texts."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.where("doc_id is not null").withColumn("text_key", F.xxhash64("text"))


def pieces(docs: DataFrame, width: int = WIDTH, banded_only: bool = False) -> DataFrame:
    """(doc_id, text_key, no, start, stop, words, fp, prev, gap, subs) of each piece of `width` words or more; start and stop are bytes,
    prev is the no of the one before it (-1 if none) and gap a hash of the shorter pieces between; subs has the fp of a small set
    without one of its shingles each, at its first place in a slice. banded_only: (fp, keys) of those banded.
    """

    def run(batches):
        for batch in batches:
            raw, off = A.string_bytes(batch.column(1))
            ids = batch.column(0)
            for a, b in A.slices(off):
                w = A.Words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                piece, first = cut_pieces(w)
                if not len(first):
                    continue
                count = np.bincount(piece)
                h, o = A.distinct_sets(*A.shingles(w.hashes(), piece, count, width), len(count))
                n = np.diff(o)
                fp = _sum(A.mix(h), o) ^ n
                take = np.flatnonzero((count >= width) & ((n >= BANDED) | (not banded_only)))
                row = w.row[first]
                no = np.arange(len(first)) - np.searchsorted(row, row)
                if banded_only:
                    take = take[np.unique(fp[take], return_index=True)[1]]
                    flat = np.concatenate([h[o[k] : o[k + 1]] for k in take]) if len(take) else np.zeros(0, np.uint64)
                    keys = A.band_keys(A.minhash(flat, np.concatenate([[0], np.cumsum(n[take])]), BANDS * PER_BAND, SEED), PER_BAND)
                    yield pa.RecordBatch.from_arrays([pa.array(fp[take]), A.list_array(keys.ravel(), np.arange(len(take) + 1) * BANDS, pa.int64())], ["fp", "keys"])
                    continue
                base = off[a] - off[a:b]
                place = np.arange(len(count)) - np.maximum.accumulate(np.where(count >= width, np.arange(len(count)), -1))
                short = np.where(count < width, A.mix(fp.view(np.uint64) + A.mix(place.astype(np.uint64))), A.U(0))
                gap = _sum(short, np.append(np.concatenate([[0], take[:-1]]), take[-1])) if len(take) else np.zeros(0, np.int64)
                prev = np.where(np.concatenate([[False], row[take[1:]] == row[take[:-1]]]), np.concatenate([[-1], no[take[:-1]]]), -1) if len(take) else gap
                stop = w.end[first + count - 1]
                few = np.zeros(len(n), bool)
                few[take[np.unique(fp[take], return_index=True)[1]]] = True
                few &= (n >= LEAST_SUB) & (n <= MOST_SUB)
                of = np.repeat(np.arange(len(n)), n)
                in_few = few[of]
                of, sub = of[in_few], A.mix(h[in_few])
                sub = ((fp[of] ^ n[of]).view(np.uint64) - sub).view(np.int64) ^ (n[of] - 1)
                subs = A.list_array(sub, np.concatenate([[0], np.cumsum(np.where(few, n, 0)[take])]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row[take] + a)), batch.column(2).take(pa.array(row[take] + a)), pa.array(no[take].astype(np.int32)), pa.array((w.start[first] + base[row])[take]), pa.array((stop + base[row])[take]), pa.array(count[take].astype(np.int32)), pa.array(fp[take]), pa.array(prev.astype(np.int32)), pa.array(gap), subs],
                    ["doc_id", "text_key", "no", "start", "stop", "words", "fp", "prev", "gap", "subs"],
                )

    return _texts(docs).mapInArrow(A.tidy(run), "fp long, keys array<long>" if banded_only else "doc_id long, text_key long, no int, start long, stop long, words int, fp long, prev int, gap long, subs array<long>")


def _sets(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(doc_id, hashes) with the class in place of doc_id, for places (fp, doc_id, text_key, start, stop)."""

    def run(batches):
        for batch in batches:
            raw, off = A.string_bytes(batch.column(3))
            s, e = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cut = [raw[off[k] + s[k] : off[k] + e[k]] for k in range(batch.num_rows)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)
            w = A.Words(np.concatenate(cut) if cut else raw[:0], ends)
            h, o = A.distinct_sets(*A.shingles(w.hashes(), w.row, w.count, width), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), A.binary_array(h, o * 8)], ["doc_id", "hashes"])

    return with_rows_of(_texts(docs), places, ["doc_id", "text_key"]).select("fp", "start", "stop", "text").mapInArrow(A.tidy(run), "doc_id long, hashes binary")


def _left(met: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Tiles of what the buckets met (key, fp) hold beside their largest component, in blocks by size, with all else of them."""
    size = sets.select(F.col("doc_id").alias("fp"), F.expr("octet_length(hashes) div 8").alias("n"))
    at = met.join(found, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("comp"))
    share = at.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "comp")).alias("x"), F.count("*").alias("comps"))
    mixed = at.join(share.where("comps > 1").select("key", F.col("x.comp").alias("main")), "key").join(size, "fp").withColumn("stray", F.col("comp") != F.col("main"))
    order = Window.partitionBy("key", "stray").orderBy("n", "fp")
    cut = keep(mixed.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK) * 2 + F.col("stray").cast("int")), "blocks")
    of = cut.groupBy("key", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.expr("bit_xor(xxhash64(fp, comp))").alias("mark"), F.count("*").alias("rows"))
    i, j = of.select("key", *(F.col(c).alias(f"{c}_i") for c in of.columns[1:])), of.select("key", *(F.col(c).alias(f"{c}_j") for c in of.columns[1:]))
    pairs = i.join(j, "key").where(f"block_i <= block_j and most_i * 100 >= {percent} * least_j and most_j * 100 >= {percent} * least_i and not (lo_i = hi_i and lo_j = hi_j and lo_i = lo_j)")
    once = keep(pairs.groupBy("mark_i", "mark_j", "rows_i", "rows_j").agg(F.min(F.struct("key", "block_i", "block_j")).alias("x")).select("x.*"), "once")
    tile = F.xxhash64("key", "block_i", "block_j").alias("tile")
    first = once.withColumn("block", F.col("block_i")).join(cut, ["key", "block"]).select(tile, F.col("fp").alias("doc_id"), F.when(F.col("block_i") == F.col("block_j"), 2).otherwise(0).alias("side"), "comp")
    second = once.where("block_i < block_j").withColumn("block", F.col("block_j")).join(cut, ["key", "block"]).select(tile, F.col("fp").alias("doc_id"), F.lit(1).alias("side"), "comp")
    return first.unionByName(second)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` neighbouring values of h."""
    size, out, at = 1, None, 0
    while True:
        if width & size:
            out = h if out is None else A.mix(out[: len(h) - at] * A._MIX1 + h[at:])
            at += size
        if size * 2 > width:
            return out
        h = A.mix(h[:-size] * A._MIX2 + h[size:])
        size *= 2


def slide(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """f, the least or the greatest, of each `width` neighbouring values of x."""
    size = 1
    while size * 2 <= width:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _anchored(batch: pa.RecordBatch, width: int, part: int):
    """(first row, words, whether each window of `width` words is inside a row, their anchors, word hashes, hashes of the parts)."""
    raw, off = A.string_bytes(batch.column(0))
    for a, b in A.slices(off):
        w = A.Words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        h = w.hashes()
        if len(h) >= width:
            g = windows(h, part)
            yield a, w, w.row[: len(h) - width + 1] == w.row[width - 1 :], slide(np.minimum, g, width - part + 1), h, g


SHORT = 6  # bytes of a window's hash, as only windows of one anchor are compared


def _first_places(batches):
    """(cid, o, n, first_doc, first_pos): n windows from the o-th on of a class, which stand elsewhere too, and the first place of the
    first of them; those of the next ones follow. Rows (v, cid, doc_id, pos, windows) come by their anchor v; classes of an
    anchor that goes on in the next batch are carried over, each once, with the number of its rows.
    """
    held = None
    for batch in batches:
        c = [batch.column(k).to_numpy() for k in range(4)]
        off = np.frombuffer(batch.column(4).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(4).offset).astype(np.int64) // SHORT
        raw = np.frombuffer(batch.column(4).buffers()[2] or b"", np.uint8)
        rows = (*c, np.ones(len(c[0]), np.int64), off[:-1], off[1:] - off[:-1])
        raw = raw[: len(raw) // SHORT * SHORT].reshape(-1, SHORT)
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held[0], (*rows[:5], rows[5] + len(held[1]), rows[6]), strict=True))
            raw = np.concatenate([held[1], raw])
        v, cid, doc, pos, n, at, size = rows
        order = np.lexsort((pos, doc, cid, v))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(v[order]) != 0) | (np.diff(cid[order]) != 0)])) if len(v) else order
        pick = order[new]
        n = np.add.reduceat(n[order], new) if len(v) else n
        v, cid, doc, pos, at, size = (x[pick] for x in (v, cid, doc, pos, at, size))
        last = v == v[-1] if len(v) else np.zeros(0, bool)
        yield from _repeated(v[~last], cid[~last], doc[~last], pos[~last], n[~last], at[~last], size[~last], raw)
        own = A.ragged(at[last], size[last])
        held = (v[last], cid[last], doc[last], pos[last], n[last], np.cumsum(size[last]) - size[last], size[last]), raw[own]
    if held is not None:
        yield from _repeated(*held[0], held[1])


def _repeated(v, cid, doc, pos, n, at, size, raw):
    """What _first_places() gives for whole anchors, the classes of which come by v."""
    if not len(v):
        return
    group = np.cumsum(np.concatenate([[0], np.diff(v) != 0]))
    more = (np.bincount(group)[group] > 1) | (n > 1) | (size > 1)
    order = np.flatnonzero(more)
    order = order[np.lexsort((pos[order], doc[order], group[order]))]
    for part in np.split(order, np.flatnonzero(np.diff(group[order] >> 16)) + 1):  # windows of 48 bits and 16 bits of an anchor's number
        if not len(part):
            continue
        size_ = size[part]
        row, place = np.repeat(part, size_), A.ragged(np.zeros(len(part), np.int64), size_)
        key = np.zeros((len(row), 8), np.uint8)
        key[:, :SHORT] = raw[A.ragged(at[part], size_)]
        key = key.view(np.uint64).ravel() | (group[row] & 0xFFFF).astype(np.uint64) << A.U(48)
        by = np.argsort(key, kind="stable")
        start = np.concatenate([[True], key[by[1:]] != key[by[:-1]]])
        run = np.cumsum(start) - 1
        total, lead = np.add.reduceat(n[row[by]], np.flatnonzero(start)), by[start]
        first, often = np.empty(len(row), np.int64), np.empty(len(row), bool)
        first[by], often[by] = lead[run], (total > 1)[run]
        k = np.flatnonzero(often)
        if not len(k):
            continue
        first_doc, first_pos = doc[row[first[k]]], (pos[row] + place)[first[k]]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(k) != 1) | (np.diff(row[k]) != 0) | (np.diff(first_doc) != 0) | (np.diff(first_pos) != 1)]))
        cols = [cid[row[k[new]]], place[k[new]], np.diff(np.append(new, len(k))), first_doc[new], first_pos[new]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["cid", "o", "n", "first_doc", "first_pos"])


def _bitmap(hot: DataFrame) -> np.ndarray:
    """A table of bits, one set for each v of hot, at its highest bits."""
    bits = min(max(FEWEST_BITS, (8 * hot.count()).bit_length()), MOST_BITS)
    at = F.shiftrightunsigned("v", 64 - bits)
    rows = hot.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(v, {64 - bits}) & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
    return out


def exact_passages(docs: DataFrame, width: int = EXACT_WORDS, part: int = ANCHOR_WORDS) -> DataFrame:
    """Stretches of docs (doc_id, text) of which each `width` words stand elsewhere too, in the columns of repeated_passages.

    A stretch is cut where the first places of its windows do not follow each other. Those that are first places themselves are
    kept; class_id names the kept stretch that a stretch is inside of, so of each repeated window one place is kept.
    """
    text = _texts(docs).select("text", "doc_id", "text_key")

    def anchors(batches):
        for batch in batches:
            for _, _, inside, least, _, g in _anchored(batch, width, part):
                pad = np.zeros(width - part, np.uint64)
                most = slide(np.maximum, np.concatenate([pad, np.where(inside, least, A.U(0)), pad]), width - part + 1)
                v, n = np.unique(g[g == most], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], ["v", "n"])

    hot = keep(text.select("text").mapInArrow(A.tidy(anchors), "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).where("n > 1").select("v"), "anchors")
    table = _bitmap(hot)
    drop(hot)
    release(docs.sparkSession)
    shift, shared = A.U(64 - (len(table) * 64 - 1).bit_length()), docs.sparkSession.sparkContext.broadcast(table)

    def places(batches, hashes: bool):
        for batch in batches:
            for a, w, inside, least, h, _ in _anchored(batch, width, part):
                bit = least >> shift
                at = np.flatnonzero(inside & ((shared.value[bit >> A.U(6)] >> (bit & A.U(63)) & A.U(1)) > 0))
                if not len(at):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (w.row[at[1:]] != w.row[at[:-1]])]))
                o, x, first = np.append(new, len(at)), windows(h, width)[at], at[new]
                of, row = np.repeat(first, np.diff(o)), w.row[first]
                base = w.offsets[row]
                place = np.arange(len(at)) - np.repeat(new, np.diff(o))
                cid = _sum(A.mix(x + A.mix(place.astype(np.uint64))), o)
                ids, pos = batch.column(1).take(pa.array(row + a)), pa.array(first - np.searchsorted(w.row, row))
                if hashes:
                    short = A.binary_array(x.view(np.uint8).reshape(-1, 8)[:, :SHORT], o * SHORT)
                    yield pa.RecordBatch.from_arrays([pa.array(least[first].view(np.int64)), pa.array(cid), ids, pos, short], ["v", "cid", "doc_id", "pos", "windows"])
                    continue
                ends = [A.list_array(y - w.start[of], o, pa.int32()) for y in (w.start[at], w.end[at + width - 1])]
                cols = [pa.array(cid), ids, batch.column(2).take(pa.array(row + a)), pos, pa.array(w.start[first] - base), *ends]
                yield pa.RecordBatch.from_arrays(cols, ["cid", "doc_id", "text_key", "pos", "base", "starts", "stops"])

    same = text.mapInArrow(A.tidy(lambda b: places(b, True)), "v long, cid long, doc_id long, pos long, windows binary")
    found = text.mapInArrow(A.tidy(lambda b: places(b, False)), "cid long, doc_id long, text_key long, pos long, base long, starts array<int>, stops array<int>")

    parts = keep(same.repartition("v").sortWithinPartitions("v").mapInArrow(A.tidy(_first_places), "cid long, o long, n long, first_doc long, first_pos long"), "firsts")
    release(docs.sparkSession)
    met = with_rows_of(found, parts, "cid")
    place = F.col("pos") + F.col("o")
    met = met.select("doc_id", "text_key", place.alias("pos"), "n", (F.col("base") + F.expr("starts[int(o)]")).alias("start"), (F.col("base") + F.expr("stops[int(o + n - 1)]")).alias("stop"), "first_doc", "first_pos")
    met = met.groupBy(*met.columns).agg(F.count("*").alias("rows"))  # rows repeated whole
    w = Window.partitionBy("doc_id", "text_key").orderBy("pos")
    follows = (F.lag(F.col("pos") + F.col("n")).over(w) == F.col("pos")) & (F.lag("first_doc").over(w) == F.col("first_doc")) & (F.lag(F.col("first_pos") + F.col("n")).over(w) == F.col("first_pos"))
    runs = met.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("doc_id", "text_key", "run").agg(F.min("pos").alias("pos"), F.sum("n").alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_doc").alias("first_doc"), F.min("first_pos").alias("first_pos"), F.max("rows").alias("rows"))
    runs = runs.withColumn("kept", (F.col("doc_id") == F.col("first_doc")) & (F.col("pos") == F.col("first_pos")))
    # the kept stretch that a first place is in, from the distinct places, as one place may be the first of very many
    runs = keep(runs, "runs")
    spots = runs.groupBy("first_doc", "first_pos").agg(F.max("kept").alias("kept"), F.sum("rows").alias("rows"))
    name = F.last(F.when(F.col("kept"), F.xxhash64("first_doc", "first_pos", F.lit(width))), True)
    spots = spots.withColumn("class_id", name.over(Window.partitionBy("first_doc").orderBy("first_pos").rowsBetween(Window.unboundedPreceding, 0)))
    spots = keep(spots.withColumn("copies", F.sum("rows").over(Window.partitionBy("first_doc", "class_id"))).select("first_doc", "first_pos", "class_id", "copies"), "spots")
    # each stretch takes them over from its first place; that of very many is there once a part of them
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    both = runs.withColumn("part", part).unionByName(spots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), True)
    at = Window.partitionBy("first_doc", "first_pos", "part")
    out = both.withColumns({"class_id": F.max("class_id").over(at), "copies": F.max("copies").over(at)}).where("doc_id is not null")
    out = keep(out.select("doc_id", "text_key", "start", "stop", (F.col("n") + width - 1).cast("int").alias("words"), "class_id", "first_doc", "copies", "kept"), "exact")
    for table in (parts, runs, spots):
        drop(table)
    shared.destroy()
    release(docs.sparkSession)
    return out


def repeated_passages(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, run_words: int = RUN_WORDS) -> DataFrame:
    """The pieces of repeated passages of docs (doc_id, text): (doc_id, text_key, start, stop, words, class_id, first_doc, copies,
    kept). Besides, in the same columns, the stretches that exact_passages finds; they may overlap pieces.

    text_key is the xxhash64 of the text, which tells rows of one doc_id apart; start and stop are byte offsets; class_id names the component of similar pieces, first_doc the document with its first
    piece, which is kept; copies counts the class. Documents without a repeated passage have no row; so have null or empty
    texts and rows whose doc_id is null. Rows repeated whole count as copies of the first in ties. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    exact = exact_passages(docs)
    p = keep(pieces(docs, width), "pieces")
    near = pieces(docs, width, True).select("fp", F.explode(F.array_distinct("keys")).alias("key"))
    w = Window.partitionBy("key")
    met = near.withColumn("low", F.min("fp").over(w)).withColumn("high", F.max("fp").over(w)).where("low <> high")
    met = keep(met.select("key", "fp", "low").distinct(), "buckets")
    pairs = keep(met.where("fp <> low").select("fp", "low").distinct(), "pairs")
    release(docs.sparkSession)
    ids = met.select("fp").distinct()
    stats = keep(p.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start", "stop")).alias("at")), "classes")
    places = keep(stats.join(ids, "fp").select("fp", "at.doc_id", "at.text_key", "at.start", "at.stop"), "places")
    sets = keep(_sets(docs, places, width), "sets")
    blocks = pairs.join(pairs.groupBy("low").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "low").select("low", "fp", F.xxhash64("low", F.expr("pmod(xxhash64(fp), blocks)")).alias("tile"))
    tile = lambda c, side: blocks.select("tile", F.col(c).alias("doc_id"), F.lit(side).alias("side"), F.col(c).alias("comp"))
    n = F.size("subs")
    small = p.where((n > 0) & ((n - 1) * 100 >= percent * n)).select("fp", F.explode("subs").alias("sub")).distinct()
    small = keep(small.join(stats.select(F.col("fp").alias("sub")), "sub").select(F.col("fp").alias("a"), F.col("sub").alias("b")), "small")
    edges = keep(links(keep(tile("low", 0).distinct().unionByName(tile("fp", 1)), "tiles"), sets, percent).unionByName(small), "links")
    found = keep(components(edges).withColumnRenamed("node", "fp"), "components")
    left = keep(_left(met, found, sets, percent), "tiles")
    more = keep(links(left, sets, percent), "links")
    if more.limit(1).count():
        found = keep(components(edges.unionByName(more)).withColumnRenamed("node", "fp"), "components")
    classed = stats.join(found, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("class_id"))
    many = classed.groupBy("class_id").agg(F.sum("n").alias("all")).where("all > 1").select("class_id")
    flagged = p.join(classed.join(many, "class_id").select("fp", "class_id"), "fp")
    doc = Window.partitionBy("doc_id", "text_key").orderBy("no", "start")
    after = flagged.withColumn("was", F.lag("no").over(doc)).withColumn("far", F.coalesce(F.col("no") - F.col("was") > 2, F.lit(False)))
    # short pieces between two repeated ones do not end a run where the same ones stand between the same two elsewhere
    after = after.withColumn("bridge", F.when(F.col("far") & (F.col("prev") == F.col("was")), F.xxhash64(F.lag("class_id").over(doc), "class_id", "gap")).otherwise(F.xxhash64("doc_id", "text_key", "no", "start")))
    after = after.withColumn("same", F.count("*").over(Window.partitionBy("bridge")))
    runs = after.withColumn("new", (F.col("far") & ~((F.col("prev") == F.col("was")) & (F.col("same") > 1))).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(doc))
    long = keep(runs.withColumn("total", F.sum("words").over(Window.partitionBy("doc_id", "text_key", "run"))).where(f"total >= {run_words}").select("doc_id", "text_key", "start", "stop", "words", "class_id"), "runs")
    first = long.groupBy("class_id").agg(F.min(F.struct("doc_id", "text_key", "start")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    out = long.join(first, "class_id").select("doc_id", "text_key", "start", "stop", "words", "class_id", F.col("first.doc_id").alias("first_doc"), "copies", (F.struct("doc_id", "text_key", "start") == F.col("first")).alias("kept"))
    out = keep(out.unionByName(exact), "result")
    for table in (exact, p, small, met, pairs, stats, places, sets, edges, left, more):
        drop(table)
    return out


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the pieces that are not kept cut out of `text`, and n_chars, if there, counted anew where something was cut.

    Documents of which only blanks are left are dropped; all others stay, also those with null ids or texts, and rows of one id
    with other texts, of which each is cut on its own. Other columns stay, whatever their names. An empty table gives an empty one.
    """
    tag, columns = "_cut", docs.columns
    while any(c.lower().startswith(tag) for c in columns):
        tag = "_" + tag
    cuts = found.where("not kept").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("s"))
    cuts = keep(cuts.select(F.col("doc_id").alias(tag + "i"), F.col("text_key").alias(tag + "k"), F.col("s").alias(tag)), "spans")

    def run(batches):
        for batch in batches:
            text, cut_, stay = batch.column("text").to_pylist(), batch.column(tag).to_pylist(), []
            for k, (t, cut) in enumerate(zip(text, cut_, strict=True)):
                if cut and t:
                    raw, parts, at = t.encode(), [], 0
                    for s in cut:
                        parts.append(raw[at : s["start"]])
                        at = max(at, s["stop"])
                    text[k] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
                stay.append(not cut or bool(text[k] and text[k].strip()))
            done = [pa.array(text, pa.string()) if c == "text" else batch.column(c) for c in columns]
            if "n_chars" in columns:
                n = batch.column("n_chars").to_pylist()
                done[columns.index("n_chars")] = pa.array([len(t) if c and t is not None else x for t, c, x in zip(text, cut_, n, strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(done, columns).filter(pa.array(stay, pa.bool_()))

    size = cuts.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(tag)), F.lit(0)).alias("spans")).first()
    small = 24 * (size.rows + size.spans) <= BROADCAST_BYTES
    keyed = docs.withColumns({tag + "i": F.col("doc_id").cast("long"), tag + "k": F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(F.broadcast(cuts) if small else cuts, [tag + "i", tag + "k"], "left").select(*columns, tag).mapInArrow(A.tidy(run), docs.schema)
