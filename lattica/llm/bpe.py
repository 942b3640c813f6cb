"""Byte-level BPE: words of the split pattern, merged by rank with Spark's higher-order functions, and decoding.

Words that occur twice or more are merged once: a fold over the bytes of each distinct word, with the ranks of pairs as a
literal. They become a table that all executors get, up to a bound; words beyond it are merged by the same fold where they
stand. Words too long for the fold, whose cost is quadratic, are merged with a heap. Words are found in the table by hash and
then compared byte by byte.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.tables import drop, keep, release, small_batches

#: Most words of the table that executors get, about 20 bytes each; and most bytes of a word that is folded.
TABLE_WORDS, FOLD_BYTES = 2_000_000, 96
#: Words of a part of the table. Tasks make the parts; the driver only puts them in line.
PART_WORDS = 1 << 16
#: Primes whose product is more than 2^32: a pair is known by what both leave of it.
BUCKETS, SLOTS = 49_999, 90_007
#: The id that stands for the ends of a word.
END = (1 << 16) - 1
BATCH_BYTES = 2 << 20
# What may follow an apostrophe as a word of its own.
SHORT_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, BLANK = 1, 2, 3
_KINDS: np.ndarray | None = None


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _kinds() -> np.ndarray:
    """Kind of each code point: letter, number, white space or other."""
    global _KINDS
    if _KINDS is None:
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every = "".join(map(chr, points))
        kinds = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
            for m in regex.finditer(pattern, every):
                kinds[[ord(c) for c in m.group()]] = kind
        _KINDS = kinds
    return _KINDS


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of the pattern, as byte spans. They cover all bytes, row by row."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    lead = (raw & 0xC0) != 0x80
    place = np.append(np.flatnonzero(lead), len(raw))
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    kind, n = _kinds()[points], len(points)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(place, offsets)] = True
    cut = first.copy()
    cut[1:-1] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(cut[:-1])
    end = np.append(run[1:], n)
    follows = ~first[end] & (np.arange(len(run)) < len(run) - 1)  # another run of the row
    blank = (kind[run] == BLANK) & follows
    last = end[blank] - 1
    cut[last] = True
    joined = last[points[last] == 32] + 1
    cut[joined] = False  # a single space goes with the next run
    quote = np.flatnonzero((points[run] == 39) & (end - run == 1) & follows)
    for k in quote[cut[run[quote]]]:
        if kind[end[k]] == LETTER:
            at, to = end[k], end[k + 1]
            head = "".join(map(chr, points[at : min(to, at + 2)]))
            for x in SHORT_ENDINGS:
                if head.startswith(x):
                    cut[at] = False
                    if at + len(x) <= n:
                        cut[at + len(x)] = True
                    break
    cut[n] = True
    bounds = np.flatnonzero(cut)
    start, stop = place[bounds[:-1]], place[bounds[1:]]
    return start, stop, np.searchsorted(offsets, start, "right") - 1


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that a token is merged from in the end; None if merging its bytes stops before.

    No other pair ever makes it: until the merge, nothing has crossed the token's ends, so the merges inside of it were those of
    the token on its own, whatever stood around it.
    """
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        found = [(r, k) for k in range(len(parts) - 1) if (r := ranks.get(parts[k] + parts[k + 1])) is not None]
        if not found:
            return None
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts[0], parts[1]


def _slots(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """(moves, slots) of a perfect hash: a pair's slot is the pair and its bucket's move, by remainder. A slot holds the bucket and, in
    the lowest 16 bits, the rank; two pairs of a bucket that share a slot are equal."""
    buckets: dict[int, list[int]] = {}
    for pair in pairs:
        buckets.setdefault(pair % BUCKETS, []).append(pair)
    moves, slots = [0] * BUCKETS, [-1] * SLOTS
    for bucket, held in sorted(buckets.items(), key=lambda x: -len(x[1])):
        move = next((d for d in range(SLOTS) if all(slots[(p + d) % SLOTS] < 0 for p in held)), None)
        if move is None:
            raise ValueError("too many pairs")
        moves[bucket] = move
        for p in held:
            slots[(p + move) % SLOTS] = bucket << 16 | pairs[p]
    free = BUCKETS << 16  # no bucket
    return moves, [free if x < 0 else x for x in slots]


class Ranks:
    """Ranks in the forms that the parts need. `whole` has the tokens that merges do not lead to: only words equal to one give it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        if max(ranks.values()) >= END:
            raise ValueError("ids of more than 16 bits, or the one that stands for ends")
        self.whole, pairs = [], {}
        for token, rank in ranks.items():
            if len(token) < 2:
                continue
            if (parts := last_pair(token, ranks)) is None:
                self.whole.append(token)
            else:
                pairs[ranks[parts[0]] << 16 | ranks[parts[1]]] = rank
        self.table = json.dumps([x for part in _slots(pairs) for x in part], separators=(",", ":"))

    @staticmethod
    def token(table: Column, pair: Column) -> Column:
        """A number of the left one of two neighbours: above, the rank of both joined, or 2^16 at least if there is none; in the lowest
        16 bits its id. pair: both ids in one number; table: how far each bucket is moved, then the slots."""
        bucket = F.pmod(pair, F.lit(BUCKETS))
        found = F.get(table, (F.pmod(pair + F.get(table, bucket.cast("int")), F.lit(SLOTS)) + BUCKETS).cast("int"))
        return F.shiftleft(found.bitwiseXOR(F.shiftleft(bucket, 16)), 16).bitwiseOR(F.shiftright(pair, 16))

    def fold(self, word: Column) -> Column:
        """array<int> of ids: the lowest-ranked neighbours, leftmost first, are merged until none can be.

        The fold carries one array of token(), between two that stand for the ends. The least of them is the next to be merged; the
        two pairs that the merge makes are looked up. All look-ups share one literal.
        """
        first = F.from_json(F.lit(json.dumps(self.byte_ids)), "array<bigint>")
        let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
        pair = lambda a, b: F.shiftleft(a, 16).bitwiseOR(b)
        of = lambda t: t.bitwiseAND(F.lit(0xFFFF))
        end = F.array(F.lit(END).cast("bigint"))
        octets = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(first, F.ascii(c)))
        pairs = let(F.concat(end, octets, end), lambda x: F.transform(x, lambda a, i: pair(a, F.coalesce(F.get(x, i + 1), F.lit(END)))))

        def merged(table: Column, t: Column, m: Column, p: Column) -> Column:
            new = F.shiftright(m, 16)
            made = F.array(pair(of(F.get(t, p - 2)), new), pair(new, of(F.get(t, p + 1))))
            return F.concat(F.slice(t, F.lit(1), p - 2), F.transform(made, lambda x: self.token(table, x)), F.slice(t, p + 2, F.size(t)))

        def folded(table: Column) -> Column:
            place = lambda t, m: let(F.array_position(t, m).cast("int"), lambda p: merged(table, t, m, p))
            step = lambda t, _: let(F.array_min(t), lambda m: F.when(m < 1 << 32, place(t, m)).otherwise(t))
            ids = lambda t: F.transform(F.slice(t, F.lit(2), F.size(t) - 2), lambda x: of(x).cast("int"))
            return F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), F.transform(pairs, lambda x: self.token(table, x)), step, ids)

        table = F.from_json(F.lit(self.table), "array<bigint>")
        return F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(let(table, folded))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, for long words."""
    n = len(word)
    begin, after, before, alive = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    end = list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[begin[i] : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != to:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[begin[i] : end[i]]] for i in range(n) if alive[i]]


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame, longest: int = FOLD_BYTES) -> DataFrame:
    """(word, n) of all words of up to `longest` bytes."""

    def run(batches):
        for batch in batches:
            raw, off = A.string_bytes(batch.column(0))
            for part in A.slices(off, 4 << 20):
                yield from count(raw, off[part[0] : part[1] + 1])

    def count(raw, off):
        hs, ns, starts, ends = [], [], [], []
        for a, b in A.slices(off):
            start, end, _ = pieces(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            fit = end - start <= longest
            start, end = start[fit], end[fit]
            h, at, n = np.unique(A.span_hashes(raw[off[a] : off[b]], start, end), return_index=True, return_counts=True)
            hs.append(h), ns.append(n), starts.append(start[at] + off[a]), ends.append(end[at] + off[a])
        n, starts, ends = np.concatenate(ns), np.concatenate(starts), np.concatenate(ends)
        h, at, back = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
        total = np.bincount(back, n, len(h)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([raw[s:e].tobytes() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary()).cast(pa.string()), pa.array(total)], ["word", "n"])

    return _text(docs).select("text").mapInArrow(A.tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class WordTable:
    """Words by hash: `hashes` sorted, `sizes` in bytes, `at` where the bytes of longer words than eight begin in `data` (which
    ends with eight zeros), `off` the offsets of their ids in `ids`."""

    hashes: np.ndarray
    sizes: np.ndarray
    at: np.ndarray
    data: np.ndarray
    off: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, ids: pa.Array) -> WordTable:
        """words: binary; ids: binary, two bytes each."""
        raw, start = A.string_bytes(words.cast(pa.large_binary()))
        h = A.span_hashes(raw, start[:-1], start[1:])
        order = np.argsort(h, kind="stable")
        h, size = h[order], np.diff(start)[order].astype(np.int32)
        long = np.where(size > 8, size, 0)
        data, _ = A.string_bytes(words.take(pa.array(order[size > 8])).cast(pa.large_binary()))
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        flat, off = A.string_bytes(ids.take(pa.array(order)).cast(pa.large_binary()))
        return cls(h, size, np.cumsum(long, dtype=np.int64) - long, data, (off // 2).astype(np.int32 if off[-1] < 1 << 31 else np.int64), flat.view(np.uint16).copy())

    @classmethod
    def joined(cls, parts: list) -> WordTable:
        """One table from rows of packed_words(). Rows leave the list, and each column its rows, as soon as they are copied, so that
        little more than the table is held."""
        parts.sort(key=lambda x: x.first)
        columns = {c: [x[c] for x in parts] for c in ("hashes", "sizes", "data", "widths", "ids")}
        parts.clear()

        def flat(c: str, kind: type) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in columns.pop(c))])

        size, data = flat("sizes", np.int32), np.concatenate([flat("data", np.uint8), np.zeros(8, np.uint8)])
        at = np.cumsum(np.where(size > 8, size, 0), dtype=np.int64)
        at[1:], at[:1] = at[:-1], 0
        widths = flat("widths", np.int32)
        off = np.zeros(len(widths) + 1, np.int32 if widths.sum(dtype=np.int64) < 1 << 31 else np.int64)
        np.cumsum(widths, out=off[1:])
        return cls(flat("hashes", np.uint64), size, at, data, off, flat("ids", np.uint16))

    def find(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, whether the word is there) of each span of raw. Hashes of words of up to eight bytes tell them apart
        among those of equal size; the bytes of longer ones are compared."""
        if not len(self.hashes):
            return np.zeros(len(start), np.int64), np.zeros(len(start), bool)
        h, size = A.span_hashes(raw, start, end), end - start
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = (self.hashes[k] == h) & (self.sizes[k] == size)
        at, done = np.flatnonzero(hit & (size > 8)), 0
        here, there = (A.eights(x) for x in (np.concatenate([raw, np.zeros(8, np.uint8)]), self.data))
        while len(at):
            mask = A.first_bytes(size[at] - done)
            same = (here[start[at] + done] & mask) == (there[self.at[k[at]] + done] & mask)
            hit[at[~same]] = False
            done += 8
            at = at[same & (size[at] > done)]
        return k, hit


def packed_words(words: DataFrame, most: int = PART_WORDS) -> DataFrame:
    """Parts of about `most` rows of words (word binary, ids binary of two bytes each), by hash: their least hash, and columns of a
    WordTable as bytes. Hashes of two parts do not overlap, but for equal ones at their ends."""

    def hashed(batches):
        for batch in batches:
            raw, off = A.string_bytes(batch.column(0))
            h = A.span_hashes(raw, off[:-1], off[1:]) ^ A.U(1 << 63)  # signed numbers in the order of the hashes
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *batch.columns], ["first", "word", "ids"])

    def packed(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield part(held)
                held, rows = [], 0
        if rows:
            yield part(held)

    def part(held):
        rows = pa.Table.from_batches(held)
        t = WordTable.of(pa.concat_arrays(rows["word"].chunks), pa.concat_arrays(rows["ids"].chunks))
        columns = [t.hashes, t.sizes, t.data[:-8], np.diff(t.off).astype(np.int32), t.ids]
        first = next(b for b in held if b.num_rows).column(0).slice(0, 1)
        return pa.RecordBatch.from_arrays([first, *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["first", "hashes", "sizes", "data", "widths", "ids"])

    rows = words.mapInArrow(A.tidy(hashed), "first long, word binary, ids binary").repartitionByRange("first").sortWithinPartitions("first")
    return rows.mapInArrow(A.tidy(packed), "first long, hashes binary, sizes binary, data binary, widths binary, ids binary")


def word_table(docs: DataFrame, ranks: Ranks, most: int = TABLE_WORDS, part: int = PART_WORDS) -> WordTable:
    """The table of at most `most` frequent words, with ids from folds over distinct words; besides, of what merges do not lead to."""
    counts = keep(word_counts(docs), "words")
    steps = counts.where("n > 1").groupBy(F.expr("cast(log2(n) * 8 as int)").alias("size")).agg(F.count("*").alias("k")).orderBy(F.desc("size")).collect()
    least, held = None, 0
    for r in steps:
        held += r.k
        if held > most:
            break
        least = r["size"]
    whole = {w: np.uint16(ranks.ranks[w]).tobytes() for w in ranks.whole}
    if least is None:
        drop(counts)
        return WordTable.of(pa.array(whole.keys(), pa.binary()), pa.array(whole.values(), pa.binary()))
    chosen = counts.where(F.expr(f"n > 1 and cast(log2(n) * 8 as int) >= {least}")).select("word").repartition(F.col("word"))
    folded = keep(chosen.select("word", ranks.fold(F.col("word")).alias("ids")), "folded")

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().astype(np.uint16)
            ends = np.concatenate([[0], np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))])
            rows = pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), A.binary_array(flat, ends * 2)], ["word", "ids"])
            yield rows.filter(pa.array([w not in whole for w in rows.column(0).to_pylist()], pa.bool_())) if whole else rows

    words = folded.mapInArrow(A.tidy(run), "word binary, ids binary")
    if whole:
        words = words.unionByName(docs.sparkSession.createDataFrame([*whole.items()], words.schema))
    parts = keep(packed_words(words, part), "parts")
    for table in (folded, counts):
        drop(table)
    release(docs.sparkSession)  # what planning took of the driver's memory is free before the parts come
    out = WordTable.joined([*parts.toLocalIterator()])
    drop(parts)
    return out


def encode(docs: DataFrame, ranks: Ranks, most: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 16-bit integers, of each row of docs (doc_id, text). Null texts count as
    empty and give no ids. Rows stay as many as they are; other columns are ignored.
    """
    return _encoded(docs, ranks, most, lambda batches: batches, "doc_id long, ids binary")[0]


def _encoded(docs: DataFrame, ranks: Ranks, most: int, then, schema: str) -> tuple[DataFrame, list]:
    """Rows of encode() that then(batches) makes batches of `schema` from, in the same Python worker; and the broadcasts. Workers load
    the vocabulary for words beyond FOLD_BYTES only."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(word_table(docs, ranks, most))
    gc.collect()
    A.give_back()
    vocabulary = spark.sparkContext.broadcast(ranks.ranks)

    def known(batches):
        table = shared.value
        off, ids = table.off, table.ids
        for batch in batches:
            raw, at = A.string_bytes(batch.column(1))
            for a, b in A.slices(at):
                part = raw[at[a] : at[b]]
                start, end, row = pieces(part, at[a : b + 1] - at[a])
                k, hit = table.find(part, start, end)
                size = np.ones(len(hit), np.int64)
                size[hit] = off[k[hit] + 1] - off[k[hit]]
                out = np.full(size.sum(), -1, np.int32)
                to = np.cumsum(size) - size
                miss = np.flatnonzero(~hit)
                filled = np.ones(len(out), bool)
                filled[to[miss]] = False
                out[filled] = ids[A.ragged(off[k[hit]], size[hit])]
                data = part.tobytes()
                long = end[miss] - start[miss] > FOLD_BYTES
                words = [data[s:e] for s, e in zip(start[miss].tolist(), end[miss].tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, size, b - a).astype(np.int64))])
                tail = np.concatenate([[0], np.cumsum(np.bincount(row[miss], minlength=b - a))])
                texts = pa.array(["" if x else w.decode() for w, x in zip(words, long.tolist(), strict=True)], pa.string())
                rest = pa.array([w if x else b"" for w, x in zip(words, long.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), A.binary_array(out, ends * 4), pa.ListArray.from_arrays(pa.array(tail, pa.int32()), texts), pa.ListArray.from_arrays(pa.array(tail, pa.int32()), rest)], ["doc_id", "ids", "tail", "long"])

    def filled(batches):
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            out = []
            for raw, tail, long in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                ids, long = np.frombuffer(raw.as_buffer(), np.int32), long.as_py()
                hole = np.flatnonzero(ids < 0)
                if len(hole):
                    lists = tail.values
                    o = lists.offsets.to_numpy()
                    flat = lists.flatten().to_numpy()
                    size, parts = np.diff(o), None
                    if any(long):
                        parts = [merge_long(w, vocabulary.value) if w else flat[o[k] - o[0] : o[k + 1] - o[0]] for k, w in enumerate(long)]
                        size, flat = np.array([len(x) for x in parts]), np.concatenate(parts)
                    width = np.ones(len(ids), np.int64)
                    width[hole] = size
                    new = np.empty(width.sum(), np.int32)
                    mask = np.repeat(ids < 0, width)
                    new[mask], new[~mask] = flat, ids[ids >= 0]
                    ids = new
                out.append(ids.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    rows = _text(docs).mapInArrow(A.tidy(known), "doc_id long, ids binary, tail array<string>, long array<binary>")
    rows = rows.select("doc_id", "ids", F.transform("tail", ranks.fold).alias("tail"), "long")
    return rows.mapInArrow(A.tidy(lambda batches: then(filled(batches))), schema), [shared, vocabulary]


def decode(encoded: DataFrame, ranks: Ranks) -> DataFrame:
    """Adds `bytes` to (doc_id, ids): the pieces of the ids, one after another. Null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(_decoder(ranks.ranks))
    return encoded.select("doc_id", "ids").mapInArrow(A.tidy(lambda batches: _decoded(batches, *shared.value)), "doc_id long, ids binary, bytes binary")


def _decoder(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(places, data): the bytes of all tokens by id, and where those of each begin."""
    table = sorted(ranks.items(), key=lambda x: x[1])
    places = np.full(table[-1][1] + 2, 0, np.int64)
    places[np.array([r for _, r in table]) + 1] = [len(t) for t, _ in table]
    return np.cumsum(places), np.frombuffer(b"".join(t for t, _ in table), np.uint8)


def _joined(places: np.ndarray, data: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return data[A.ragged(places[ids], places[ids.astype(np.int64) + 1] - places[ids])]


def _decoded(batches, places: np.ndarray, data: np.ndarray):
    for batch in batches:
        out, held, first = [], 0, 0
        for k in range(batch.num_rows):
            raw = batch.column(1)[k].as_buffer()
            out.append(None if raw is None else _joined(places, data, np.frombuffer(raw, "<u2")).tobytes())
            held += len(out[-1] or b"")
            if held > BATCH_BYTES or k == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(out)) for c in batch.columns), pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])
                first, out, held = first + len(out), [], 0


def token_digests(docs: DataFrame, ranks: Ranks, most: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: hashes of the ids as 32-bit integers and of what they decode to.

    Decoding and hashing run in the worker that encodes, so that texts need not leave it. Null texts count as empty; null ids and
    repeated rows stay as they are; other columns are ignored; an empty table gives an empty one.
    """

    decoder = docs.sparkSession.sparkContext.broadcast(_decoder(ranks.ranks))

    def digests(batches):
        for batch in _decoded(batches, *decoder.value):
            n, ids, text = [], [], []
            for raw, back in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n.append(len(raw) // 2)
                ids.append(hashlib.sha256(np.frombuffer(raw, "<u2").astype("<u4").tobytes()).hexdigest())
                text.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out, held = _encoded(docs, ranks, most, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    out = keep(out, "result")
    for x in (*held, decoder):
        x.destroy()
    release(docs.sparkSession)
    return out
