"""Operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import bpe, embedding_dedup, language_model, licenses, mixing, ngram_join, passages, quality, toxicity, transport
from lattica.llm.components import components

RNG = random.Random(7)
WORDS = [f"{a}{b}" for a in ("ta", "lo", "mi", "Ke", "zu", "é") for b in ("ran", "bel", "tok", "s", "ni")]
PASSAGE = " ".join(f"passage{k}{'.' if k % 9 == 8 else ''}" for k in range(60)) + "."


def prose(n):
    return " ".join(RNG.choice(WORDS) + (f"{RNG.randrange(999)}" if RNG.random() < 0.7 else "") + ("." if RNG.random() < 0.1 else "") for _ in range(n))


def _corpus():
    base = [prose(RNG.randrange(5, 120)) for _ in range(40)]
    rows = list(enumerate(base))
    words = base[3].split()
    for k in range(12):  # near copies that link in chains
        w = words[:]
        for _ in range(k):
            w[RNG.randrange(len(w))] = f"edit{RNG.randrange(99)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, base[5]), (201, base[5].upper()), (202, None), (203, ""), (204, " \n\t"), (205, "one two"), (206, "ONE  two"), (207, "a b c d e"), (208, prose(6000)), (200, base[5])]
    rows += [(300, base[0] + " " + PASSAGE + " " + base[1]), (301, prose(30) + " " + PASSAGE + " tail words here"), (None, base[5])]
    return rows


ROWS = _corpus()


def corpus():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that the operators use themselves."""
    rows = [(i, t, "x", 1.0, i, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, tile double, n long, lang string, source string").repartition(3).persist()


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def labels_of(spark, rows, column):
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(50, 60), (60, 50), (70, 70), (61, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {50: 50, 60: 50, 61: 50}
    assert not components(spark.createDataFrame([], "a long, b long")).count()


def shingle_set(text):
    w = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_ngram_join(spark, docs):
    sets = {i: shingle_set(t) for i, t in corpus() if i is not None}
    s = Sets()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                s.join(a, b)
    out = ngram_join.ngram_components(docs).collect()
    assert len(out) == len(corpus())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == {i: (len(x), s.find(i)) for i, x in sets.items()}
    assert not ngram_join.ngram_components(empty(spark)).count()


def test_signature_bound():
    a, b = (np.unique(np.random.default_rng(k).integers(0, 2**63, 300, dtype=np.uint64)) for k in (1, 2))
    b = np.unique(np.concatenate([b[:100], a[:150]]))
    sig = ngram_join.signatures([a, b])
    most = min(len(a) - int(np.bitwise_count(sig[0] & ~sig[1]).sum()), len(b) - int(np.bitwise_count(sig[1] & ~sig[0]).sum()))
    assert len(np.intersect1d(a, b)) <= most < min(len(a), len(b))


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        v = rng.standard_normal(16)
        rows += [(k * 20 + j, (v + j * 0.06 * rng.standard_normal(16)).tolist(), k % 3) for j in range(8)]
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, rows[0][1], 1), (903, rows[0][1], None), (904, None, 0), (905, [0.0] * 16, 0), (906, [1.0, None], 0), (907, [float("nan")] * 16, 0), (908, [float("inf")] * 16, 0), (909, [2 * x for x in rows[0][1]], 0), (910, [], 0), (911, [1.0, 2.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("x"))).collect()}
    fine = [(i, np.array(v), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    s, n = Sets(), Counter()
    for i, v, y in fine:
        for j, w, z in fine:
            if i < j and y == z and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.93:
                n[i] += 1
                n[j] += 1
                s.join(i, j)
    assert got == {i: (n[i], s.find(i), s.find(i) == i) for i, _, _ in rows}
    assert not embedding_dedup.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count()


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    signs, factor, turned = embedding_dedup.encode(x)
    at, width = embedding_dedup.estimate(signs, factor, turned)
    true = x @ x.T
    off = ~np.eye(300, dtype=bool)
    assert (np.abs(at - true)[off] <= width[off]).all() and abs((at - true)[off].mean()) < 0.002


def test_passages(spark, docs):
    found = passages.repeated_passages(docs)
    rows = found.collect()
    assert {300, 301} <= {r.doc_id for r in rows} and not {r.doc_id for r in rows} & {202, 203, 204, 205, 206, 207, 208, 7, 8, 9}
    text = dict(corpus())
    for r in rows:
        piece = text[r.doc_id].encode()[r.start : r.stop].decode()
        assert len(piece.split()) == r.words
    cut = {r.doc_id: r.text for r in passages.without_repeats(docs.select("doc_id", "text"), found).collect()}
    assert "passage30" in cut[300] and "passage30" not in cut[301] and cut[7] == text[7] and 202 in cut and None in cut
    assert not passages.repeated_passages(empty(spark)).count()


def test_passages_of_rows_with_one_id(spark):
    """Two texts under one id are cut each on their own; a row repeated whole is cut like its twin."""
    alone = prose(70)
    rows = [(1, f"{prose(20)} {PASSAGE} {prose(20)}"), (2, f"{prose(5)} {PASSAGE} {prose(9)}"), (2, alone), (3, f"{prose(8)}\n{PASSAGE}"), (3, "")]
    rows.append(rows[3])
    docs = spark.createDataFrame([(i, t, 1, "c", 7) for i, t in rows], "doc_id long, text string, _cut int, _spans string, text_key long")
    found = passages.repeated_passages(docs)
    got = passages.without_repeats(docs, found)
    assert got.columns == docs.columns
    text = Counter((r.doc_id, r.text) for r in got.collect())
    assert text[2, alone] == 1 and text[1, rows[0][1]] == 1 and text[3, ""] == 1
    cut = [t for (i, t), n in text.items() for _ in range(n) if t not in (alone, rows[0][1], "")]
    assert len(cut) == 3 and not any("passage3" in t for t in cut) and all(t.split()[:3] in ([*rows[1][1].split()[:3]], [*rows[3][1].split()[:3]]) for t in cut)


def test_passages_bridge_short_pieces(spark):
    """Two sentences of 14 words with short ones between: one run of over 25 words if the short ones are the same."""
    a, b = (" ".join(f"{x}{k}" for k in range(14)) + "." for x in "pq")
    rows = [(1, f"Intro one. {a} Oh yes. Oh no. Go on. {b}"), (2, f"{a} Oh yes. Oh no. Go on. {b} End."), (3, f"{a} Not this. Nor that. Stop it. {b}")]
    got = Counter(r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {1: 2, 2: 2}


def test_passages_of_a_family(spark):
    """Pieces of 30 words from one form, by brute force over all pairs: clusters of pairs over 0.8, pairs of clusters mostly under it."""
    rng = random.Random(11)
    form = [f"form{k}" for k in range(34)]
    rows = []
    for c in range(150):
        own = [f"c{c}x{k}" for k in range(4)]
        rows += [(3 * c + k, " ".join([*own[:2], *form, *own[2:], *(f"e{3 * c + k}y{i}" for i in range(k))]) + ".") for k in range(3)]
    rng.shuffle(rows)
    sets = {d: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert len({top(d) for d in sets}) == 150
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = defaultdict(set)
    for r in found.collect():
        classes[r.class_id].add(r.doc_id)
    want = defaultdict(set)
    for d in sets:
        want[top(d)].add(d)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_passages_of_short_pieces(spark):
    """Pieces of 8 to 12 words, and the same with a word more at an end: all pairs of 4 to 8 and one shingle more, and no others."""
    rows, want = [], set()
    for n in range(7, 13):
        w, tail = [f"n{n}w{k}" for k in range(n)], " ".join(f"tail{n}x{k}" for k in range(20)) + "."
        rows += [(2 * n, " ".join(w) + ". " + tail), (2 * n + 1, " ".join([f"more{n}", *w]) + ". " + tail)]
        want |= {2 * n, 2 * n + 1} if n >= 8 else set()
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found if r.start == 0} == want
    assert all(r.copies == 2 and r.first_doc == r.doc_id // 2 * 2 and r.kept == (r.doc_id % 2 == 0) for r in found)


def test_exact_passages(spark):
    """Against brute force over all windows of 50 words: no ends of sentences, cut ones, short ones, loops, repeats in one text."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    plain, short = [word() for _ in range(60)], [f"{word()} {word()}." for _ in range(30)]
    rows = [(k, " ".join([word() for _ in range(rng.randrange(40))] + plain[k % 7 : 60 - k % 3] + [word() for _ in range(30)])) for k in range(12)]
    rows += [(20 + k, " ".join([word(), *short, word()])) for k in range(2)] + [(30, " ".join(plain + [word()] + plain[:50] + plain[:49])), (31, " ".join(plain[5:54])), (32, "loop " * 200), (33, "a b c " * 18), (34, "a b " * 24)]
    rows += [(40, " ".join(plain[20:] + rows[0][1].split()[-25:])), (50, rows[3][1].upper()), (60, " ".join(word() for _ in range(300))), (61, None), (62, ""), (None, rows[0][1])]
    found = passages.exact_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    windows = defaultdict(list)
    words = {d: (t or "").lower().split() for d, t in rows if d is not None}
    for d in sorted(words):
        for p in range(len(words[d]) - 49):
            windows[tuple(words[d][p : p + 50])].append((d, p))
    want = {(d, p): at[0] == (d, p) for at in windows.values() if len(at) > 1 for d, p in at}
    got, text = {}, {d: (t or "").encode() for d, t in rows if d is not None}
    for r in found:
        p = len(text[r.doc_id][: r.start].split())
        assert text[r.doc_id][r.start : r.stop].lower().split() == [x.encode() for x in words[r.doc_id][p : p + r.words]]
        for k in range(r.words - 49):
            assert (r.doc_id, p + k) not in got
            got[r.doc_id, p + k] = r.kept
            assert r.first_doc == windows[tuple(words[r.doc_id][p + k : p + k + 50])][0][0]
    assert got == want
    kept = {r.class_id: r for r in found if r.kept}
    assert all(kept[r.class_id].doc_id == r.first_doc and r.copies == sum(x.class_id == r.class_id for x in found) for r in found)
    every = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.stop) for r in found} <= {(r.doc_id, r.start, r.stop) for r in every}


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return bpe.Ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def test_bpe(spark, docs, ranks):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    extra = ["I'm 'tis it's  we've \n\n they'll 'S ''s x'd'm\ta", "z" * 700 + "ab" * 90, "été 12½ ٣ 日本語😀  <|endoftext|>", "\n", "'s 's\n's", "a" * 97 + " " + "b" * 96]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    expect = Counter()
    for i, t in [*corpus(), *((1000 + k, t) for k, t in enumerate(extra))]:
        ids = enc.encode_ordinary(t or "")
        expect[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.token_digests(table, ranks).collect()) == expect
    assert not bpe.token_digests(empty(spark), ranks).count()
    few = bpe.token_digests(table, ranks, most=5)  # words beyond the table are folded where they stand
    assert Counter(tuple(r) for r in few.collect()) == expect


def test_bpe_of_tokens_that_merges_do_not_lead_to(spark):
    import public_tokenizers
    import tiktoken

    own = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257, b"abab": 258, b"Q" * 100: 259}
    few = bpe.Ranks(own)
    assert few.whole == [b"xyz", b"Q" * 100] and bpe.last_pair(b"abab", own) == (b"ab", b"ab")
    enc = tiktoken.Encoding("few", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    rows = [(1, "xyz"), (2, "xyzab abab\nxyz"), (3, "Q" * 100), (4, "Q" * 101), (5, "abababab xyz xyz"), (6, None)]
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), few).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in rows}


def test_bpe_workers_hold_the_vocabulary_for_long_words_only(spark, ranks):
    import pyarrow as pa

    def then(batches, *_):
        from pyspark.core.broadcast import _broadcastRegistry

        for batch in batches:
            held = sum(isinstance(x.__dict__.get("_value"), dict) for x in _broadcastRegistry.values())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held] * batch.num_rows, pa.int64())], ["doc_id", "held"])

    for text, held in (("some words once " * 20, 0), ("once" * 60, 1)):
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert [r.held for r in bpe._encoded(rows, ranks, 100, then, "doc_id long, held long")[0].collect()] == [held]


def test_bpe_tells_pairs_apart_in_the_fold(spark, ranks):
    """One literal has all pairs, at a place of its own each, and no other pair is taken for one of them: nothing is searched for."""
    plan = spark.range(1).select(ranks.fold(F.lit("word").substr(F.lit(1), F.col("id") + 4)).alias("ids"))
    assert plan.collect()[0].ids == bpe.merge_long(b"word", ranks.ranks)
    assert len([v for v in vars(ranks).values() if isinstance(v, str)]) == 1 and len(ranks.table) < 1_100_000  # two of 1,244,295 before
    own = {tuple(ranks.ranks[x] for x in p): r for t, r in ranks.ranks.items() if len(t) > 1 and (p := bpe.last_pair(t, ranks.ranks))}
    moves, slots = bpe._slots({a << 16 | b: r for (a, b), r in own.items()})
    rng = np.random.default_rng(3)
    near = {(a + int(rng.integers(-1, 2)) & 0xFFFF, b + int(rng.integers(-1, 2)) & 0xFFFF) for a, b in own}
    edges = {(0, 0), (bpe.END, bpe.END), (0, bpe.END), (bpe.END, 0)}
    far = {tuple(x) for x in rng.integers(0, 1 << 16, (100_000, 2)).tolist()}
    for a, b in own.keys() | near | far | edges:
        q = a << 16 | b
        found = slots[(q + moves[q % bpe.BUCKETS]) % bpe.SLOTS] ^ q % bpe.BUCKETS << 16
        assert found == own[a, b] if (a, b) in own else found >= 1 << 16
    with pytest.raises(ValueError, match="too many pairs"):
        bpe._slots({k: 1 for k in range(bpe.SLOTS + 1)})


def test_word_table_compares_bytes():
    words = [b"word", b"a longer word", b"another longer word, 26 bytes"]
    import pyarrow as pa

    table = bpe.WordTable.of(pa.array(words, pa.binary()), pa.array([b"\1\0", b"\2\0\3\0", b"\4\0"], pa.binary()))
    raw = b"".join([*words, b"words"])
    ends = np.cumsum([0] + [len(w) for w in words] + [5])
    k, hit = table.find(np.frombuffer(raw, np.uint8), ends[:-1], ends[1:])
    assert hit.tolist() == [True, True, True, False]
    assert [table.ids[table.off[i] : table.off[i + 1]].tolist() for i in k[:3]] == [[1], [2, 3], [4]]
    table.data[table.at[k[2]] + 20] ^= 1  # another word of the same hash and size
    assert table.find(np.frombuffer(raw, np.uint8), ends[:-1], ends[1:])[1].tolist() == [True, True, False, False]


def test_word_table_comes_to_the_driver_in_parts(spark, ranks, tmp_path):
    """What the driver's Python holds at most, against the table: it was 5 times as much when all words came at once."""
    import tracemalloc

    import pyarrow as pa

    words = [f"w{k * 7919 % 1_000_003}{'abcdefghij' * (k % 2)}" for k in range(150_000)]
    spark.createDataFrame([(k, " ".join(words[k : k + 3000])) for _ in range(2) for k in range(0, len(words), 3000)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    pool, before = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        table = bpe.word_table(spark.read.parquet(f"{tmp_path}/docs"), ranks)
        peak = tracemalloc.get_traced_memory()[1] + pool.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)
    assert len(table.hashes) >= len(words) and (table.hashes[1:] > table.hashes[:-1]).all()
    assert peak < 2.5 * sum(x.nbytes for x in (table.hashes, table.sizes, table.at, table.data, table.off, table.ids))


def test_parts_of_a_word_table_make_the_whole(spark):
    import pyarrow as pa

    words = [f"{'long' * (k % 7)}{k}".encode() for k in range(3000)]
    ids = [np.arange(k % 5, dtype=np.uint16).tobytes() for k in range(3000)]
    whole = bpe.WordTable.of(pa.array(words, pa.binary()), pa.array(ids, pa.binary()))
    rows = spark.createDataFrame([*zip(words, ids, strict=True)], "word binary, ids binary").repartition(3)
    for most in (100, 1 << 16):
        got = bpe.WordTable.joined(bpe.packed_words(rows, most).collect())
        for c in ("hashes", "sizes", "at", "data", "off", "ids"):
            assert np.array_equal(getattr(whole, c), getattr(got, c)) and getattr(whole, c).dtype == getattr(got, c).dtype
    assert not len(bpe.WordTable.joined(bpe.packed_words(rows.limit(0)).collect()).hashes)


def test_mixing(spark, docs):
    assert mixing.fill(10, [1, 1], [3, 100]) == [3, 7] and mixing.fill(10, [1, 1, 2], [100] * 3) == [3, 2, 5] and mixing.fill(9, [1], [4]) == [4]
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "1"): 100, ("b", "z", "1"): 1000}
    got = mixing.budgets(leaves, 200, {("a",): 1, ("b",): 1}, 1, 1.0)
    assert got[("b", "z", "1")] == 100 and sum(got.values()) == 200
    short = mixing.budgets(leaves, 100, {("a",): 1, ("b",): 0, ("a", "x"): 1, ("a", "y"): 1, ("a", "x", "1"): 9, ("a", "x", "2"): 1}, 1, 1.0)
    assert short == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("a", "y", "1"): 50, ("b", "z", "1"): 0}  # the sibling takes the shortage first
    named = mixing.budgets({("a", "", "1"): 30_000, ("a", "de", "1"): 100_000, ("a", "en", "1"): 100_000}, 50_000, {("a", "en"): 5, ("a", "de"): 2}, 1, 1)
    assert named == {("a", "", "1"): 0, ("a", "de", "1"): 14286, ("a", "en", "1"): 35714}  # who is not named among named ones weighs nothing


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.5, 2), (1.0, 1)])
def test_mixing_against_brute_force(spark, docs, share, epochs):
    """Rows and epochs by sorting each leaf as a whole; columns of docs have names like those that the operator uses."""
    table = docs.withColumn("domain", mixing.domain_of(F.col("source"))).withColumns({"_a": F.lit(1), "_h": F.lit("z"), "epoch": F.lit("old")})
    rows = [r.asDict() for r in table.collect()]
    leaf = lambda r: (r["domain"], r["lang"] or "", r["source"] or "")
    size = lambda r: len((r["text"] or "").encode().split())
    leaves = Counter()
    for r in rows:
        leaves[leaf(r)] += size(r)
    goal = mixing.budgets(dict(leaves), int(share * sum(leaves.values())), {}, epochs, 1)
    want = Counter()
    for x, n in leaves.items():
        whole, rest = divmod(goal[x], n)
        name = lambda r: "" if r["doc_id"] is None else str(r["doc_id"])
        order = sorted((hashlib.md5(f"{mixing.SEED}:{whole}:{name(r)}".encode()).hexdigest(), name(r), size(r), r["doc_id"], r["text"]) for r in rows if leaf(r) == x) if n else []
        total = Counter()
        for h, i, k, _, _ in order:
            total[h, i] += k
        sums, at = {}, 0
        for key in sorted(total):
            at += total[key]
            sums[key] = at
        for h, i, k, d, t in order:
            want.update((d, t, k, e) for e in range(whole + (sums[h, i] <= rest)))
    out = mixing.mix(table, share, epochs=epochs, alpha=1)
    assert out.columns == [c for c in table.columns if c != "epoch"] + ["tokens", "epoch"]
    assert Counter((r.doc_id, r.text, r.tokens, r.epoch) for r in out.collect()) == want
    assert not mixing.mix(empty(spark).withColumn("domain", F.lit("d"))).count()


def test_language_model(spark, docs):
    out = language_model.language_model_scores(docs, factor=0.7).collect()
    count = Counter()
    for i, t in corpus():
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            count.update((t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split())
            count["end"] += 1
    n, v = sum(count.values()), len(count)
    texts = defaultdict(list)
    for i, t in corpus():
        texts[i].append(t)
    assert len(out) == len(corpus())
    for r in out:
        w = (texts[r.doc_id][0] or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split() + ["end"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9) and r.score < 0
    assert not language_model.language_model_scores(empty(spark)).count()


def test_recurrent_gradients_and_carried_state():
    rng = np.random.default_rng(1)
    net = language_model.Recurrent(np.array([9, 8, 7, 5, 3, 2, 1, 1.0]), 4, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, h = rng.integers(0, 8, (5, 3)), rng.integers(0, 8, (5, 3)), np.zeros((3, 4))
    _, grads, _ = net.window(x, y, h)
    for k, p in net.p.items():
        flat = p.reshape(-1)
        i = int(rng.integers(len(flat)))
        old = flat[i]
        up, down = [(flat.__setitem__(i, old + e), net.window(x, y, h)[0])[1] for e in (1e-5, -1e-5)]
        flat[i] = old
        assert abs((up - down) / 2e-5 - grads[k].reshape(-1)[i]) < 1e-5
    docs = [rng.integers(0, 8, n) for n in (3, 50, 0, 17)]
    flat, off = np.concatenate(docs), np.cumsum([0, 3, 50, 0, 17])
    assert np.allclose(net.score(flat, off, 0, 4), net.score(flat, off, 0, 1000))
    alone = [net.score(d, np.array([0, len(d)]), 0)[0] for d in docs]
    assert np.allclose(net.score(flat, off, 0), alone)
    assert np.isclose(np.exp(net.score(np.arange(8), np.arange(9), 0)).sum(), 1)


def test_language_model_learns_from_all(spark):
    """Words follow each other in a fixed order, so the state tells more than counts; each round and each task adds to the fit."""
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{(rng.randrange(12) + 5 * j) % 12 if j % 6 == 0 else (j * 5 + k % 3) % 12}" for j in range(120))) for k in range(400)]
    out = language_model.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), factor=4).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 40 and sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)


def test_transport(spark, docs):
    for n in (64, 128, 16384, 16448, 70016):
        raw = RNG.randbytes(n)
        s = transport.demux(transport.mux(raw))
        assert s.payload == raw and not (s.continuity_errors or s.sync_errors or s.crc_errors) and s.units[0].random_access and s.program == 1
    media = bytearray(transport.mux(RNG.randbytes(70016)))
    lost = bytes(media[: 188 * 9] + media[188 * 10 :])
    assert transport.demux(lost).continuity_errors == 1
    media[188 * 5] = 0
    assert transport.demux(bytes(media)).sync_errors == 1 and transport.demux(b"").packets == 0
    media = bytearray(transport.mux(bytes(64)))
    media[10] ^= 1
    assert transport.demux(bytes(media)).crc_errors == 1
    out = transport.media_features(docs).collect()
    assert len(out) == len(corpus())
    texts = {(i, (t or "").encode()) for i, t in corpus()}
    for r in out:
        raw = next(b for i, b in texts if i == r.doc_id and len(b) == r.n_bytes)
        payload = raw.ljust(max(64, -len(raw) % 64 + len(raw)), b"\0")
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(transport.mux(payload)).hexdigest()
    assert not transport.media_features(empty(spark)).count()


def test_transport_clashing_columns_and_times(spark):
    media = spark.createDataFrame([(1, bytearray(transport.mux(bytes(70016))), "x", 2, 3)], "doc_id long, media binary, payload string, units int, found int")
    got = transport.read_streams(media)
    assert got.columns == ["doc_id", "media", "payload", "units", "found"]
    row = got.first()
    assert bytes(row.payload) == bytes(70016) and [u.pts for u in row.units] == [90_000 + 3_600 * k for k in range(5)]
    assert all(u.dts == u.pts and u.clock == u.pts * 300 for u in row.units)


def test_licenses(spark, docs):
    t = licenses.TEMPLATES["mit-text"].split()
    rows = [(1, prose(40) + " " + " ".join(t) + " " + prose(40)), (2, prose(20) + " All  RIGHTS reserved. " + prose(9)), (3, " ".join(t[:20])), (4, " ".join([*t[:30], "other", *t[31:]])), (5, None), (6, ""), (7, "Released under the MIT License."), (7, "Released under the MIT License."), (8, " ".join([*t, prose(200), *t])), (10, " ".join(t * 3)), (11, " ".join([*t, "so", "far", *t[:30]])), (9, prose(5000) + " Licensed under CC BY-NC 4.0. x")]
    out = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r.doc_id, r.license) for r in out)
    assert got == Counter({(1, "mit-text"): 1, (2, "all-rights-reserved"): 1, (4, "mit-text"): 1, (7, "mit"): 2, (8, "mit-text"): 2, (9, "cc-by-nc-4.0"): 1, (10, "mit-text"): 3, (11, "mit-text"): 1})
    three = sorted((r.start, r.stop, r.containment) for r in out if r.doc_id == 10)
    assert three == [(k * (len(" ".join(t)) + 1), k * (len(" ".join(t)) + 1) + len(" ".join(t)), 1.0) for k in range(3)]
    r = next(r for r in out if r.doc_id == 1)
    assert rows[0][1].encode()[r.start : r.stop].decode() == " ".join(t) and r.containment == 1.0
    assert not licenses.license_scan(empty(spark)).count() and not licenses.license_scan(docs).where("doc_id = 208").count()


def test_licenses_against_brute_force(spark):
    """Templates in texts of a few words, so that pieces of them stand everywhere: a document has a template's license if and only if
    some stretch of two template lengths holds four fifths of its shingles. And a text of very many copies is scanned in one pass."""
    rng = random.Random(9)
    word = lambda: rng.choice("one two three four five six".split())
    templates = {f"t{k}": " ".join(word() for _ in range(n)) for k, n in enumerate((5, 6, 9, 14, 30))}
    rows = [(k, " ".join(word() for _ in range(rng.randrange(80)))) for k in range(150)]
    for k in range(60):
        w = templates[f"t{k % 5}"].split()
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = "other"
        rows.append((200 + k, " ".join([*(word() for _ in range(rng.randrange(30))), *w, *(word() for _ in range(rng.randrange(30)))])))
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = set()
    for i, t in rows:
        own = grams(t.split())
        for name, x in templates.items():
            needed = set(grams(x.split()))
            spans = (set(own[a : a + 2 * len(needed)]) & needed for a in range(max(1, len(own))))
            if any(100 * len(s) >= 80 * len(needed) for s in spans):
                want.add((i, name))
    out = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    assert {(r.doc_id, r.license) for r in out} == want and len(want) > 25
    many = spark.createDataFrame([(1, "All rights reserved. " * 20_000)], "doc_id long, text string")
    assert licenses.license_scan(many).count() == 20_000


def test_toxicity(spark):
    assert toxicity.fold("Thé 1d10t, ｓtupid 123 ѕсuḿ!") == " the idiot stupid 123 scum "
    lex = toxicity.Lexicon({" trash ": 3.0, " idi": 2.0}, [" trash can "])
    hit = lambda t: toxicity.hits(toxicity.fold(t), lex.automaton())
    assert [w for _, w in hit("You TR4SH, 1diots!")] == [3.0, 2.0] and not hit("the trash can") and not hit("trashy")
    rng = random.Random(4)
    for _ in range(200):  # matches against looking for every term at every place
        text = " ".join(rng.choice(["trash", "can", "idi", "idiom", "the", "tra sh"]) for _ in range(12))
        folded, best = toxicity.fold(text), {}
        for t, w in lex.terms.items():
            for k in range(len(folded)):
                if folded.startswith(t, k):
                    best[k] = max(best.get(k, 0), w)
        free = [k for k in range(len(folded)) if folded.startswith(" trash can ", k)]
        assert sorted(toxicity.hits(folded, lex.automaton())) == sorted((k, w) for k, w in best.items() if not any(a <= k < a + 10 for a in free))
    rows, labels = [], []
    for k in range(800):
        bad = k % 4 == 0
        w = prose(30).split()
        if bad:
            w.insert(3, RNG.choice(["grobnik", "grobnika", "GR0BN1K", "splurd"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    rows += [(900, None), (901, ""), (None, "grobnik"), (5, rows[5][1])]
    out = toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels_of(spark, labels, "toxic")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 800]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95
    assert not toxicity.toxicity_scores(empty(spark), labels_of(spark, [], "toxic")).count()


def test_quality(spark):
    rows, labels = [], []
    for k in range(300):
        bad = k % 5 == 0
        t = prose(60)
        rows.append((k, (t.upper().replace(" ", "!! ") if k % 2 else " ".join([t.split()[0]] * 60)) if bad else t, "en", "src1"))
        if k % 3:
            labels.append((k, int(not bad)))
    rows += [(900, None, None, None), (901, "", "en", "s"), (None, "x", "en", "s"), (5, rows[5][1], "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lab = labels_of(spark, labels, "quality")
    out = quality.quality_scores(docs, lab).collect()
    assert len(out) == len(rows)
    assert np.mean([r.accepted == bool(r.doc_id % 5) for r in out if r.doc_id is not None and r.doc_id < 300]) > 0.97
    assert quality.accepted_documents(docs, lab).columns == docs.columns
    left = [(r.score, r.doc_id % 5) for r in out if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 3 == 0]
    assert min(s for s, good in left if good) > max(s for s, good in left if not good)  # rows that no label told of
    none = quality.quality_scores(docs, labels_of(spark, [], "quality"))
    assert none.where("accepted").count() == len(rows) and not quality.quality_scores(empty(spark), lab).count()


def test_release_gives_back_the_memory_of_the_drivers_python(spark):
    import psutil

    from lattica.llm.tables import release

    release(spark)
    held = [bytearray(60_000) for _ in range(3000)]
    for x in held:
        x[::1000] = b"x" * 60
    last = held[-1]  # so that the C library does not give the rest back by itself
    del held, x
    before = psutil.Process().memory_info().rss
    release(spark)
    assert before - psutil.Process().memory_info().rss > 100 << 20 and len(last) == 60_000
