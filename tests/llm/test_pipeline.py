"""The stages of the pipeline, each against brute force on its own input: nulls, empty texts, repeated rows, clashing names, no rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from lattica.llm import mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens int, key string, _a int"


def made():
    rng = random.Random(5)
    word = lambda: f"{rng.choice(['ta', 'lo', 'mi', 'zu'])}{rng.choice(['ran', 'bel', 'tok'])}{rng.randrange(3000)}"
    prose = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))
    passage = prose(70)
    rows = [(k, prose(rng.randrange(20, 90))) for k in range(120)]
    rows += [(200 + k, f"{prose(30)} {passage} {prose(20)}") for k in range(4)]
    rows += [(300 + k, rows[k][1] + " more") for k in range(10)] + [(320, rows[11][1]), (321, rows[11][1].upper())]
    rows += [(400, None), (401, ""), (402, " \n"), (3, rows[3][1]), (5, prose(40)), (None, rows[9][1]), (403, prose(4000))]
    rows += [(500 + k, "BUY NOW!!! $$$ " * 30) for k in range(40)]
    return [(i, t, rng.choice(["en", "de", None]), f"src{rng.randrange(3)}", len(t or ""), k, "k", 1) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(made(), SCHEMA).repartition(3)
    spark.createDataFrame([(k, int(k < 500)) for k in [*range(0, 120, 2), *range(500, 540, 2)]], "doc_id long, quality int").write.parquet(f"{top}/labels.parquet")
    docs.write.parquet(f"{top}/documents.parquet")
    docs = spark.read.parquet(f"{top}/documents.parquet")
    kept = [("documents", docs)]
    for name, stage in P.STAGES:
        stage(spark, docs, top).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        kept.append((name, docs))
    return {name: (before, after) for (_, before), (name, after) in zip(kept, kept[1:], strict=False)}, top


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def test_quality_stage(spark, stages):
    before, after = stages[0]["quality"]
    assert before.columns == after.columns
    scores = {(r.doc_id, r.score) for r in quality.quality_scores(before, spark.read.parquet(f"{stages[1]}/labels.parquet")).where("accepted").collect()}
    assert {r["doc_id"] for r in rows_of(after)} == {i for i, _ in scores}
    left = {r["doc_id"] for r in rows_of(after)}
    assert not left & set(range(500, 540)) and len(left & set(range(120))) > 110


def test_near_copies_stage(stages):
    before, after = (rows_of(x) for x in stages[0]["near_copies"])
    sets = defaultdict(set)
    for r in before:
        sets[r["doc_id"]] |= {frozenset(shingles(r["text"]))}
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    want = {(r["doc_id"], r["text"]) for r in before if r["doc_id"] is None or top(r["doc_id"]) == r["doc_id"]}
    assert Counter((r["doc_id"], r["text"]) for r in after) == Counter(want)
    assert {tuple(r.values()) for r in after} <= {tuple(r.values()) for r in before}


def test_passages_stage(stages):
    before, after = (rows_of(x) for x in stages[0]["passages"])

    def windows(rows):
        n = Counter()
        for r in rows:
            w = (r["text"] or "").lower().split() if r["doc_id"] is not None else []
            n.update(tuple(w[k : k + 50]) for k in range(len(w) - 49))
        return n

    was, now = windows(before), windows(after)
    assert any(n > 1 for n in was.values()) and all(n == 1 for n in now.values())
    clean = [r for r in before if not any(was[w] > 1 for w in windows([r]))]
    same = Counter((r["doc_id"], r["text"]) for r in after)
    assert all(same[r["doc_id"], r["text"]] for r in clean)
    assert all(len(r["text"] or "") == r["n_chars"] for r in after)


def test_mixing_stage(stages):
    before, after = (rows_of(x) for x in stages[0]["mixing"])
    size = lambda r: len((r["text"] or "").encode().split())
    plain = lambda rows: Counter(tuple(r.values()) for r in rows)
    assert not plain(after) - plain(before)
    total = sum(map(size, before))
    leaf = lambda r: (r["lang"], r["source"])
    longest = {leaf(r): 0 for r in before}
    for r in before:
        longest[leaf(r)] = max(longest[leaf(r)], size(r))
    assert int(0.9 * total) - sum(longest.values()) <= sum(map(size, after)) <= int(0.9 * total)
    assert mixing.LEVELS == ("domain", "lang", "source")


def test_tokens_stage(stages):
    import public_tokenizers
    import tiktoken

    from lattica.llm.bpe import read_ranks

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    before, after = (rows_of(x) for x in stages[0]["tokens"])
    want = Counter()
    for r in before:
        ids = np.array(enc.encode_ordinary(r["text"] or ""), "<u4")
        want[r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after) == want


def test_run_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert not P.run(spark, str(tmp_path)).count()


def test_executors_are_collected_as_a_whole_before_each_stage(spark, stages):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    dict(P.STAGES)["mixing"](spark, spark.createDataFrame(made(), SCHEMA), None)
    assert full() > before  # a local master's driver is the executor
