"""Quality classifier by co-training: one model of what a text says, one of what its record and layout look like.

Both start from a bounded sample of labelled rows. In rounds each model labels, of all other documents, those that it is surest of
for the other one. At the end both are calibrated on held-out labelled rows and combined, and all documents are scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.learn import Logistic, sigmoid
from lattica.llm.tables import BROADCAST_ROWS, drop, keep, small_batches

#: Bound of the sample of labelled rows that the classifiers are fitted on.
LABELLED_ROWS = 6_000
#: Rounds, pseudo-labels of a view in each, the logit from which on one is sure (a probability of 0.97), steps a unit of it.
ROUNDS, PER_ROUND, SURE, STEPS, SEED = 4, 400, 3.476, 256, 17
BIGRAMS, SOURCES, LANGS = 128, 16, 8
#: A document is accepted from this probability of good quality on.
ACCEPT = 0.4

_CLASS = np.zeros(256, np.int64)  # 0 other, then letters and marks that layouts differ in
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 3, 4
for _k, _chars in enumerate(("!?", ".,;:", "|", "$%&*#@^~", "'\"()[]{}<>=/\\+-_"), 5):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[[32, 9, 10, 11, 12, 13]] = 10
CLASSES = 11


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(raw: np.ndarray, off: np.ndarray, source: list, lang: list) -> tuple[np.ndarray, np.ndarray]:
    """(content, metadata) columns of some rows. Content: pairs of bytes, kinds of characters, repeated words. Metadata:
    source, language, sizes, lines."""
    rows, size = len(off) - 1, np.diff(off)
    row = np.repeat(np.arange(rows), size)
    kinds = np.bincount(row * CLASSES + _CLASS[raw], minlength=rows * CLASSES).reshape(rows, CLASSES).astype(float)
    pair = (A.LOWER[raw[:-1]].astype(np.uint32) * 251 + A.LOWER[raw[1:]].astype(np.uint32) * 31) % BIGRAMS if len(raw) > 1 else np.zeros(0, np.uint32)
    same = row[:-1] == row[1:] if len(raw) > 1 else np.zeros(0, bool)
    grams = np.bincount(row[:-1][same] * BIGRAMS + pair[same], minlength=rows * BIGRAMS).reshape(rows, BIGRAMS) if len(raw) > 1 else np.zeros((rows, BIGRAMS))
    w = A.Words(raw, off)
    h = w.hashes()
    n = w.count.astype(float)
    repeat = np.zeros(rows)
    if len(h) > 1:
        again = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
        repeat = np.bincount(w.row[1:][again], minlength=rows)
    _, o = A.distinct_sets(h, w.row, rows)
    lines = np.bincount(row[raw == 10], minlength=rows) + 1.0
    content = np.column_stack([_ratio(kinds, size[:, None]), _ratio(kinds[:, 5:10], n[:, None]), _ratio(kinds[:, 1], kinds[:, 1] + kinds[:, 2]), _ratio(repeat, n), _ratio(np.diff(o), n), _ratio(size, n), np.log1p(_ratio(grams * 1000.0, size[:, None]))])
    hot = np.zeros((rows, SOURCES + LANGS))
    hot[np.arange(rows), [zlib.crc32((s or "").encode()) % SOURCES for s in source]] = 1
    hot[np.arange(rows), [SOURCES + zlib.crc32((s or "").encode()) % LANGS for s in lang]] = 1
    meta = np.column_stack([hot, np.log1p(size), np.log1p(n), np.log(lines), np.log1p(_ratio(size, lines)), _ratio(size, n), size == 0])
    return content, meta


def _batches(batch: pa.RecordBatch):
    raw, off = A.string_bytes(batch.column("text"))
    source, lang = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
    for a, b in A.slices(off):
        yield a, b, *features(raw[off[a] : off[b]], off[a : b + 1] - off[a], source[a:b], lang[a:b])


@dataclass
class Quality:
    """Fitted models; combine holds weights of both calibrated logits and a constant."""

    content: Logistic
    meta: Logistic
    combine: np.ndarray

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.logit(content), self.meta.logit(meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.combine[0] * a + self.combine[1] * b + self.combine[2])


def fit_view(x: np.ndarray, y: np.ndarray, extra: tuple[np.ndarray, np.ndarray]) -> Logistic:
    """A view's model from labelled rows and pseudo-labelled ones, which weigh half."""
    return Logistic(3.0).fit(np.vstack([x, extra[0]]), np.concatenate([y, extra[1]]), np.concatenate([np.ones(len(y)), np.full(len(extra[1]), 0.5)]))


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, surest) -> Quality | None:
    """y: 0 or 1 for each labelled row. None if a class is missing. A fifth of the labelled rows only calibrates.

    surest(models, share) gives for each view the columns of both views and the labels of the rows that its model is surest of, share
    of them good; they are what the other view learns from in the next round.
    """
    if len(np.unique(y)) < 2:
        return None
    held = np.arange(len(y)) % 5 == 0
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False
    views = [content, meta]
    extra = [(np.zeros((0, x.shape[1])), np.zeros(0)) for x in views]
    fit = lambda: [fit_view(views[v][~held], y[~held], extra[v]) for v in (0, 1)]
    models = fit()
    for _ in range(ROUNDS):
        found = surest(models, float(y[~held].mean()))
        if not any(len(f[2]) for f in found):
            break
        for v, f in enumerate(found):
            rows, labels = extra[1 - v]
            extra[1 - v] = (np.vstack([rows, f[1 - v]]), np.concatenate([labels, f[2]]))
        models = fit()
    on = held if held.any() else ~held
    both = Logistic(1.0).fit(np.column_stack([models[0].logit(content[on]), models[1].logit(meta[on])]), y[on])
    weights = np.maximum(both.w[:2] / both.scale, 0)
    constant = both.w[2] - (both.w[:2] / both.scale) @ both.mean
    return Quality(models[0], models[1], np.append(weights, constant))


def fit_quality(docs: DataFrame, labels: DataFrame) -> Quality | None:
    """Fits on at most LABELLED_ROWS rows of labels (doc_id, quality); of different labels of one id 1 counts. All other documents are
    the pool: each round every one of them is scored, and the PER_ROUND surest of a view go to the other."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))

    def run(batches):
        for batch in batches:
            for a, b, content, meta in _batches(batch):
                x = np.hstack([content, meta]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), A.binary_array(x, np.arange(b - a + 1) * x.shape[1] * 4)], ["doc_id", "x"])

    rows_kept = rows = keep(_plain(docs).mapInArrow(A.tidy(run), "doc_id long, x binary"), "features")
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(known) if few else known, "doc_id", "left")
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id"), F.xxhash64("x")]
    got = rows.where("y is not null").orderBy(*order).limit(LABELLED_ROWS).toArrow()
    if not got.num_rows:
        drop(rows_kept)
        return None
    unpack = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(float)
    x, y, used = unpack(got["x"]), got["y"].to_numpy().astype(float), np.zeros(0, np.int64)
    cut = x.shape[1] - (SOURCES + LANGS + 6)
    pool = rows.where("y is null and doc_id is not null").select("doc_id", "x")

    def surest(models: list[Logistic], share: float) -> list:
        nonlocal used
        taken = used

        def surer(batches, least: dict | None):
            """How sure the views are of pool rows, by slot: counts by STEPS of the logit, or with least the rows from a step on."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                raw, _ = A.string_bytes(batch.column(1).cast(pa.large_binary()))
                z, ids = raw.view(np.float32).reshape(batch.num_rows, -1).astype(float), batch.column(0).to_numpy()
                free = ~np.isin(ids, taken)
                for v, part in enumerate((z[:, :cut], z[:, cut:])):
                    at = models[v].logit(part)
                    for label, how in ((1, at), (0, -at)):
                        step = np.floor(how * STEPS).astype(np.int64)
                        k = np.flatnonzero(free & (how >= SURE) & (step >= (least or {}).get(2 * v + label, 0)))
                        if least is None:
                            found, n = np.unique(step[k], return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), 2 * v + label, np.int32)), pa.array(found), pa.array(n)], ["slot", "step", "n"])
                        elif 2 * v + label in least:
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), 2 * v + label, np.int32)), pa.array(how[k]), batch.column(0).take(pa.array(k)), batch.column(1).take(pa.array(k))], ["slot", "sure", "doc_id", "x"])

        most = {2 * v + label: int(PER_ROUND * (share if label else 1 - share)) + 1 for v in (0, 1) for label in (0, 1)}
        # the step from which on there are enough rows, so that few go to one task
        steps = pool.mapInArrow(A.tidy(lambda b: surer(b, None)), "slot int, step long, n long").groupBy("slot", "step").agg(F.sum("n").alias("n")).collect()
        least: dict[int, int] = {}
        for s in most:
            held = 0
            for r in sorted((r for r in steps if r["slot"] == s), key=lambda r: -r["step"]):
                held += r.n
                least[s] = r["step"]
                if held >= most[s]:
                    break
        top = Window.partitionBy("slot").orderBy(F.desc("sure"), "doc_id", F.xxhash64("x"))
        best = pool.mapInArrow(A.tidy(lambda b: surer(b, least)), "slot int, sure double, doc_id long, x binary").withColumn("r", F.row_number().over(top)).where(F.col("r") <= max(most.values()))
        got = best.toArrow().sort_by([("slot", "ascending"), ("r", "ascending")])
        slot, ids, place = (got[c].to_numpy() for c in ("slot", "doc_id", "r"))
        own = place <= np.array([most[int(s)] for s in slot], np.int64) if len(slot) else place > 0
        own &= np.arange(len(ids)) == np.unique(ids, return_index=True)[1][np.unique(ids, return_inverse=True)[1]] if len(ids) else own
        z = unpack(got["x"]) if len(ids) else np.zeros((0, x.shape[1]))
        used = np.concatenate([used, ids[own]])
        return [(z[k, :cut], z[k, cut:], (slot[k] % 2).astype(float)) for k in (own & (slot // 2 == v) for v in (0, 1))]

    model = co_train(x[:, :cut], x[:, cut:], y, surest)
    drop(rows_kept)
    return model


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, content_score, metadata_score, score, accepted) for each row of docs (doc_id, text, lang, source).

    Scores are probabilities of good quality. Null texts count as empty, null languages and sources as unnamed ones. Without
    labelled rows of both classes nothing can be learned: scores are null and everything is accepted.
    """
    model = fit_quality(docs, labels)

    def run(batches):
        for batch in batches:
            for a, b, content, meta in _batches(batch):
                got = model.score(content, meta)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(x) for x in got), pa.array(got[2] >= accept)], ["doc_id", "content_score", "metadata_score", "score", "accepted"])

    schema = "doc_id long, content_score double, metadata_score double, score double, accepted boolean"
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.lit(None).cast("double").alias(c) for c in ("content_score", "metadata_score", "score")), F.lit(True).alias("accepted"))
    return _plain(docs).mapInArrow(A.tidy(run), schema)


def accepted_documents(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns; null texts count as empty, and rows repeated whole or
    without an id are judged like all others. All rows if nothing can be learned."""
    model = fit_quality(docs, labels)
    if model is None:
        return docs

    def run(batches):
        for batch in batches:
            for a, b, content, meta in _batches(batch):
                yield batch.slice(a, b - a).filter(pa.array(model.score(content, meta)[2] >= accept))

    return docs.mapInArrow(A.tidy(run), docs.schema)
