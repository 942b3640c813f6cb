"""Document log-likelihood by a gated recurrent language model in numpy.

Frequent words have ids; all others share one, whose probability is passed on to the single words by their counts, which are
taken over all training documents. The softmax is factored: a class, then a word of the class. All training documents are learned
from, in rounds over disjoint parts of them: tasks fit copies of the network on their rows, by backpropagation truncated to windows
with the state carried on, and the copies are averaged by their tokens. Scoring runs many documents in step and carries each one's
state through all of its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.tables import drop, keep, release, small_batches

#: Words with ids: so many times the cube root of the training tokens; the softmax has the square root of them as classes.
WORDS_FACTOR = 6
HIDDEN, WINDOW, STREAMS, ROUNDS, RATE, SEED = 16, 32, 192, 3, 0.01, 53
#: Largest logit that is told apart, far above what fits give: exponents of it do not overflow.
LOGIT = np.float32(60)
#: Windows that a stream has at least before there are more streams; tokens fitted at a time, and of a task in all rounds.
WINDOWS, FIT_TOKENS, TASK_TOKENS = 32, 1 << 18, 2_000_000
#: Tokens of a scoring window over all documents in step, and of the documents that are scored together; parameters in a row when
#: copies are averaged.
TOKENS, HELD_TOKENS, PART = 16_384, 4_000_000, 4_096


class Recurrent:
    """ids 0 to n - 1; counts of ids, most frequent first, set the classes and the first biases."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, classes: int | None = None, seed: int = SEED):
        rng, n = np.random.Generator(np.random.PCG64(seed)), len(counts)
        classes = classes or max(1, int(np.sqrt(n)))
        mass = np.cumsum(np.sqrt(counts + 1.0))
        self.cls = np.minimum((mass / mass[-1] * classes).astype(np.int64), classes - 1)
        self.cls = np.unique(self.cls, return_inverse=True)[1]
        self.first = np.searchsorted(self.cls, np.arange(self.cls[-1] + 2))
        share = (counts + 1.0) / (counts + 1.0).sum()
        per = np.add.reduceat(share, self.first[:-1])
        r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {"x": r(n, 3 * hidden), "u": r(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "wc": r(hidden, len(per)), "bc": np.log(per).astype(np.float32), "ww": r(n, hidden), "bw": np.log(share / per[self.cls]).astype(np.float32)}
        self.hidden = hidden

    def step(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state from the gates' inputs a, then what the gradient needs: both gates, candidate, its recurrent part."""
        k = self.hidden
        g = h @ self.p["u"]
        zr = a[:, : 2 * k] + g[:, : 2 * k]
        np.exp(np.negative(zr, zr), zr)
        zr += 1
        np.reciprocal(zr, zr)
        z, r, g = zr[:, :k], zr[:, k:], g[:, 2 * k :]
        c = r * g
        c += a[:, 2 * k :]
        np.tanh(c, c)
        new = h - c
        new *= z
        new += c
        return new, z, r, c, g

    def outputs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of y, and with grads the gradient by h of minus their sum."""
        p, cls, rows, fit = self.p, self.cls[y], np.arange(len(y)), grads is not None
        logits = h @ p["wc"]
        logits += p["bc"]
        out, dh = self._chosen(logits, cls, rows, fit), None
        if fit:
            grads["wc"] += h.T @ logits
            grads["bc"] += logits.sum(0)
            dh = logits @ p["wc"].T
        order = np.argsort(cls.astype(np.int16), kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(len(self.first)))
        h, y, got, back = h[order], y[order], np.zeros(len(y), h.dtype), np.zeros_like(h) if fit else None
        for c in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(self.first) > 1)):
            (a, b), (lo, hi) = bounds[c : c + 2], self.first[c : c + 2]
            logits = h[a:b] @ p["ww"][lo:hi].T
            logits += p["bw"][lo:hi]
            got[a:b] = self._chosen(logits, y[a:b] - lo, rows[: b - a], fit)
            if fit:
                grads["ww"][lo:hi] += logits.T @ h[a:b]
                grads["bw"][lo:hi] += logits.sum(0)
                back[a:b] = logits @ p["ww"][lo:hi]
        out[order] += got
        if fit:
            dh[order] += back
        return out, dh

    @staticmethod
    def _chosen(logits: np.ndarray, y: np.ndarray, rows: np.ndarray, fit: bool) -> np.ndarray:
        """Log-probability of y in each row; with fit, its gradient by the logits, with the sign turned, in place of them."""
        np.minimum(logits, LOGIT, logits)
        out = logits[rows, y]
        np.exp(logits, logits)
        total = logits.sum(1)
        if fit:
            logits *= (1 / total)[:, None]
            logits[rows, y] -= 1
        return out - np.log(total)

    def window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss, gradients and last state of a window: x, y (steps, streams), backpropagation no further than its start."""
        k, p = self.hidden, self.p
        grads = {n: np.zeros_like(v) for n, v in p.items()}
        states, kept, a = np.empty((len(x) + 1, *h.shape), h.dtype), [], p["x"][x] + p["b"]
        states[0] = h
        for t in range(len(x)):
            states[t + 1], *rest = self.step(a[t], states[t])
            kept.append(rest)
        loss, dh = self.outputs(states[1:].reshape(-1, k), y.ravel(), grads)
        dh, carry, da, dg = dh.reshape(len(x), -1, k), np.zeros_like(h), np.empty_like(a), np.empty_like(a)
        for t in reversed(range(len(x))):
            z, r, c, g = kept[t]
            d = dh[t] + carry
            dc = d * (1 - z) * (1 - c * c)
            da[t, :, :k] = d * (states[t] - c) * z * (1 - z)
            da[t, :, k : 2 * k] = dc * g * r * (1 - r)
            da[t, :, 2 * k :] = dc
            dg[t] = da[t]
            dg[t, :, 2 * k :] *= r
            carry = d * z + dg[t] @ p["u"].T
        da = da.reshape(-1, 3 * k)
        grads["u"] += states[:-1].reshape(-1, k).T @ dg.reshape(-1, 3 * k)
        grads["b"] += da.sum(0)
        order = np.argsort(x.ravel(), kind="stable")
        words = x.ravel()[order]
        new = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        grads["x"][words[new]] = np.add.reduceat(da[order], new, axis=0)
        return -float(loss.sum()), grads, states[-1]

    def fit(self, stream: np.ndarray, memory: dict, streams: int = STREAMS, window: int = WINDOW, rate: float = RATE) -> None:
        """One pass over a stream of ids, cut into as many parallel ones as are at least WINDOWS windows long; memory holds the
        mean squares of the gradients, by which steps are divided, from call to call."""
        streams = max(1, min(streams, len(stream) // (window * WINDOWS)))
        n = (len(stream) - 1) // streams
        if n < 1:
            return
        x, y = (np.ascontiguousarray(stream[k : k + n * streams].reshape(streams, n).T) for k in (0, 1))
        if not memory:
            memory |= {k: np.zeros_like(a) for k, a in self.p.items()} | {"": 0}
        h = np.zeros((streams, self.hidden), np.float32)
        for at in range(0, n, window):
            _, grads, h = self.window(x[at : at + window], y[at : at + window], h)
            memory[""] += 1
            known = 1 / (1 - 0.99 ** memory[""])
            for k, g in grads.items():
                g *= np.float32(window / x[at : at + window].size)
                square = g * g
                square -= memory[k]
                square *= np.float32(0.01)
                memory[k] += square
                np.multiply(memory[k], np.float32(known), square)
                np.sqrt(square, square)
                square += np.float32(1e-5)
                g /= square
                g *= np.float32(rate)
                self.p[k] -= g

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.p.values()])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for k, a in self.p.items():
            self.p[k] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size

    def score(self, flat: np.ndarray, off: np.ndarray, begin: int, window: int = WINDOW) -> np.ndarray:
        """Natural log-probability of each document's ids flat[off[k] : off[k + 1]]; state and first input are those after a document's end."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        out, h, first, long = np.zeros(len(size)), np.zeros((len(size), self.hidden), np.float32), off[order], size[order]
        gates = self.p["x"] + self.p["b"]
        at, most = 0, int(size.max(initial=0))
        while at < most:
            hs, ys, who, held = [], [], [], 0
            for t in range(at, min(at + window, most)):
                m = int(np.searchsorted(-long, -t, "left"))
                if held and held + m > TOKENS:
                    break
                held, at = held + m, t + 1
                x = flat[first[:m] + t - 1] if t else np.full(m, begin)
                h[:m] = new = self.step(gates[x], h[:m])[0]
                hs.append(new)
                ys.append(flat[first[:m] + t])
                who.append(np.arange(m))
            got, _ = self.outputs(np.concatenate(hs), np.concatenate(ys))
            out[: len(who[0])] += np.bincount(np.concatenate(who), got, len(who[0]))
        back = np.empty(len(size))
        back[order] = out
        return back


def _text(docs: DataFrame) -> DataFrame:
    part = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(5)) == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), part.alias("held_out"))


def _hashes(column: pa.Array):
    raw, off = A.string_bytes(column)
    for a, b in A.slices(off):
        w = A.Words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        yield a, b, w.hashes(), w


class Vocabulary:
    """Ids of frequent words, by their hashes; `end` is the id of a document's end, `rest` that of all other words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, ends: int, others: int):
        every = np.concatenate([counts, [ends, others]]).astype(np.float64)
        order = np.argsort(-every, kind="stable")  # ids by count, so that classes hold words of similar counts
        name = np.empty(len(order), np.int64)
        name[order] = np.arange(len(order))
        at = np.argsort(hashes)
        self.hashes, self.names, self.counts = hashes[at], name[at], every[order]
        self.end, self.rest = int(name[-2]), int(name[-1])

    def ids(self, h: np.ndarray, w: A.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether a word is frequent, ids with an end after each row, where the rows begin in them)."""
        k = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        hit = self.hashes[k] == h if len(self.hashes) else np.zeros(len(h), bool)
        flat = np.full(len(h) + w.rows, self.end)
        flat[np.arange(len(h)) + w.row] = np.where(hit, self.names[k], self.rest) if len(self.hashes) else self.rest
        return hit, flat, np.concatenate([[0], np.cumsum(w.count + 1)])


def fit_round(rows: DataFrame, model: Recurrent, words: Vocabulary, tasks: int) -> None:
    """Fits copies of the model on the texts of rows, a copy a task, and puts their average, weighted by tokens, into the model."""
    shared = rows.sparkSession.sparkContext.broadcast((model, words))

    def fit(batches):
        (net, names), memory, held, size, seen = shared.value, {}, [], 0, 0
        net.put(net.flat().copy())
        for batch in batches:
            for _, _, h, w in _hashes(batch.column(0)):
                held.append(names.ids(h, w)[1])
                size += len(held[-1])
                if size >= FIT_TOKENS:
                    net.fit(np.concatenate([[names.end], *held]), memory)
                    held, size, seen = [], 0, seen + size
        if size:
            net.fit(np.concatenate([[names.end], *held]), memory)
        if seen + size:
            flat = net.flat()
            for no, at in enumerate(range(0, len(flat), PART)):
                yield pa.RecordBatch.from_pydict({"no": [no], "weight": [float(seen + size)], "part": [flat[at : at + PART].tobytes()]})

    def mean(batches):
        now, total, weight = None, None, 0.0
        for batch in batches:
            for no, w, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if no != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"no": [now], "part": [(total / weight).astype(np.float32).tobytes()]})
                    now, total, weight = no, 0.0, 0.0
                total, weight = total + w * np.frombuffer(part, np.float32).astype(float), weight + w
        if now is not None:
            yield pa.RecordBatch.from_pydict({"no": [now], "part": [(total / weight).astype(np.float32).tobytes()]})

    copies = rows.select("text").coalesce(tasks).mapInArrow(A.tidy(fit), "no long, weight double, part binary")
    got = copies.repartition("no").sortWithinPartitions("no").mapInArrow(A.tidy(mean), "no long, part binary").toArrow().sort_by("no")
    shared.destroy()
    if got.num_rows:
        model.put(np.frombuffer(b"".join(got["part"].to_pylist()), np.float32))


def language_model_scores(docs: DataFrame, factor: float = WORDS_FACTOR, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    Held out are rows whose crc32 of the id as text, modulo 5, is 1; everything is learned from the others, rows with null ids
    among them. Null texts count as empty: their one token is the end. Rows repeated whole are scored alike. Without a training
    row all counts are 0. Scores are log10 probabilities; base_score that of single tokens by their counts. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = _text(docs)

    def count(batches):
        for batch in batches:
            found = [h for _, _, h, _ in _hashes(batch.column(0))]
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    known = text.where("not held_out")
    counts = keep(known.select("text").mapInArrow(A.tidy(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "counts")
    ends = known.count()
    totals = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n_all, v_all = totals[1] + ends, totals[0] + (ends > 0)
    top = counts.orderBy(F.desc("c"), "h").limit(int(factor * n_all ** (1 / 3))).toArrow()
    top_c = top["c"].to_numpy()
    n_rest, v_rest = totals[1] - int(top_c.sum()), totals[0] - len(top_c)
    words = Vocabulary(top["h"].to_numpy().view(np.uint64), top_c, ends, n_rest)
    model = Recurrent(words.counts)
    for k in range(rounds if n_all else 0):
        release(docs.sparkSession)
        fit_round(known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(rounds)) == k), model, words, max(1, n_all // TASK_TOKENS))
    log_c = np.log10(words.counts + 0.5)
    shared = docs.sparkSession.sparkContext.broadcast((model, words))

    def score(batches):
        net, names = shared.value
        held, size = [], 0
        for batch in batches:  # many at a time, as the longest documents go on alone at the end
            if not batch.num_rows:
                continue
            held.append(read(batch, names))
            size += sum(map(len, held[-1][1]))
            if size >= HELD_TOKENS:
                yield from scored(held, net, names)
                held, size = [], 0
        yield from scored(held, net, names)

    def scored(held, net, names):
        if not held:
            return
        every = np.concatenate([x for _, ids, _, _ in held for x in ids] or [np.zeros(0, np.int32)])
        counts_ = [np.concatenate([r[0] for r in rows]) for _, _, rows, _ in held]
        got = net.score(every, np.concatenate([[0], np.cumsum(np.concatenate(counts_))]), names.end) / np.log(10)
        at = 0
        for (ids, _, rows, rare), own in zip(held, counts_, strict=True):
            n, found, base, tail = (np.concatenate(x) for x in zip(*rows, strict=True))
            h, k, per = (np.concatenate(x) for x in zip(*rare, strict=True))
            of = np.concatenate([[0], np.cumsum(per)])
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x) for x in (n, found, base, got[at : at + len(own)], tail)), A.list_array(h, of, pa.int64()), A.list_array(k, of, pa.int32())], ["doc_id", "held_out", "n", "known", "base", "lm", "tail", "hs", "ks"])
            at += len(own)

    def read(batch, names):
        rows, ids, rare = [], [], []
        for _, _, h, w in _hashes(batch.column(1)):
            hit, flat, off = names.ids(h, w)
            few = np.bincount(w.row, ~hit, w.rows).astype(np.int64)
            base = np.bincount(w.row, np.where(hit, log_c[flat[np.arange(len(h)) + w.row]], 0.0), w.rows) + log_c[names.end]
            rows.append((w.count + 1, w.count - few + (ends > 0), base, few))
            ids.append(flat.astype(np.int32))
            h, row = h[~hit], w.row[~hit]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
            rare.append((h[new].view(np.int64), np.diff(np.append(new, len(h))), np.bincount(row[new], minlength=w.rows)))
        return (batch.column(0), batch.column(2)), ids, rows, rare

    release(docs.sparkSession)
    own = text.select("doc_id", "text", "held_out").mapInArrow(A.tidy(score), "doc_id long, held_out boolean, n long, known long, base double, lm double, tail long, hs array<long>, ks array<int>")
    own = keep(own.withColumn("row", F.monotonically_increasing_id()), "scores")  # the ids of rows are fixed once they are written
    shared.destroy()
    tail = own.select("row", F.explode(F.arrays_zip("hs", "ks")).alias("x")).select("row", F.col("x.hs").alias("h"), F.col("x.ks").alias("k")).join(counts, "h", "left")
    sums = tail.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("t"))
    both = own.drop("hs", "ks").join(sums, "row", "left").withColumns({"s": F.coalesce("s", F.lit(0.0)), "t": F.coalesce("t", F.lit(0))})
    size, size_rest = float(np.log10(n_all + 0.5 * (v_all + 1))), float(np.log10(n_rest + 0.5 * (v_rest + 1)))
    out = both.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.col("t")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.col("s") - F.col("n") * size).alias("base_score"), (F.col("lm") + F.col("s") - F.col("tail") * size_rest).alias("score"))
    out = keep(out, "result")
    drop(own)
    drop(counts)
    return out
