"""Toxicity by a weighted lexicon: folded text is matched by an Aho-Corasick automaton, and weights are set off against length.

Folding lower-cases, takes accents off, maps look-alike letters of other scripts and digits inside words to Latin letters.
Terms are whole words or beginnings of words, learned with their weights from labelled rows; phrases in which a term stands
for nothing bad are exceptions.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm.learn import Logistic, lowest, sigmoid

#: Bounds of the sample that the lexicon and the weights are fitted on.
TOXIC_ROWS, CLEAN_ROWS, TERMS, SEED = 5_000, 7_500, 3_000, 23
MIN_PREFIX, MAX_PREFIX = 3, 10
#: A term must be in this share of toxic rows, three at least, and as much likelier in toxic rows as e to the power LEAST_WEIGHT.
LEAST_SHARE, LEAST_ROWS, LEAST_WEIGHT = 0.002, 3, 2.5
PREDICT = 0.3

# Letters of other scripts that look like Latin ones, then digits and signs that stand for letters.
LOOK_ALIKE = dict(zip("аеорсухкіјѕԁһґԛԝαβεικνορτυχηωɑɡıƒłøðþ", "aeopcyxkijsdhrqwabeiknoptuxnwagiflodp", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """Translation of characters, filled as they come."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        out = "".join(LOOK_ALIKE.get(x, x) for x in base)
        self[code] = out = out if out and all(x.isalnum() or x in DIGITS for x in out) else "" if unicodedata.category(c) in ("Mn", "Cf") else " "
        return out


_FOLD = _Fold()
_SIGNS = str.maketrans(DIGITS)


def _word(w: str) -> str:
    return w.translate(_SIGNS).strip() if not w.isalpha() and any(c.isalpha() for c in w) else w


def fold(text: str) -> str:
    """Folded words between single spaces, with a space at both ends."""
    words = text.translate(_FOLD).split()
    if any(not w.isalpha() for w in words):
        words = [_word(w) for w in words]
    return " " + " ".join(words) + " " if words else " "


@dataclass
class Lexicon:
    """terms: " word " or " beginning", with weights; exceptions: phrases " a b " in which terms do not count; model: weights of
    total, total by length and number of hits."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    model: Logistic | None = None

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for t in self.exceptions:
            a.add_word(t, (len(t), None))
        a.make_automaton()
        return a


def hits(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, float]]:
    """(place, weight) of each word that a term matches, the largest weight of a word; none inside exceptions."""
    best: dict[int, float] = {}
    free = []
    if len(automaton):
        for end, (size, w) in automaton.iter(folded):
            at = end - size + 1
            if w is None:
                free.append((at, end))
            elif w > best.get(at, 0.0):
                best[at] = w
    if not free:
        return list(best.items())
    free.sort()
    starts, reach = [a for a, _ in free], list(accumulate((e for _, e in free), max))
    return [(k, w) for k, w in best.items() if not (n := bisect.bisect_right(starts, k)) or reach[n - 1] <= k]


def columns(found: list[tuple[int, float]], words: int) -> list[float]:
    total = sum(w for _, w in found)
    return [np.log1p(total), total / np.sqrt(words + 10.0), 10 * total / (words + 10.0), np.log1p(len(found))]


def _terms(text: str) -> set[str]:
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(MIN_PREFIX, min(MAX_PREFIX, len(w)) + 1))
    return out


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon | None:
    """Learns terms, exceptions and weights from at most TOXIC_ROWS and CLEAN_ROWS rows of labels (doc_id, toxic); None without both."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = lowest(known.where("y = 1"), TOXIC_ROWS, SEED).unionByName(lowest(known.where("y = 0"), CLEAN_ROWS, SEED))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text.join(F.broadcast(ids), "doc_id").persist()
    sizes = dict(rows.groupBy("y").count().collect())
    if len(sizes) < 2:
        rows.unpersist()
        return None

    def count(only: frozenset | None):
        def run(batches):
            total = Counter()
            for batch in batches:
                for t in batch.column("text").to_pylist():
                    total.update(_terms(t) if only is None else _terms(t) & only)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

        return run

    def totals(y: int, only: frozenset | None, least: float) -> dict[str, int]:
        got = rows.where(F.col("y") == y).mapInArrow(count(only), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return dict(got.collect())  # of a bounded sample

    toxic = totals(1, None, max(LEAST_ROWS, LEAST_SHARE * sizes[1]))
    clean = totals(0, frozenset(toxic), 1)
    weight = {t: float(np.log((n + 0.5) / (sizes[1] + 1)) - np.log((clean.get(t, 0) + 0.5) / (sizes[0] + 1))) for t, n in toxic.items()}
    terms: dict[str, float] = {}
    for t in sorted((t for t, w in weight.items() if w >= LEAST_WEIGHT), key=lambda t: (len(t.rstrip()), t)):
        shorter = [terms[t[:k]] for k in range(2, len(t)) if t[:k] in terms]
        if not shorter or weight[t] > max(shorter) + 0.5:
            terms[t] = weight[t]
    terms = dict(sorted(terms.items(), key=lambda x: (-x[1] * toxic[x[0]], x[0]))[:TERMS])
    plain = Lexicon(terms, [f" {fold(x).strip()} " for x in exceptions])
    phrases = _phrases(rows, plain)
    lexicon = Lexicon(terms, sorted({*plain.exceptions, *phrases}))
    got = rows.select("doc_id", "y", "text").mapInArrow(_scan(lexicon, lambda x, b: pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])), "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x, y = np.stack(got["x"].to_numpy(zero_copy_only=False)), got["y"].to_numpy().astype(float)
    lexicon.model = Logistic(1.0).fit(x, y)
    rows.unpersist()
    return lexicon


def _phrases(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Pairs of a matched word and its neighbour that are in three clean rows at least and in no toxic one."""

    def run(batches):
        auto, total = lexicon.automaton(), Counter()
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                f = fold(t)
                for at, _ in hits(f, auto):
                    before, after = f[:at].split(" ")[-1], f[at + 1 :].split(" ", 2)[:2]
                    total.update({(y, f" {before} {after[0]} "), (y, f" {after[0]} {after[1]} ")} if before and len(after) > 1 and after[1] else set())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[1] for k in total]), pa.array([v if k[0] else 0 for k, v in total.items()], pa.int64()), pa.array([0 if k[0] else v for k, v in total.items()], pa.int64())], ["phrase", "bad", "good"])

    got = rows.select("y", "text").mapInArrow(A.tidy(run), "phrase string, bad long, good long").groupBy("phrase").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return [r.phrase for r in got.where("bad = 0 and good >= 3").orderBy(F.desc("good"), "phrase").limit(TERMS).collect()]


def _scan(lexicon: Lexicon, make):
    def run(batches):
        auto = lexicon.automaton()
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            folded = [fold(t or "") for t in batch.column("text").to_pylist()]
            yield make([columns(hits(f, auto), f.count(" ") - 1) for f in folded], batch)

    return run


def toxicity(docs: DataFrame, lexicon: Lexicon | None) -> DataFrame:
    """(doc_id, score, hits) for each row of docs (doc_id, text); null texts count as empty. Score: probability of being toxic.

    Without a lexicon (nothing to learn from) scores are 0. Only the text has a part in the score.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if lexicon is None:
        return text.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("hits"))

    def make(x, batch):
        x = np.array(x)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(lexicon.model.logit(x))), pa.array(np.round(np.expm1(x[:, 3])).astype(np.int32))], ["doc_id", "score", "hits"])

    return text.mapInArrow(_scan(lexicon, make), "doc_id long, score double, hits int")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, hits) for each row of docs (doc_id, text): learned only from rows of labels (doc_id, toxic)
    whose crc32 of the id as text, modulo 4, is not 2.

    Null and empty texts have no hits and a score all the same; rows with null ids and repeated rows are scored like all others. Of
    different labels of one id 1 counts; labels that are null or neither 0 nor 1, or of no document, are ignored. Without rows of both
    labels scores are 0. An empty table gives an empty one; other columns are ignored.
    """
    part = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(4))
    lexicon = learn(docs, labels.where(part != 2))
    out = toxicity(docs, lexicon)
    return out.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "hits")
