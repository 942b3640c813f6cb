"""Mixing sources to target weights: budgets of tokens go down a tree of domains, languages and sources.

A node's budget is split among its children by weight; what a child cannot use goes to its siblings, and only what none of
them can use goes up to the ancestors. A leaf's budget is met by whole epochs and by a prefix, counted in tokens, of one more
epoch in a seeded order. Nothing but totals of leaves reaches the driver, and no leaf is sorted as a whole: sums by ranges of
the order find the range in which the prefix ends, and only that one is put in order.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.tables import drop, keep

LEVELS = ("domain", "lang", "source")
SEED = 29
#: Most leaves that a tree may have; it is a table of settings, of which the driver holds one row a leaf.
MAX_LEAVES = 200_000
HEX = "0123456789abcdef"


def domain_of(source: Column, domains: int = 3) -> Column:
    """A domain for sources that name none: the first digit of a hash, modulo `domains` (16 at most)."""
    digit = F.instr(F.lit(HEX), F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)) - 1
    return F.concat(F.lit("d"), F.pmod(digit, F.lit(domains)).cast("string"))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill(budget: int, weights: list, room: list[int]) -> list[int]:
    """Splits budget by weight; what one has no room for goes to the others by weight. Whole numbers, rounded down but for the
    largest remainders, ties by place; the sum is the budget, or all room of those that weigh anything. Exact for whole weights."""
    given, open_ = [0] * len(room), [k for k in range(len(room)) if room[k] > 0 and weights[k] > 0]
    left = min(budget, sum(room[k] for k in open_))
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] >= room[k] * total]
        if not full:
            parts = [divmod(left * weights[k], total) for k in open_]
            for k, (whole, _) in zip(open_, parts, strict=True):
                given[k] = int(whole)
            for i in sorted(range(len(open_)), key=lambda i: (-parts[i][1], i))[: left - sum(given[k] for k in open_)]:
                given[open_[i]] += 1
            return given
        for k in full:
            given[k] = room[k]
            left -= room[k]
        open_ = [k for k in open_ if k not in full]
    return given


def budgets(leaves: dict[tuple, int], budget: int, weights: dict[tuple, float], epochs: int, alpha: float) -> dict[tuple, int]:
    """Tokens for each leaf (a path). Children of a node weigh what `weights` says, and 0 if only siblings of theirs are named there;
    where none is named, each weighs its tokens to the power alpha."""
    out: dict[tuple, int] = {}

    def down(path: tuple, own: dict[tuple, int], amount: int) -> None:
        depth = len(path)
        if depth == len(next(iter(own))):
            out[path] = amount
            return
        parts: dict[tuple, dict] = {}
        for leaf, n in sorted(own.items()):
            parts.setdefault(leaf[: depth + 1], {})[leaf] = n
        sums = [sum(p.values()) for p in parts.values()]
        named = [weights.get(k) for k in parts]
        w = [x or 0 for x in named] if any(x is not None for x in named) else [s if alpha == 1 or not s else s**alpha for s in sums]
        for (k, p), amount_k in zip(parts.items(), fill(amount, w, [s * epochs for s in sums]), strict=True):
            down(k, p, amount_k)

    if leaves:
        down((), leaves, budget)
    return out


def mix(docs: DataFrame, share: float = 0.5, weights: dict[tuple, float] | None = None, epochs: int = 2, alpha: float = 1, seed: int = SEED, levels: tuple = LEVELS, add: tuple = ("tokens", "epoch")) -> DataFrame:
    """The chosen rows of docs (doc_id, text, and the levels of the tree: names or columns), a row for each epoch. Columns with the
    names in `add` are added, for the tokens and the epoch; with add=() docs' columns stay as they are.

    The budget is `share` of all tokens. weights: of nodes, by path from the domain down; see budgets(). epochs: how often a row
    may occur at most. A leaf's last epoch takes rows in the order of md5('seed:epoch:doc_id'), ties by doc_id, as long as their
    tokens fit; rows with the same id come or go together. Null texts have no tokens, null names and ids count as ''. Rows of
    leaves without any token never occur. Raises ValueError beyond MAX_LEAVES leaves. Columns of docs that are named as in `add`
    are replaced, all others kept, whatever their names. An empty table gives an empty one.
    """
    tag = "_"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    a, b, c, key, n, whole, rest, h, end, last, till, upto, times, no = (tag + x for x in ("a", "b", "c", "id", "n", "whole", "rest", "h", "end", "last", "till", "upto", "times", "no"))
    names = [a, b, c]
    level = {x: F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")) for x, col in zip(names, levels, strict=True)}
    own = {**level, key: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), n: tokens_of(F.col("text"))}
    light = keep(docs.select(*(e.alias(x) for x, e in own.items())), "tokens")
    got = light.groupBy(*names).agg(F.sum(n).alias("n"), F.count("*").alias("rows")).limit(MAX_LEAVES + 1).collect()
    if len(got) > MAX_LEAVES:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves")
    leaves = {(r[a], r[b], r[c]): r.n for r in got}
    target = budgets(leaves, int(share * sum(leaves.values())), weights or {}, epochs, alpha)
    rows = [(*k, target[k] // leaves[k], target[k] % leaves[k]) for k in leaves if leaves[k]]
    # as an Arrow table: rows of Python objects would start further Python workers on all executors
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    plan = pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[*names, whole, rest])
    plan = F.broadcast(docs.sparkSession.createDataFrame(plan))
    # as many ranges of the order as each of them then has rows, about
    digits = max(1, math.ceil(math.log(max(sum(r.rows for r in got), 2), 16) / 2))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(whole).cast("string"), F.col(key)).cast("binary"))
    ranged = F.substring(h, 1, digits)
    at = light.join(plan, names).withColumn(h, place)
    sums = at.groupBy(*names, rest, ranged.alias(end)).agg(F.sum(n).alias(n))
    sums = sums.withColumn(upto, F.sum(n).over(Window.partitionBy(*names).orderBy(end)))
    ends = keep(sums.where(F.col(upto) > F.col(rest)).groupBy(*names).agg(F.min(end).alias(end), (F.min(F.struct(end, (F.col(upto) - F.col(n)).alias("before")))["before"]).alias(till)), "ends")
    inside = at.join(F.broadcast(ends), names).where(ranged == F.col(end))
    fit = inside.groupBy(*names, h, key, rest, till).agg(F.sum(n).alias(n))
    fit = fit.withColumn(upto, F.sum(n).over(Window.partitionBy(*names).orderBy(h, key))).where(F.col(till) + F.col(upto) <= F.col(rest))
    cut = fit.groupBy(*names).agg(F.max(F.struct(h, key)).alias(last))
    cuts = keep(ends.join(cut, names, "left").select(*names, end, last), "cuts")
    here = docs.withColumns(own)
    here = here.join(plan, names).join(F.broadcast(cuts), names, "left").withColumn(h, place)
    part = F.col(end).isNotNull() & ((ranged < F.col(end)) | (F.col(last).isNotNull() & (F.struct(h, key) <= F.col(last))))
    here = here.withColumn(times, F.col(whole) + F.coalesce(part, F.lit(False)).cast("long")).where(F.col(times) > 0)
    out = here.withColumn(no, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    drop(light)
    return out.select(*(x for x in docs.columns if x not in add), *(F.col(x).alias(y) for x, y in zip((n, no), add, strict=False)))
