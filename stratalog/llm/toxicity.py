"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, text_of, trimmed
from .shingles import span_hashes, text_bytes, word_spans

SPACE_BITS = 18
STEMS = (4, 5)  # bytes of a word's start that are terms too, since inflected insults share a stem
FOLDS, HELD_OUT = 4, 2
TEXTS = 256  # hashed at a time


@lru_cache(maxsize=1)
def separators() -> np.ndarray:
    """Words are runs of ASCII letters and digits and of all bytes beyond ASCII."""
    gap = np.ones(256, dtype=bool)
    gap[48:58] = gap[65:91] = gap[97:123] = gap[128:] = False
    return gap


def term_sets(column: pa.Array, bits: int = SPACE_BITS):
    """For each text its sorted distinct terms: hashes of its words, A to Z in lower case, and of their first bytes.

    A null or wordless text has none.
    """
    for at in range(0, len(column), TEXTS):
        data, bounds = text_bytes(column.slice(at, TEXTS))
        begins, ends = word_spans(separators()[data], bounds[:-1])
        words = np.searchsorted(begins, bounds)
        found = [(words, span_hashes(data, begins, ends))]
        for n in STEMS:
            long_ = np.flatnonzero(ends - begins >= n)
            hashes = span_hashes(data, begins[long_], begins[long_] + n) * np.uint64(2 * n + 1)
            found.append((np.searchsorted(long_, words), hashes))
        for i in range(len(bounds) - 1):
            one = np.concatenate([hashes[cut[i] : cut[i + 1]] for cut, hashes in found])
            yield np.unique(one >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class FactorizationMachine:
    """score(x) = sigmoid(bias + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j); x_i is ``scale`` for each term of the text.

    A text's terms count once each.
    """

    bias: float
    w: np.ndarray
    v: np.ndarray
    scale: float = 1.0

    def logit(self, terms: np.ndarray) -> float:
        if not len(terms) or not len(self.w):
            return self.bias
        v = self.v[terms]
        pairs = 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
        return self.bias + self.scale * float(self.w[terms].sum()) + self.scale**2 * pairs

    def scores(self, column: pa.Array) -> np.ndarray:
        """0 to 1 for each text of an Arrow column."""
        return sigmoid(np.array([self.logit(t) for t in term_sets(column)], dtype=np.float64))

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Sparse rows with ``scale`` at each term, and what the gradients by their distinct terms need."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, scale: float):
        sizes = np.array([len(r) for r in rows])
        terms = np.concatenate(rows)
        place = np.zeros(int(terms.max()) + 1, np.int32)
        place[terms] = 1
        self.unique = np.flatnonzero(place)
        place[self.unique] = np.arange(len(self.unique))
        self.at = place[terms]
        self.starts, self.owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        self.scale = np.float32(scale)
        self.y, self.weights = labels.astype(np.float32), (weights / weights.sum()).astype(np.float32)

    @cached_property
    def by_term(self) -> tuple[np.ndarray, np.ndarray]:
        """An order of all places by their terms, and where each term starts in it."""
        order = np.argsort(self.at, kind="stable").astype(np.int32)
        return order, np.searchsorted(self.at[order], np.arange(len(self.unique)))

    def linear(self, w: np.ndarray) -> np.ndarray:
        return self.scale * np.add.reduceat(w[self.at], self.starts)

    def pairs(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the pairs add to each row's logit, and each row's sum of factors."""
        values = v[self.at]
        sums = np.add.reduceat(values, self.starts)
        return self.scale**2 * 0.5 * ((sums**2).sum(1) - np.add.reduceat((values**2).sum(1), self.starts)), sums

    def slope(self, z: np.ndarray) -> np.ndarray:
        """The weighted log loss by each row's logit."""
        return self.weights * (sigmoid(z) - self.y)

    def by_w(self, g: np.ndarray) -> np.ndarray:
        return self.scale * np.bincount(self.at, g[self.owner], minlength=len(self.unique)).astype(np.float32)

    def by_v(self, g: np.ndarray, v: np.ndarray, sums: np.ndarray) -> np.ndarray:
        order, first = self.by_term
        owner = self.owner[order]
        values = g.astype(np.float32)[owner][:, None] * (sums[owner] - v[self.at[order]])
        return self.scale**2 * np.add.reduceat(values, first)

    def loss(self, z: np.ndarray) -> float:
        p = np.clip(sigmoid(z), 1e-7, 1 - 1e-7)
        return float(-(self.weights * np.where(self.y > 0, np.log(p), np.log(1 - p))).sum())


def shrunk(x: np.ndarray, by: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def linear_part(x: Rows, lasso: float, steps: int, rounds: int = 6) -> tuple[float, np.ndarray]:
    """Bias and weights of x's distinct terms that minimise the log loss with an L1 penalty.

    Each round takes the terms with a weight, or whose slope nears the penalty, from a pass over all terms, and fits
    these by accelerated proximal steps; terms left out would keep a zero weight at the optimum.
    """
    bias, w = 0.0, np.zeros(len(x.unique), np.float32)
    n = len(x.y)
    for _ in range(rounds):
        g = x.slope(bias + x.linear(w))
        active = (w != 0) | (np.abs(x.by_w(g)) > 0.8 * lasso)
        held = active[x.at]
        owner, place = x.owner[held], (np.cumsum(active, dtype=np.int32) - 1)[x.at[held]]
        size = int(active.sum())
        linear = lambda u: x.scale * np.bincount(owner, u[place], minlength=n)  # noqa: B023, E731
        by_u = lambda g: x.scale * np.bincount(place, g[owner], minlength=size)  # noqa: B023, E731
        probe = np.ones(size)
        for _ in range(8):  # the largest curvature, by power iteration
            probe = by_u(x.weights * linear(probe / max(np.sqrt((probe**2).sum()), 1e-30)))
        rate = 1 / (0.25 * float(np.sqrt((probe**2).sum())) + 0.25)
        old = ahead = (bias, w[active].astype(np.float64))
        for step in range(steps):
            g = x.slope(ahead[0] + linear(ahead[1]))
            new = ahead[0] - rate * float(g.sum()), shrunk(ahead[1] - rate * by_u(g), rate * lasso)
            momentum = step / (step + 3)
            ahead = new[0] + momentum * (new[0] - old[0]), new[1] + momentum * (new[1] - old[1])
            old = new
        bias = old[0]
        w[active] = old[1]
    return bias, w


HELD = 5  # one of so many rows is not learned from, but decides when to stop and where scores fall


def set_aside(rows: list[np.ndarray], seed: int, held: int = HELD) -> tuple[list[int], list[int]]:
    """Numbers of the rows with terms: every ``held``-th of a seeded order, and the others."""
    full = [i for i in np.random.default_rng(seed).permutation(len(rows)).tolist() if len(rows[i])]
    return full[::held], [i for k, i in enumerate(full) if k % held]


def fit(
    rows: list[np.ndarray],
    labels: np.ndarray,
    factors: int = 8,
    lasso: float = 1e-4,
    decay: float = 0.02,
    steps: int = 240,
    epochs: int = 20,
    patience: int = 3,
    batch: int = 256,
    seed: int = 5,
    bits: int = SPACE_BITS,
) -> FactorizationMachine:
    """Learns from all terms of all rows; both classes weigh the same, so logits are for even odds.

    The linear part is fitted first, with an L1 penalty.  Then linear part and factors learn together in seeded batches,
    the factors with L2 decay.  The rows of ``set_aside`` are not learned from: the epoch with the least
    loss on these rows is kept, and after ``patience`` epochs without a better one learning ends.  So pairs count only
    as far as they tell more about rows not learned from.  Terms that no row has keep zero weights.  ``factors`` 0 gives
    the linear part alone.
    """
    rng = np.random.default_rng(seed)
    aside, taught = set_aside(rows, seed)
    full = aside + taught
    y = labels.astype(np.int64)
    nothing = FactorizationMachine(0.0, np.zeros(0, np.float32), np.zeros((0, factors), np.float32))
    if not full:
        return nothing
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    scale = float(np.mean([len(rows[i]) for i in full])) ** -0.5
    make = lambda part: Rows([rows[i] for i in part], y[part], weight[part], scale)
    if not taught or len(set(y[taught].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
        aside, taught, factors = [], full, 0  # too few rows to set some aside
    x = make(taught)
    bias, lean = linear_part(x, lasso, steps)
    w, v = np.zeros(1 << bits, np.float32), np.zeros((1 << bits, factors), np.float32)
    w[x.unique] = lean
    if not factors:
        return FactorizationMachine(bias, w, v, scale)
    test = make(aside)
    of_test = lambda: test.loss(bias + test.linear(w[test.unique]) + test.pairs(v[test.unique])[0])
    best, least, idle = (bias, w.copy(), v.copy()), of_test(), 0
    v[x.unique] = rng.normal(0, 0.1, (len(x.unique), factors))
    batches = [make(taught[i : i + batch]) for i in range(0, len(taught), batch)]
    rate, rate_v = 0.3, 0.3 / scale**2
    for _ in range(epochs):
        for k in rng.permutation(len(batches)).tolist():
            b = batches[k]
            bw, bv = w[b.unique], v[b.unique]
            add, sums = b.pairs(bv)
            g = b.slope(bias + b.linear(bw) + add)
            bias -= rate * float(g.sum())
            w[b.unique] = shrunk(bw - rate * b.by_w(g), rate * lasso)
            v[b.unique] = bv - rate_v * (b.by_v(g, bv, sums) + scale**2 * decay * bv)
        loss = of_test()
        if loss < least - 1e-4:
            best, least, idle = (bias, w.copy(), v.copy()), loss, 0
        else:
            idle += 1
            if idle >= patience:
                break
    return FactorizationMachine(float(best[0]), best[1], best[2], scale)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def constant(logit: float) -> FactorizationMachine:
    return FactorizationMachine(logit, np.zeros(0, np.float32), np.zeros((0, 1), np.float32))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, seed: int = 5) -> FactorizationMachine:
    """Learns from at most ``per_class`` labelled documents of each class, those with the smallest hash of their id.

    Labels of held-out ids are never read, nor labels other than 0 and 1; an id with both counts as toxic.  With no
    usable label of one of the classes the machine is constant: the rate of label 1, or 0.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = known.agg(F.avg("toxic")).first()[0]
    if rate is None or rate in (0.0, 1.0):
        return constant(30.0 if rate else -30.0)
    sample = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)

    def task(batches):
        for batch in batches:
            found = pa.array([t.tobytes() for t in term_sets(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "toxic", "terms"])

    # at most 2 * per_class rows, so the broadcast is bounded
    texts = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    joined = texts.join(F.broadcast(sample.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic"))), "doc_id")
    rows = in_batches(joined).select("doc_id", "toxic", "text").mapInArrow(trimmed(task), "doc_id long, toxic int, terms binary").collect()
    rows = sorted({(r["doc_id"], r["toxic"], bytes(r["terms"])) for r in rows})
    y = np.array([r[1] for r in rows], dtype=np.int64)
    if len(rows) == 0 or y.min() == y.max():
        return constant(float(np.log(rate / (1 - rate))))
    terms_of = [np.frombuffer(r[2], dtype=np.int32) for r in rows]
    machine = fit(terms_of, y, seed=seed)
    unseen = set_aside(terms_of, seed)[0]
    if len(set(y[unseen].tolist())) < 2:
        unseen = list(range(len(y)))
    machine.bias += shift(np.array([machine.logit(terms_of[i]) for i in unseen]), y[unseen], rate)
    return machine


def shift(z: np.ndarray, y: np.ndarray, rate: float, threshold: float = 0.3) -> float:
    """What to add to logits for even odds: from the log odds of ``rate`` to 0, what errs least at ``threshold`` there.

    The sample's classes count by their true rates.  Where the terms tell the classes apart nothing is added; where they
    tell nothing, the score is the rate.
    """
    tried = np.linspace(0, np.log(rate / (1 - rate)), 11)
    at = np.log(threshold / (1 - threshold))
    errors = [rate * (z[y == 1] + s < at).mean() + (1 - rate) * (z[y == 0] + s >= at).mean() for s in tried]
    return float(tried[int(np.argmin(errors))])


def score(docs: DataFrame, machine: FactorizationMachine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, repeated ones too; a null text counts as empty.

    One pass over whole texts without a shuffle.  A null doc_id is not held out.  Only doc_id and text are read.
    """

    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.scores(batch.column(1)))], names=["doc_id", "score"])

    out = in_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(task), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, machine: FactorizationMachine, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, all columns unchanged; no shuffle."""
    at = docs.columns.index("text")

    def task(batches):
        for batch in batches:
            yield batch.filter(pa.array(machine.scores(batch.column(at).cast(pa.string())) < threshold))

    return in_batches(docs).mapInArrow(trimmed(task), docs.schema)
